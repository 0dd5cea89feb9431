"""Joins of two tables beyond Spark's own: heavy keys, overlapping intervals, last earlier row, inequalities."""

from .asof import asof_join
from .intervals import overlap_join
from .keys import keyed_join
from .ranges import range_join, theta_join

__all__ = ["asof_join", "keyed_join", "overlap_join", "range_join", "theta_join"]
