"""Registered queries over the test tables, each with an equivalent SQL statement where SQL can say it."""
from . import base, charts, columns, edges, fitted, grouped, joined, modelling, nest, ordered, profiles, rows, sources, streamed  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
