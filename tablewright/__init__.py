"""Data preparation, profiling, chart data and model training on Spark DataFrames."""
from . import operators  # noqa: F401  registers the steps
from .plans import apply_steps, fit_steps, register, registered
from .plans.preview import preview
from .sources import load, save

__all__ = ["apply_steps", "fit_steps", "load", "preview", "register", "registered", "save"]
