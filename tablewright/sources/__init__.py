"""Table sources and sinks."""
from .files import load, save

__all__ = ["load", "save"]
