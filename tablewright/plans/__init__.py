"""Step lists: the registry of table steps, documents of steps, and their application."""
from .document import read_steps, write_steps, to_document, from_document
from .registry import FittedSteps, apply_steps, fit_steps, register, registered, row_step, table_step

__all__ = ["FittedSteps", "apply_steps", "fit_steps", "from_document", "read_steps", "register",
           "registered", "row_step", "table_step", "to_document", "write_steps"]
