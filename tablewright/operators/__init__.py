"""Table steps; importing this package registers them all."""
from . import (aggregation, binning, columns, dates, encoding, filters, missing, outliers,  # noqa: F401
               reshape, rows, scaling, selection, text, windows)
