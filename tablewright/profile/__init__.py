"""Profiling reports, each a small tidy DataFrame."""
from .reports import (class_distribution, column_statistics, correlation_matrix, dataset_summary, datatype_overview,
                      describe, duplicate_rows, histogram, missing_analysis, overview, report, top_distribution,
                      type_counts, unique_values)

__all__ = ["class_distribution", "column_statistics", "correlation_matrix", "dataset_summary", "datatype_overview",
           "describe", "duplicate_rows", "histogram", "missing_analysis", "overview", "report", "top_distribution",
           "type_counts", "unique_values"]
