"""Chart data: queries that turn a table into the small table a chart is drawn from."""
from .data import box_outliers, chart_data
from .rules import check_columns, suggest_chart

__all__ = ["box_outliers", "chart_data", "check_columns", "suggest_chart"]
