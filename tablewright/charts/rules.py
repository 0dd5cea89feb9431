"""Which columns a chart accepts and which chart suits some columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import is_numeric, is_temporal

# fixed values: column limits per axis
MAX_X, MAX_Y = 5, 10

# fixed values: preparation each chart type supports
SUPPORTS = {
    "scatter": set(),
    "line": {"aggregation", "sorting", "topN"},
    "histogram": {"binning"},
    "bar": {"aggregation", "sorting", "topN"},
    "stacked_bar": {"aggregation", "sorting", "topN"},
    "horizontal_bar": {"aggregation", "sorting", "topN"},
    "area": {"aggregation", "sorting", "topN"},
    "bubble": set(),
    "box": {"sorting", "topN"},
    "violin": {"sorting", "topN"},
    "heatmap": set(),
    "count": {"sorting", "topN"},
    "density": {"binning"},
    "kde": {"binning"},
    "hexbin": {"binning"},
}

_NUMBERS_OR_DATES = {"scatter": "xy", "line": "x"}
_NUMBERS = {"line": "y", "bar": "y", "box": "y", "violin": "y", "heatmap": "xy"}


def check_columns(df: DataFrame, chart: str, x: list[str], y: list[str]) -> None:
    """Raise ``ValueError`` when the chart cannot take these columns."""
    if len(x) > MAX_X or len(y) > MAX_Y:
        raise ValueError(f"a chart takes at most {MAX_X} x and {MAX_Y} y columns")
    if not x:
        raise ValueError("a chart needs an x column")
    for axis, names in (("x", x), ("y", y)):
        for c in names:
            if c not in df.columns:
                raise ValueError(f"{axis} column {c!r} is not in the table")
    if chart in ("scatter", "line") and not y:
        raise ValueError(f"a {chart} chart needs a y column")
    axes = {"x": x if chart == "heatmap" else x[:1], "y": y}
    for axis, names in axes.items():
        for c in names:
            if axis in _NUMBERS.get(chart, "") and not is_numeric(df, c):
                raise ValueError(f"a {chart} chart needs numbers in {axis} column {c!r}")
            if axis in _NUMBERS_OR_DATES.get(chart, "") and not (is_numeric(df, c) or is_temporal(df, c)):
                raise ValueError(f"a {chart} chart needs numbers or dates in {axis} column {c!r}")


def _kind(df: DataFrame, name: str) -> str:
    return "number" if is_numeric(df, name) else "date" if is_temporal(df, name) else "other"


# fixed values: chart by the kinds of the first x and y column
_BY_KINDS = {
    ("number", None): "histogram",
    ("date", "number"): "line",
    ("number", "date"): "line",
    ("number", "number"): "scatter",
    ("number", "other"): "bar",
    ("other", "number"): "bar",
}


def suggest_chart(df: DataFrame, x: list[str], y: list[str]) -> str:
    """A chart type from the column types alone."""
    if not x:
        return "scatter"
    kinds = _kind(df, x[0]), _kind(df, y[0]) if y else None
    return _BY_KINDS.get(kinds, "scatter" if y else "bar")
