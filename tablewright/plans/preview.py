"""A look at a table after its steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import finite
from ..functions.statistics import null_counts
from .registry import apply_steps


@dataclass
class Preview:
    schema_before: list[tuple[str, str]]
    schema_after: list[tuple[str, str]]
    rows: int
    nulls: dict[str, int]
    page: DataFrame

    @property
    def columns(self) -> int:
        return len(self.schema_after)


def page_of(df: DataFrame, limit: int | str = 50) -> DataFrame:
    """The first rows with NaN and infinities shown as null; ``"all"`` means no limit."""
    shown = df.select(*[finite(df, c).alias(c) for c in df.columns])
    return shown if limit == "all" else shown.limit(int(limit))


def preview(df: DataFrame, steps: list[dict], limit: int | str = 50, order_by=None) -> Preview:
    """Schemas, counts and nulls from one aggregate, and the first rows left lazy."""
    after = apply_steps(df, steps, order_by)
    rows, nulls = null_counts(after)
    return Preview(df.dtypes, after.dtypes, rows, nulls, page_of(after, limit))
