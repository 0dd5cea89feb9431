"""Numbers to intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..functions.quantiles import column_quantiles, values_at_ranks
from ..functions.statistics import moments
from ..plans.registry import table_step


def number_text(x: float) -> str:
    """Six decimals without trailing zeros: 20.8, 100, -2.5."""
    return f"{x:.6f}".rstrip("0").rstrip(".")


def _inner_breaks(low, high, bins: int) -> list[float]:
    if low is None or high is None or not high > low:
        return []
    width = (float(high) - float(low)) / bins
    return [float(low) + width * i for i in range(1, bins)]


def _range_of(df: DataFrame, name: str):
    m = moments(df, [name], "min", "max")[name]
    return m["min"], m["max"]


def _bucket_breaks(df: DataFrame, params: dict):
    if params.get("column") not in df.columns:
        return None
    low, high = _range_of(df, params["column"])
    if low is None or not high > low:
        return None
    return _inner_breaks(low, high, int(params.get("bins", 5)))


@table_step("bin_bucket", fit=_bucket_breaks, streams=True)
def bin_bucket(df: DataFrame, params: dict, breaks) -> DataFrame:
    """Equal-width bins as text labels of right-closed intervals with open ends."""
    if breaks is None:
        return df
    name = params["column"]
    edges = ["-inf", *[number_text(b) for b in breaks], "inf"]
    labels = [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    return df.withColumn(params.get("new_name") or f"{name}_binned", _labelled(col(name), breaks, labels))


def _labelled(x: Column, breaks: list[float], labels: list) -> Column:
    picked = F.when(x.isNull(), None)
    for b, label in zip(breaks, labels):
        picked = picked.when(x <= F.lit(b), F.lit(label))
    return picked.otherwise(F.lit(labels[-1]))


@dataclass(frozen=True)
class Bin:
    low: float
    high: float
    label: str
    closed_low: bool = True
    closed_high: bool = True

    def holds(self, x: Column) -> Column:
        above = x >= self.low if self.closed_low else x > self.low
        below = x <= self.high if self.closed_high else x < self.high
        return above & below


def read_bins(specs: list[dict]) -> list[Bin]:
    """Checked bins in ascending order; touching or overlapping ranges are refused."""
    bins = []
    for number, spec in enumerate(specs, 1):
        ends = spec.get("from"), spec.get("to")
        if None in ends:
            raise ValueError(f"bin {number}: both 'from' and 'to' are needed")
        label = str(spec.get("label") or "").strip() or f"{ends[0]}–{ends[1]}"
        try:
            low, high = map(float, ends)
        except ValueError:
            raise ValueError(f"bin {number}: {ends[0]!r} to {ends[1]!r} is not a numeric range") from None
        if low > high:
            raise ValueError(f"bin {number} ({label}): 'from' {low} lies above 'to' {high}")
        bins.append(Bin(low, high, label, spec.get("from_inclusive", True), spec.get("to_inclusive", True)))
    bins.sort(key=lambda b: b.low)
    for left, right in zip(bins, bins[1:]):
        if right.low <= left.high:
            raise ValueError(f"bins {left.label!r} and {right.label!r} overlap at {right.low}")
    return bins


def _mode_cuts(df: DataFrame, params: dict):
    """What each automatic mode needs: its inner cut points."""
    mode, name = params.get("mode", "custom"), params.get("column")
    if name not in df.columns:
        raise ValueError(f"no column {name!r} to bin")
    k = int(params.get("bins", 5)) if mode != "custom" else 0
    if mode == "custom":
        return None
    if mode == "equal_width":
        return _inner_breaks(*_range_of(df, name), k)
    if mode == "equal_frequency":
        n = df.agg(F.count(col(name))).first()[0]
        ranks = [-(-i * n // k) - 1 for i in range(1, k)]
        return values_at_ranks(df, [(col(name), n, r) for r in ranks if n])
    if mode == "quantile":
        return column_quantiles(df, [name], [i / k for i in range(1, k)], "linear")[name]
    raise ValueError(f"unknown binning mode {mode!r}")


@table_step("binning", "custom_binning", fit=_mode_cuts, streams=True)
def binning(df: DataFrame, params: dict, cuts) -> DataFrame:
    """Custom labelled ranges, or automatic bins numbered from 0.

    ``equal_width`` cuts the range evenly, ``equal_frequency`` at the values that
    split the rows evenly, ``quantile`` at interpolated quantiles. Bins are closed on
    the right; equal values always share a bin, so cuts are all a row needs.
    """
    name = params["column"]
    out = params.get("outputColumn") or f"{name}_Bin"
    if params.get("mode", "custom") != "custom":
        cuts = [float(c) for c in cuts if c is not None]
        return df.withColumn(out, _labelled(col(name), cuts, list(range(len(cuts) + 1))).cast("int"))
    rest = F.lit(params.get("defaultLabel")).cast("string")
    picked = F
    for b in read_bins(params.get("bins") or []):
        picked = picked.when(b.holds(col(name)), F.lit(b.label))
    return df.withColumn(out, rest if picked is F else picked.otherwise(rest))


def bin_coverage(df: DataFrame, column: str, bins: list[dict]) -> DataFrame:
    """Percent of non-null values inside some bin and outside all, to one decimal."""
    inside = F.lit(False)
    for b in read_bins(bins):
        inside = inside | b.holds(col(column))
    known = col(column).isNotNull()
    counts = df.agg(F.count_if(known).alias("values"), F.count_if(known & inside).alias("covered"))
    share = F.coalesce(F.try_divide(F.col("covered") * 100.0, F.col("values")), F.lit(0.0))
    return counts.select("values", "covered", F.round(share, 1).alias("covered_pct"),
                         F.round(100.0 - share, 1).alias("uncovered_pct"))


def bin_gaps(df: DataFrame, column: str, bins: list[dict]) -> DataFrame:
    """The gaps wider than one between neighbouring bins, with the rows falling in each."""
    found = read_bins(bins)
    gaps = [(a.high, b.low) for a, b in zip(found, found[1:]) if b.low - a.high > 1]
    x = col(column)
    counts = [F.count_if((x > low) & (x < high)).alias(f"n{i}") for i, (low, high) in enumerate(gaps)]
    if not gaps:
        return df.sparkSession.createDataFrame([], "gap_from double, gap_to double, rows bigint")
    rows = F.array(*[F.struct(F.lit(low).alias("gap_from"), F.lit(high).alias("gap_to"),
                              F.col(f"n{i}").alias("rows")) for i, (low, high) in enumerate(gaps)])
    return df.agg(*counts).select(F.inline(rows))
