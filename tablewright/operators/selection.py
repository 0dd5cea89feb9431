"""Dropping columns that carry little information."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, is_bad, numeric_columns
from ..functions.statistics import correlations, moments, null_counts, pearson
from ..plans.registry import table_step


def _target_correlations(df: DataFrame, params: dict) -> dict | None:
    target = params.get("target") or params.get("target_col") or params.get("column")
    names = numeric_columns(df)
    if target not in names:
        return None
    pairs = [(c, target) for c in names if c != target]
    return {"target": target, "r": {a: r for (a, _), r in correlations(df, pairs).items()}}


@table_step("correlation_filter", fit=_target_correlations, streams=True)
def correlation_filter(df: DataFrame, params: dict, found: dict | None) -> DataFrame:
    """Drop numeric columns weakly correlated with the target; an undefined one stays."""
    if found is None:
        return df
    limit = float(params.get("threshold", 0.1))
    return df.drop(*[c for c, r in found["r"].items() if not is_bad(r) and abs(r) < limit])


def _variances(df: DataFrame, params: dict) -> dict:
    return {c: m["var_samp"] for c, m in moments(df, numeric_columns(df), "var_samp").items()}


@table_step("variance_threshold", fit=_variances, streams=True)
def variance_threshold(df: DataFrame, params: dict, variances: dict) -> DataFrame:
    limit = float(params.get("threshold", 0.0))
    return df.drop(*[c for c, v in variances.items() if (v or 0.0) <= limit])


@table_step("select_k_best", fit=_target_correlations, streams=True)
def select_k_best(df: DataFrame, params: dict, found: dict | None) -> DataFrame:
    """The ``k`` numeric columns most correlated with the target, the target, the rest as is."""
    if found is None:
        return df
    strength = {c: 0.0 if is_bad(r) else abs(r) for c, r in found["r"].items()}
    best = sorted(strength, key=lambda c: -strength[c])[:int(params.get("k", 5))]
    numeric = set(numeric_columns(df))
    others = [c for c in df.columns if c not in numeric]
    return df.select(*[col(c) for c in [*best, found["target"], *others]])


def _constants(df: DataFrame, params: dict) -> list[str]:
    """Columns with one distinct value; null counts as a value of its own."""
    sortable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    exprs = []
    for i, c in enumerate(sortable):
        exprs += [F.count(col(c)).alias(f"n{i}"),
                  F.min(col(c)).eqNullSafe(F.max(col(c))).alias(f"same{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *exprs).first()
    return [c for i, c in enumerate(sortable)
            if row["rows"] and row[f"same{i}"] and row[f"n{i}"] in (0, row["rows"])]


@table_step("remove_constant_cols", fit=_constants, streams=True)
def remove_constant_cols(df: DataFrame, params: dict, constants: list[str]) -> DataFrame:
    return df.drop(*constants)


def _redundant(df: DataFrame, params: dict) -> list[str]:
    limit = float(params.get("threshold", 0.9))
    rows, nulls = null_counts(df.select(*[col(c) for c in numeric_columns(df)]))
    whole = [c for c, n in nulls.items() if rows and not n]
    if len(whole) < 2:
        return []
    # one product of all columns, not an aggregate per pair
    found = pearson(df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(whole)]))
    pairs = ((i, j) for i in range(len(whole)) for j in range(i + 1, len(whole)))
    return list(dict.fromkeys(whole[j] for i, j in pairs if abs(found[i, j]) > limit))


@table_step("remove_highly_correlated", fit=_redundant, streams=True)
def remove_highly_correlated(df: DataFrame, params: dict, redundant: list[str]) -> DataFrame:
    """Of two strongly correlated columns the later one goes, even if the earlier goes too."""
    return df.drop(*redundant)
