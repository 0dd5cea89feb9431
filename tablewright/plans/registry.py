"""Named table steps and their application as one Spark plan.

A step has an ``apply(df, params, fitted)`` and, when its result depends on
statistics of the data, a ``fit(df, params)`` that returns them (a few numbers or
names, never rows). Applying a list alternates fit and apply; fitting first and
applying later lets statistics taken from a batch drive a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    name: str
    apply: Callable[[DataFrame, dict, object], DataFrame]
    fit: Callable[[DataFrame, dict], object] | None = None
    streams: bool = True


_STEPS: dict[str, Step] = {}


def _add(names, step_of):
    for name in names:
        _STEPS[name] = step_of(name)


def row_step(*names: str):
    """Register a step that needs no statistics and works row by row."""
    def wrap(fn):
        _add(names, lambda n: Step(n, lambda df, p, _: fn(df, p)))
        return fn
    return wrap


def table_step(*names: str, fit=None, streams: bool = False):
    """Register a step over the whole table, or one with a ``fit`` function."""
    def wrap(fn):
        if fit is None:
            _add(names, lambda n: Step(n, lambda df, p, _: fn(df, p), None, streams))
        else:
            _add(names, lambda n: Step(n, fn, fit, streams))
        return fn
    return wrap


def register(name: str, fn: Callable[[DataFrame, dict], DataFrame]) -> None:
    """Add a user step: any function of a table and its parameters."""
    row_step(name)(fn)


def registered() -> list[str]:
    return sorted(_STEPS)


def _lookup(name: str) -> Step:
    if name not in _STEPS:
        raise ValueError(f"unknown step type: {name!r}")
    return _STEPS[name]


def _params(step: dict, order_by) -> dict:
    params = dict(step.get("params") or {})
    if order_by is not None:
        params.setdefault("order_by", order_by)
    return params


@dataclass
class FittedSteps:
    """Steps with their statistics, ready for another batch or a stream."""
    parts: list[tuple[Step, dict, object]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for step, params, fitted in self.parts:
            if df.isStreaming and not step.streams:
                raise ValueError(f"step {step.name!r} needs the whole table and cannot run on a stream")
            df = step.apply(df, params, fitted)
        return df


def _fold(df: DataFrame, steps: list[dict], order_by=None) -> tuple[FittedSteps, DataFrame]:
    done = FittedSteps()
    for item in steps:
        step, params = _lookup(item["type"]), _params(item, order_by)
        fitted = None
        if step.fit is not None:
            if df.isStreaming:
                raise ValueError(f"step {step.name!r} must be fitted on a batch before streaming")
            fitted = step.fit(df, params)
        part = FittedSteps([(step, params, fitted)])
        df = part.transform(df)
        done.parts += part.parts
    return done, df


def fit_steps(df: DataFrame, steps: list[dict], order_by=None) -> FittedSteps:
    return _fold(df, steps, order_by)[0]


def apply_steps(df: DataFrame, steps: list[dict], order_by=None) -> DataFrame:
    """Apply ``[{"type": ..., "params": {...}}, ...]`` from first to last.

    ``order_by`` names the columns that define row order for the steps that need it.
    """
    return _fold(df, steps, order_by)[1]
