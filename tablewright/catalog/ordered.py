"""Steps that depend on row order."""

from .base import NULLED, steps

_V = "CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END"
_N = f"(SELECT event_id, {_V} AS value FROM events)"
_PICK = ["event_id", "value"]

steps("drop_rows_index", "events", [("drop_rows_index", {"start": 100, "end": 2999})],
      """SELECT event_id, round(value, 6) AS value FROM
         (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM events) WHERE i < 100 OR i > 2999""",
      select=_PICK, order_by="ts")
steps("ffill", NULLED, [("ffill", {"column": "value"})],
      f"""SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM {_N}""",
      select=_PICK, order_by="event_id")
steps("bfill", NULLED, [("bfill", {"column": "value"})],
      f"""SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value FROM {_N}""",
      select=_PICK, order_by="event_id")
steps("interpolate", NULLED, [("interpolate", {"column": "value"})],
      f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM {_N}),
          k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER up AS i0,
          first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER down AS i1,
          last_value(value IGNORE NULLS) OVER up AS v0, first_value(value IGNORE NULLS) OVER down AS v1 FROM n
          WINDOW up AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          down AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
          SELECT event_id, round(coalesce(value, v0 + (v1 - v0) * ((i - i0) / (i1 - i0))), 6) AS value FROM k""",
      select=_PICK, order_by="event_id")
for _op, _fn in {"mean": "avg", "std": "stddev_samp", "sum": "sum"}.items():
    steps(f"rolling_{_op}", NULLED, [("rolling_window", {"column": "value", "window": 7, "operation": _op})],
          f"""SELECT event_id, round({_fn}(value) OVER (ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 5)
              AS value_rolling_{_op}_7 FROM {_N}""",
          select=["event_id", f"value_rolling_{_op}_7"], order_by="event_id", digits=5)
