"""Steps that first take statistics of the data."""

from ..operators.binning import bin_coverage, bin_gaps
from .base import NULLED, NULLED_SEGMENT, NUMBERS, query, steps, table

_V = "CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END"
_N = f"(SELECT event_id, {_V} AS value FROM events)"
_PICK = ["event_id", "value"]


def _disc(column: str, q: float, source: str) -> str:
    """Nearest-rank quantile: the value at position floor((n - 1) * q + 0.5)."""
    return (f"(SELECT x FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS i, "
            f"count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL) WHERE i = floor((n - 1) * {q} + 0.5))")


# filling

steps("fill_null_mean", NULLED, [("fill_null", {"column": "value"})],
      f"SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM {_N}", select=_PICK)
steps("fill_null_median", NULLED, [("fill_null", {"column": "value", "strategy": "median"})],
      f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {_N})), 6) AS value FROM {_N}", select=_PICK)
steps("fill_null_mode", NULLED_SEGMENT, [("fill_null", {"columns": ["seg"], "strategy": "mode"})],
      """WITH s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS seg FROM customer)
         SELECT c_custkey, coalesce(seg, (SELECT seg FROM s WHERE seg IS NOT NULL GROUP BY seg
         ORDER BY count(*) DESC, seg LIMIT 1)) AS seg FROM s""", select=["c_custkey", "seg"])
steps("fill_null_constant", NULLED, [("fill_null", {"column": "value", "strategy": "constant", "value": "-1.5"})],
      f"SELECT event_id, round(coalesce(value, -1.5), 6) AS value FROM {_N}", select=_PICK)
steps("fill_null_constant_types",
      """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS u,
         CASE WHEN event_type = 'view' THEN NULL ELSE value > 50 END AS b,
         CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS t FROM events""",
      [("fill_null", {"columns": ["u"], "strategy": "constant", "value": "7.9"}),
       ("fill_null", {"columns": ["b"], "strategy": "constant", "value": "Yes"}),
       ("fill_null", {"columns": ["t"], "strategy": "constant", "value": 5})],
      """SELECT event_id, CASE WHEN event_type = 'view' THEN 7 ELSE user_id END AS u,
         CASE WHEN event_type = 'view' THEN TRUE ELSE value > 50 END AS b,
         CASE WHEN event_type = 'view' THEN '5' ELSE event_type END AS t FROM events""")

# scaling

steps("min_max_scale", NULLED, [("min_max_scale", {"columns": ["value"]})],
      f"""SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value
          FROM {_N}""", select=_PICK)
steps("min_max_scale_many", NUMBERS, [("min_max_scale", {"columns": ["q", "p", "d", "k"]})],
      """SELECT round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS q,
         round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS p,
         round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 6) AS d,
         CAST(0.0 AS DOUBLE) AS k FROM lineitem""", select=["q", "p", "d", "k"])
steps("standardize", NUMBERS, [("standardize", {"columns": ["q", "p", "k"]})],
      """SELECT round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS q,
         round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS p,
         CAST(0.0 AS DOUBLE) AS k FROM lineitem""", select=["q", "p", "k"])
steps("robust_scale", NULLED, [("robust_scale", {"column": "value"})],
      f"""SELECT event_id, round((value - (SELECT median(value) FROM {_N})) /
          ({_disc('value', 0.75, _N)} - {_disc('value', 0.25, _N)}), 6) AS value FROM {_N}""", select=_PICK)
steps("cap_clip", NULLED, [("cap_clip", {"column": "value", "lower_q": 0.05, "upper_q": 0.9})],
      f"""SELECT event_id, round(CASE WHEN value < {_disc('value', 0.05, _N)} THEN {_disc('value', 0.05, _N)}
          WHEN value > {_disc('value', 0.9, _N)} THEN {_disc('value', 0.9, _N)} ELSE value END, 6) AS value FROM {_N}""",
      select=_PICK)

# encoding

steps("one_hot_encode", NULLED_SEGMENT, [("one_hot_encode", {"column": "seg"})],
      """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS seg_BUILDING,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS seg_FURNITURE,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS seg_HOUSEHOLD
         FROM customer""", select=["c_custkey", "seg_BUILDING", "seg_FURNITURE", "seg_HOUSEHOLD"])
steps("label_encode", NULLED_SEGMENT, [("label_encode", {"column": "seg"})],
      """SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
         WHEN 'HOUSEHOLD' THEN 3 END AS INT) AS seg FROM customer""", select=["c_custkey", "seg"])
steps("label_encode_many_values", "customer", [("label_encode", {"column": "c_name"})],
      "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INT) AS c_name FROM customer",
      select=["c_custkey", "c_name"])
steps("ordinal_encode", "orders",
      [("ordinal_encode", {"column": "o_orderpriority", "order": "5-LOW, 3-MEDIUM,1-URGENT"})],
      """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2
         ELSE -1 END AS INT) AS o_orderpriority FROM orders""", select=["o_orderkey", "o_orderpriority"])
steps("binary_encode", NULLED_SEGMENT, [("binary_encode", {"column": "seg"})],
      """WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
         WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 END AS code FROM customer)
         SELECT c_custkey, CAST(code & 1 AS BIGINT) AS seg_bin_0, CAST((code >> 1) & 1 AS BIGINT) AS seg_bin_1 FROM c""",
      select=["c_custkey", "seg_bin_0", "seg_bin_1"])
steps("binary_encode_single", "SELECT r_regionkey, 'one' AS only FROM region", [("binary_encode", {"column": "only"})],
      "SELECT r_regionkey, 'one' AS only, CAST(0 AS INT) AS only_bin_0 FROM region")

# binning

steps("bin_bucket", "part", [("bin_bucket", {"column": "p_size", "bins": 5})],
      """SELECT p_partkey, CASE WHEN p_size <= 10.8 THEN '(-inf, 10.8]' WHEN p_size <= 20.6 THEN '(10.8, 20.6]'
         WHEN p_size <= 30.4 THEN '(20.6, 30.4]' WHEN p_size <= 40.2 THEN '(30.4, 40.2]' ELSE '(40.2, inf]' END
         AS p_size_binned FROM part""", select=["p_partkey", "p_size_binned"])
_BINS = [{"from": 20, "to": 30, "label": "mid", "to_inclusive": False}, {"from": 1, "to": "9.5", "label": " low "},
         {"from": 40, "to": 45, "from_inclusive": False}]
steps("binning_custom", "part",
      [("binning", {"column": "p_size", "bins": _BINS, "outputColumn": "band", "defaultLabel": "rest"})],
      """SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size <= 9.5 THEN 'low' WHEN p_size >= 20 AND p_size < 30 THEN 'mid'
         WHEN p_size > 40 AND p_size <= 45 THEN '40–45' ELSE 'rest' END AS band FROM part""", select=["p_partkey", "band"])
steps("custom_binning_alias", "part", [("custom_binning", {"column": "p_size", "bins": _BINS})],
      """SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size <= 9.5 THEN 'low' WHEN p_size >= 20 AND p_size < 30 THEN 'mid'
         WHEN p_size > 40 AND p_size <= 45 THEN '40–45' END AS p_size_Bin FROM part""", select=["p_partkey", "p_size_Bin"])
steps("binning_equal_width", "lineitem",
      [("binning", {"column": "l_quantity", "mode": "equal_width", "bins": 7, "outputColumn": "bin"})],
      """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity <= 8 THEN 0 WHEN l_quantity <= 15 THEN 1
         WHEN l_quantity <= 22 THEN 2 WHEN l_quantity <= 29 THEN 3 WHEN l_quantity <= 36 THEN 4
         WHEN l_quantity <= 43 THEN 5 ELSE 6 END AS INT) AS bin FROM lineitem""",
      select=["l_orderkey", "l_linenumber", "bin"])
steps("binning_equal_frequency", "lineitem",
      [("binning", {"column": "l_extendedprice", "mode": "equal_frequency", "bins": 4, "outputColumn": "bin"})],
      """WITH r AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem),
         c AS (SELECT max(CASE WHEN i = ceil(n / 4) THEN x END) AS a, max(CASE WHEN i = ceil(2 * n / 4) THEN x END) AS b,
         max(CASE WHEN i = ceil(3 * n / 4) THEN x END) AS c FROM r)
         SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_extendedprice <= a THEN 0 WHEN l_extendedprice <= b THEN 1
         WHEN l_extendedprice <= c THEN 2 ELSE 3 END AS INT) AS bin FROM lineitem, c""",
      select=["l_orderkey", "l_linenumber", "bin"])
steps("binning_quantile", "orders",
      [("binning", {"column": "o_totalprice", "mode": "quantile", "bins": 3, "outputColumn": "bin"})],
      """WITH c AS (SELECT quantile_cont(o_totalprice, 1.0 / 3) AS a, quantile_cont(o_totalprice, 2.0 / 3) AS b FROM orders)
         SELECT o_orderkey, CAST(CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 ELSE 2 END AS INT) AS bin
         FROM orders, c""", select=["o_orderkey", "bin"])


@query("bin_coverage", """WITH c AS (SELECT count(p_size) AS n, count(CASE WHEN p_size BETWEEN 1 AND 9.5
    OR (p_size >= 20 AND p_size < 30) OR (p_size > 40 AND p_size <= 45) THEN 1 END) AS k FROM part)
    SELECT n AS values, k AS covered, round(100.0 * k / n, 1) AS covered_pct,
    round(100.0 - 100.0 * k / n, 1) AS uncovered_pct FROM c""")
def _coverage(spark, sf_dir):
    return bin_coverage(table(spark, sf_dir, "part"), "p_size", _BINS)


@query("bin_gaps", """SELECT CAST(9.5 AS DOUBLE) AS gap_from, CAST(20 AS DOUBLE) AS gap_to,
    count(CASE WHEN p_size > 9.5 AND p_size < 20 THEN 1 END) AS rows FROM part
    UNION ALL SELECT 30.0, 40.0, count(CASE WHEN p_size > 30 AND p_size < 40 THEN 1 END) FROM part""")
def _gaps(spark, sf_dir):
    return bin_gaps(table(spark, sf_dir, "part"), "p_size", _BINS)


# outliers

def _fences(column: str, source: str) -> str:
    return (f"(SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (SELECT {_disc(column, 0.25, source)} AS a, "
            f"{_disc(column, 0.75, source)} AS b))")


steps("detect_iqr", NULLED, [("detect_iqr", {"column": "value"})],
      f"""SELECT event_id, CAST(CASE WHEN value IS NULL THEN NULL WHEN value < lo OR value > hi THEN 1 ELSE 0 END AS INT)
          AS value_outlier_iqr FROM {_N}, {_fences('value', _N)}""", select=["event_id", "value_outlier_iqr"])
steps("detect_zscore", NULLED, [("detect_zscore", {"column": "value", "threshold": 2.5})],
      f"""SELECT event_id, CAST(abs((value - avg(value) OVER ()) / stddev_samp(value) OVER ()) > 2.5 AS INT)
          AS value_outlier_z FROM {_N}""", select=["event_id", "value_outlier_z"])
steps("remove_outliers_iqr", NULLED, [("remove_outliers", {"column": "value"})],
      f"SELECT event_id, round(value, 6) AS value FROM {_N}, {_fences('value', _N)} WHERE value BETWEEN lo AND hi", select=_PICK)
steps("remove_outliers_zscore", NULLED, [("remove_outliers", {"column": "value", "method": "zscore", "threshold": 2})],
      f"""SELECT event_id, round(value, 6) AS value FROM (SELECT *, avg(value) OVER () AS m, stddev_samp(value) OVER () AS s
          FROM {_N}) WHERE abs((value - m) / s) <= 2""", select=_PICK)

# column selection: the statements below hold because of the columns' known relations (q2 = 2 q + 1, k constant)

steps("correlation_filter", NUMBERS, [("correlation_filter", {"target": "q", "threshold": 0.5})],
      "SELECT l_quantity AS q, l_quantity * 2 + 1 AS q2, CAST(1.0 AS DOUBLE) AS k, l_returnflag AS flag FROM lineitem")
steps("variance_threshold", NUMBERS, [("variance_threshold", {"threshold": 0.5})],
      """SELECT l_quantity AS q, l_quantity * 2 + 1 AS q2, round(l_extendedprice, 6) AS p, l_returnflag AS flag
         FROM lineitem""")
steps("select_k_best", NUMBERS, [("select_k_best", {"target": "q", "k": 1})],
      "SELECT l_quantity * 2 + 1 AS q2, l_quantity AS q, l_returnflag AS flag FROM lineitem")
steps("remove_constant_cols", NUMBERS, [("remove_constant_cols", {})],
      """SELECT l_quantity AS q, l_quantity * 2 + 1 AS q2, round(l_extendedprice, 6) AS p, l_discount AS d,
         l_returnflag AS flag FROM lineitem""")
steps("remove_highly_correlated", NUMBERS, [("remove_highly_correlated", {"threshold": 0.9})],
      """SELECT l_quantity AS q, round(l_extendedprice, 6) AS p, l_discount AS d, CAST(1.0 AS DOUBLE) AS k,
         l_returnflag AS flag FROM lineitem""")
