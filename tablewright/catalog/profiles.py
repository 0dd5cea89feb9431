"""Profiling reports."""

from pyspark.sql import functions as F

from .. import profile as P
from .base import NULLED, NULLED_SEGMENT, PAIRS, query, rounded, source, table

_V = "CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END"
_N = f"(SELECT event_id, {_V} AS value FROM events)"
_NUM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}
_OTHER = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


def _ranked(column: str, frm: str) -> str:
    return (f"SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS i, count(*) OVER () AS n "
            f"FROM {frm} WHERE {column} IS NOT NULL")


def _at(q: float) -> str:
    return f"max(CASE WHEN i = floor((n - 1) * {q} + 0.5) THEN x END)"


@query("dataset_overview", """SELECT count(*) AS rows, 5 AS columns, 3 AS numeric_columns, 2 AS other_columns,
                              count(*) FILTER (event_type IN ('error', 'view')) AS nulls FROM events""")
def _overview(spark, sf_dir):
    return P.overview(source(spark, sf_dir, NULLED))


_SKEW = """(sum(pow(x - m, 3)) / n) / pow(sum(pow(x - m, 2)) / n, 1.5)"""


def _stats_sql(columns: dict[str, str], others: dict[str, str]) -> str:
    parts = [f"""SELECT '{c}' AS column, '{t}' AS type, count({c}) AS count, count(*) - count({c}) AS nulls, NULL AS mean, NULL AS median,
            NULL AS std, NULL AS min, NULL AS max, NULL AS skewness, NULL AS outliers FROM lineitem""" for c, t in others.items()]
    for c, t in columns.items():
        parts.append(f"""SELECT '{c}' AS column, '{t}' AS type, count(*) AS count, CAST(0 AS BIGINT) AS nulls,
            round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std,
            round(min(x), 6) AS min, round(max(x), 6) AS max, round({_SKEW}, 6) AS skewness,
            count(CASE WHEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) THEN 1 END) AS outliers
            FROM (SELECT {c} AS x FROM lineitem), (SELECT {_at(0.25)} AS a, {_at(0.75)} AS b FROM ({_ranked(c, 'lineitem')})),
            (SELECT avg({c}) AS m, count(*) AS n FROM lineitem) GROUP BY n""")
    return " UNION ALL ".join(parts)


@query("column_statistics", _stats_sql(_NUM, _OTHER))
def _statistics(spark, sf_dir):
    return rounded(P.column_statistics(table(spark, sf_dir, "lineitem"), [*_NUM, *_OTHER]))


@query("column_statistics_with_nulls", f"""SELECT 'value' AS column, 'double' AS type, count(x) AS count, count(*) - count(x) AS nulls,
    round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
    round(max(x), 6) AS max, round((sum(pow(x - m, 3)) / count(x)) / pow(sum(pow(x - m, 2)) / count(x), 1.5), 6) AS skewness,
    count(CASE WHEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) THEN 1 END) AS outliers
    FROM (SELECT value AS x FROM {_N}), (SELECT {_at(0.25)} AS a, {_at(0.75)} AS b FROM ({_ranked('value', _N)})),
    (SELECT avg(value) AS m FROM {_N})
    UNION ALL SELECT 'event_type', 'string', count(*), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events""")
def _statistics_nulls(spark, sf_dir):
    return rounded(P.column_statistics(source(spark, sf_dir, NULLED), ["value", "event_type"]))


def _histogram_sql(columns: list[str], bins: int = 5) -> str:
    parts = []
    for c in columns:
        label = ("CASE WHEN abs(a) < 1000 AND abs(b) < 1000 THEN printf('%.1f', a) || '–' || printf('%.1f', b) "
                 "ELSE printf('%.0e', a) || '–' || printf('%.0e', b) END")
        parts.append(f"""SELECT '{c}' AS column, CAST(g AS INT) AS bin, {label} AS label,
            round(100.0 * (SELECT count(*) FROM lineitem WHERE {c} >= a AND ({c} < b OR g = {bins - 1})) / n, 6) AS percentage
            FROM (SELECT g, n, lo + g * ((hi - lo) / {bins}) AS a,
            CASE WHEN g = {bins - 1} THEN hi ELSE lo + (g + 1) * ((hi - lo) / {bins}) END AS b
            FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS n FROM lineitem),
            (SELECT unnest(range({bins})) AS g))""")
    return " UNION ALL ".join(parts)


@query("histogram_profile", _histogram_sql(list(_NUM)))
def _histogram(spark, sf_dir):
    return rounded(P.histogram(table(spark, sf_dir, "lineitem"), list(_NUM)))


@query("top_distribution", """WITH s AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS seg FROM customer)
    SELECT coalesce(seg, 'NaN') AS label, round(100.0 * count(*) / (SELECT count(seg) FROM s), 6) AS percentage FROM s
    GROUP BY seg ORDER BY count(*) DESC, seg NULLS LAST LIMIT 5""")
def _top(spark, sf_dir):
    return rounded(P.top_distribution(source(spark, sf_dir, NULLED_SEGMENT), "seg"))


@query("unique_values", """SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS count,
    (SELECT count(DISTINCT o_custkey) FROM orders) AS total_unique FROM orders GROUP BY o_custkey
    ORDER BY count(*) DESC, o_custkey LIMIT 100""")
def _unique(spark, sf_dir):
    return P.unique_values(table(spark, sf_dir, "orders"), "o_custkey")


@query("class_distribution", """SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count,
    round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percentage FROM events GROUP BY user_id
    ORDER BY count(*) DESC, user_id LIMIT 30""")
def _classes(spark, sf_dir):
    return rounded(P.report(table(spark, sf_dir, "events"), "class_distribution", "user_id"))


@query("dataset_summary", """SELECT 'rows' AS item, count(*) AS value FROM events UNION ALL SELECT 'columns', 2
    UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events))
    UNION ALL SELECT 'type bigint', 1 UNION ALL SELECT 'type string', 1""")
def _summary(spark, sf_dir):
    return P.report(source(spark, sf_dir, PAIRS), "dataset_summary")


@query("duplicate_rows", """SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))
                            AS duplicate_rows""")
def _duplicates(spark, sf_dir):
    return spark.createDataFrame([(P.duplicate_rows(table(spark, sf_dir, "lineitem")),)], "duplicate_rows bigint")


def _describe_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS column, count(x) AS count, CAST(0 AS BIGINT) AS null_count,
        round(avg(x), 7) AS mean, round(stddev_samp(x), 7) AS std, round(min(x), 7) AS min, round({_at(0.25)}, 7) AS p25,
        round({_at(0.5)}, 7) AS p50, round({_at(0.75)}, 7) AS p75, round(max(x), 7) AS max
        FROM ({_ranked(f'CAST({c} AS DOUBLE)', 'lineitem')})""" for c in columns)


@query("describe", _describe_sql(list(_NUM)))
def _describe(spark, sf_dir):
    return rounded(P.describe(table(spark, sf_dir, "lineitem")), 7)


@query("missing_analysis", """SELECT 'value' AS column, count(*) FILTER (event_type IN ('error', 'view')) AS nulls,
    round(100.0 * count(*) FILTER (event_type IN ('error', 'view')) / count(*), 6) AS percentage FROM events
    UNION ALL SELECT 'event_id', 0, 0.0 UNION ALL SELECT 'user_id', 0, 0.0""")
def _missing(spark, sf_dir):
    return rounded(P.report(source(spark, sf_dir, NULLED).select("event_id", "user_id", "value"), "missing_analysis"))


@query("datatype_overview", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, '{t}' AS dtype, v[1] AS sample_1, v[2] AS sample_2, v[3] AS sample_3 FROM
        (SELECT list(CAST(x AS VARCHAR) ORDER BY x) AS v FROM (SELECT DISTINCT {c} AS x FROM orders ORDER BY 1 LIMIT 3))"""
    for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))))
def _types(spark, sf_dir):
    df = P.report(table(spark, sf_dir, "orders"), "datatype_overview")
    return df.select("column", "dtype", *[F.get("sample_values", F.lit(i)).alias(f"sample_{i + 1}") for i in range(3)])


_CORR_COLUMNS = {"event_id": "event_id", "user_id": "user_id", "value": f"coalesce({_V}, 0.0)", "one": "1.0"}


@query("correlation_matrix", " UNION ALL ".join(
    f"""SELECT '{a}' AS column_a, '{b}' AS column_b, """ + (
        "0.0 AS correlation" if "one" in (a, b) else f"round(corr({x}, {y}), 6) AS correlation FROM events")
    for a, x in _CORR_COLUMNS.items() for b, y in _CORR_COLUMNS.items()))
def _correlation(spark, sf_dir):
    df = source(spark, sf_dir, NULLED).select("event_id", "user_id", "value").withColumn("one", F.lit(1.0))
    return rounded(P.report(df, "correlation_matrix"))
