"""Chart data."""

from ..charts import box_outliers, chart_data
from .base import query, rounded, source, table

_DAYS = "SELECT date_trunc('DAY', ts) AS day, event_type, value, user_id FROM events"


def chart(name, text, kind, x, y, options, sql, digits=6):
    def run(spark, sf_dir):
        return rounded(chart_data(source(spark, sf_dir, text), kind, x, y, options), digits)
    query(f"chart_{name}", sql)(run)


chart("top_n", "orders", "count", ["o_custkey"], [], {"topNCount": 25},
      """SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
for _how, _sql in {"mean": "avg", "median": "median", "sum": "sum", "min": "min", "max": "max", "count": "count"}.items():
    chart(f"aggregate_{_how}", "lineitem", "area", ["l_linenumber"], ["l_quantity", "l_discount"], {"aggregationMethod": _how},
          f"""SELECT l_linenumber, {f'round({_sql}(l_quantity), 6)' if _how != 'count' else 'count(l_quantity)'} AS l_quantity,
              {f'round({_sql}(l_discount), 6)' if _how != 'count' else 'count(l_discount)'} AS l_discount
              FROM lineitem GROUP BY 1""")
chart("sorted_by_value", "events", "bar", ["event_type"], ["value"], {"sortOrder": "desc", "aggregationMethod": "max"},
      "SELECT event_type, 'value' AS metric, max(value) AS value FROM events GROUP BY 1 ORDER BY 3 DESC")
chart("scatter", "lineitem", "scatter", ["l_quantity"], ["l_extendedprice", "l_discount"], {},
      """SELECT l_quantity, 'l_extendedprice' AS metric, round(l_extendedprice, 6) AS value FROM lineitem
         UNION ALL SELECT l_quantity, 'l_discount', l_discount FROM lineitem""")
chart("line", _DAYS, "line", ["day"], ["value", "user_id"], {},
      """SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(avg(value), 6) AS value, round(avg(user_id), 6) AS user_id
         FROM events GROUP BY 1""")
chart("auto", "SELECT o_orderdate, o_totalprice FROM orders", "auto", ["o_orderdate"], ["o_totalprice"], {},
      "SELECT o_orderdate, round(avg(o_totalprice), 5) AS o_totalprice FROM orders GROUP BY 1", 5)


def _bins(column: str, frm: str, n: str) -> str:
    return f"""SELECT '{column}' AS column, CAST(g AS INT) AS bin, round(a, 6) AS bin_from, round(b, 6) AS bin_to,
        (SELECT count(*) FROM {frm} WHERE {column} >= a AND ({column} < b OR g = k - 1)) AS count
        FROM (SELECT g, k, lo + g * ((hi - lo) / k) AS a, CASE WHEN g = k - 1 THEN hi ELSE lo + (g + 1) * ((hi - lo) / k) END AS b
        FROM (SELECT lo, hi, k, unnest(range(k)) AS g FROM (SELECT CAST(min({column}) AS DOUBLE) AS lo,
        CAST(max({column}) AS DOUBLE) AS hi, CAST({n} AS BIGINT) AS k FROM {frm})))"""


chart("histogram", "lineitem", "histogram", ["l_quantity", "l_extendedprice"], [], {"binningEnabled": True, "binCount": 12},
      _bins("l_quantity", "lineitem", "12") + " UNION ALL " + _bins("l_extendedprice", "lineitem", "12"))
chart("histogram_auto", "events", "histogram", ["value"], [], {},
      _bins("value", "events", """ceil((max(value) - min(value)) / least((max(value) - min(value)) / (log2(count(*)) + 1),
            2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1.0 / 3)))"""))
chart("bar", "events", "bar", ["event_type"], ["value", "user_id"], {},
      """SELECT event_type, 'value' AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1
         UNION ALL SELECT event_type, 'user_id', round(avg(user_id), 6) FROM events GROUP BY 1""")
chart("bar_counts", "orders", "bar", ["o_orderpriority"], [], {"sortOrder": "asc"},
      "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2")
chart("horizontal_bar", "orders", "horizontal_bar", ["o_orderstatus"], ["o_totalprice"], {"sortOrder": "desc"},
      """SELECT o_orderstatus, 'o_totalprice' AS metric, round(avg(o_totalprice), 5) AS value FROM orders GROUP BY 1""", 5)
chart("stacked_bar", "lineitem", "stacked_bar", ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"],
      {"aggregationMethod": "mean"},
      """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1)
         SELECT l_returnflag, 'l_quantity' AS metric, round(q, 6) AS value, CAST(0 AS DOUBLE) AS base FROM m
         UNION ALL SELECT l_returnflag, 'l_discount', round(d, 6), round(q, 6) FROM m
         UNION ALL SELECT l_returnflag, 'l_tax', round(t, 6), round(q + d, 6) FROM m""")
chart("stacked_bar_counts", "orders", "stacked_bar", ["o_orderstatus"], [], {},
      """SELECT o_orderstatus, 'count' AS metric, CAST(count(*) AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS base
         FROM orders GROUP BY 1""")
chart("area", _DAYS, "area", ["day"], ["value"], {"aggregationMethod": "sum"},
      "SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 6) AS value FROM events GROUP BY 1")
chart("bubble", "lineitem", "bubble", ["l_quantity"], ["l_extendedprice", "l_discount"], {},
      """SELECT l_quantity, round(l_extendedprice, 6) AS value,
         round(20 + 180 * (l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 6) AS size
         FROM lineitem""")


def _box_sql(group: str, values: str) -> str:
    return f"""WITH v AS ({values}), q AS (SELECT {group}, count(*) AS n, quantile_cont(value, 0.25) AS a,
        quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM v GROUP BY {group})
        SELECT {group}, n, round(a, 6) AS q25, round(m, 6) AS median, round(b, 6) AS q75,
        min(CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN value END) AS whisker_low,
        max(CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN value END) AS whisker_high,
        count(CASE WHEN value NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN 1 END) AS outliers
        FROM v JOIN q USING ({group}) GROUP BY {group}, n, a, m, b"""


_BY_TYPE = """SELECT event_type, 'value' AS metric, value FROM events
              UNION ALL SELECT event_type, 'user_id', CAST(user_id AS DOUBLE) FROM events"""
chart("box", "events", "box", ["event_type"], ["value", "user_id"], {}, _box_sql("event_type, metric", _BY_TYPE))
chart("box_single", "lineitem", "box", ["l_extendedprice"], [], {},
      _box_sql("metric", "SELECT 'l_extendedprice' AS metric, l_extendedprice AS value FROM lineitem"))


@query("chart_box_outliers", f"""WITH v AS ({_BY_TYPE}), q AS (SELECT event_type, metric, quantile_cont(value, 0.25) AS a,
    quantile_cont(value, 0.75) AS b FROM v GROUP BY 1, 2) SELECT event_type, metric, round(value, 6) AS value
    FROM v JOIN q USING (event_type, metric) WHERE value NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def _outliers(spark, sf_dir):
    return rounded(box_outliers(table(spark, sf_dir, "events"), ["event_type"], ["value", "user_id"]))


def _curve_sql(keys: str, values: str, name: str = "x") -> str:
    using = f"JOIN g USING ({keys})" if keys else ", g"
    comma = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""WITH v AS ({values}), w AS (SELECT {comma}value, count(*) AS w FROM v GROUP BY {comma}value),
        s AS (SELECT {comma}count(*) AS n, pow(count(*), -0.2) * stddev_samp(value) AS bw, min(value) AS lo, max(value) AS hi
        FROM v {by}), g AS (SELECT {comma}n, bw, lo - 3 * bw + (hi - lo + 6 * bw) * step / 199 AS x
        FROM s, (SELECT unnest(range(200)) AS step))
        SELECT {comma}round(x, 6) AS {name}, round(sum(w * exp(-0.5 * pow((x - value) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6)
        AS density FROM w {using}
        GROUP BY {comma}n, bw, x"""


chart("density", "lineitem", "density", ["l_quantity"], [], {}, _curve_sql("", "SELECT l_quantity AS value FROM lineitem"))
chart("kde", "events", "kde", ["value"], [], {}, _curve_sql("", "SELECT value FROM events"))
chart("violin", "events", "violin", ["event_type"], ["value"], {},
      f"""SELECT c.*, q.n, q25, median, q75 FROM
          ({_curve_sql("event_type, metric", "SELECT event_type, 'value' AS metric, value FROM events", 'at')}) c
          JOIN (SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median,
          round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1) q USING (event_type)""")
chart("kde_joint", "events", "kde", ["user_id"], ["value"], {},
      """WITH p AS (SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM events),
         s AS (SELECT count(*) AS n, var_samp(x) * pow(count(*), -1.0 / 3) AS vx, var_samp(y) * pow(count(*), -1.0 / 3) AS vy,
         covar_samp(x, y) * pow(count(*), -1.0 / 3) AS c, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
         t AS (SELECT *, x0 - 3 * sqrt(vx) AS ax, (x1 - x0 + 6 * sqrt(vx)) / 40 AS wx, y0 - 3 * sqrt(vy) AS ay,
         (y1 - y0 + 6 * sqrt(vy)) / 40 AS wy, vx * vy - c * c AS det FROM s),
         w AS (SELECT least(floor((x - ax) / wx), 39) AS i, least(floor((y - ay) / wy), 39) AS j, count(*) AS w FROM p, t GROUP BY 1, 2),
         g AS (SELECT unnest(range(40)) AS gi), h AS (SELECT unnest(range(40)) AS gj),
         k AS (SELECT gi, gj, sum(w * exp(-0.5 * (pow((gi - i) * wx, 2) * vy - 2 * (gi - i) * wx * (gj - j) * wy * c
         + pow((gj - j) * wy, 2) * vx) / det)) AS k FROM w, g, h, t GROUP BY 1, 2)
         SELECT round(ax + (gi + 0.5) * wx, 9) AS x, round(ay + (gj + 0.5) * wy, 9) AS y,
         round(k / (n * 2 * pi() * sqrt(det)), 9) AS density FROM k, t""", 9)


@query("chart_heatmap", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" if a != b else
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST(1 AS DOUBLE) AS correlation"
    for a in ("l_quantity", "l_extendedprice", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_tax")))
def _heatmap(spark, sf_dir):
    return rounded(chart_data(table(spark, sf_dir, "lineitem"), "heatmap", ["l_quantity", "l_extendedprice"], ["l_tax"]))


chart("count", "events", "count", ["event_type"], [], {"sortOrder": "desc"},
      "SELECT event_type, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC")
chart("hexbin", "lineitem", "hexbin", ["l_quantity"], ["l_extendedprice"], {"binningEnabled": True, "binCount": 15},
      """WITH r AS (SELECT min(l_quantity) - 1e-9 * (max(l_quantity) - min(l_quantity)) AS x0,
         (max(l_quantity) - min(l_quantity)) * (1 + 2e-9) / 15 AS sx,
         min(l_extendedprice) - 1e-9 * (max(l_extendedprice) - min(l_extendedprice)) AS y0,
         (max(l_extendedprice) - min(l_extendedprice)) * (1 + 2e-9) / 8 AS sy FROM lineitem),
         u AS (SELECT (l_quantity - x0) / sx AS u, (l_extendedprice - y0) / sy AS v FROM lineitem, r),
         c AS (SELECT round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) + 0.5 AS i2, floor(v) + 0.5 AS j2, u, v FROM u),
         d AS (SELECT CASE WHEN pow(u - i1, 2) + 3 * pow(v - j1, 2) < pow(u - i2, 2) + 3 * pow(v - j2, 2) THEN i1 ELSE i2 END AS i,
         CASE WHEN pow(u - i1, 2) + 3 * pow(v - j1, 2) < pow(u - i2, 2) + 3 * pow(v - j2, 2) THEN j1 ELSE j2 END AS j FROM c)
         SELECT round(i * sx + x0, 6) AS x, round(j * sy + y0, 6) AS y, count(*) AS count FROM d, r GROUP BY ALL""")
