"""Projections, column arithmetic, text and dates."""

from .base import NULLED, NULLED_SEGMENT, steps

steps("drop_columns", "orders", [("drop_columns", {"columns": ["o_orderpriority", "o_orderstatus", "absent"]})],
      "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderdate FROM orders")

steps("rename_column", "orders", [("rename_column", {"columns": {"o_orderkey": "id", "absent": "x"}}),
                                  ("rename_column", {"oldName": "o_custkey", "newName": "cust"})],
      """SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
         o_orderdate, o_orderpriority FROM orders""")

steps("reorder_column", "nation", [("reorder_column", {"column": "n_regionkey", "direction": "start"}),
                                   ("reorder_column", {"column": "n_name", "direction": "left"}),
                                   ("reorder_column", {"column": "n_name", "direction": "end"})],
      "SELECT n_regionkey, n_nationkey, n_name FROM nation")

steps("duplicate_column", "orders", [("duplicate_column", {"column": "o_custkey", "new_name": "copy"})],
      "SELECT o_orderkey, o_custkey, o_custkey AS copy FROM orders", select=["o_orderkey", "o_custkey", "copy"])

steps("cast_to_int", "events", [("change_datatype", {"column": "value", "dtype": "int64"})],
      "SELECT event_id, CAST(trunc(value) AS BIGINT) AS value FROM events", select=["event_id", "value"])

steps("cast_to_float", "orders", [("change_datatype", {"columns": ["o_custkey"], "dtype": "float64"})],
      "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders", select=["o_orderkey", "o_custkey"])

steps("cast_to_text", "orders", [("change_datatype", {"column": "o_custkey", "dtype": "str"})],
      "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders", select=["o_orderkey", "o_custkey"])

steps("cast_to_bool", "labels", [("change_datatype", {"columns": ["toxic", "quality"], "dtype": "bool"}),
                                 ("toggle_bool", {"column": "toxic"})],
      "SELECT doc_id, CAST(quality AS BOOLEAN) AS quality, NOT CAST(toxic AS BOOLEAN) AS toxic FROM labels")

steps("cast_to_datetime",
      "SELECT o_orderkey, substring(CAST(o_orderdate AS STRING), 1, 10) AS d, o_orderpriority FROM orders",
      [("change_datatype", {"columns": ["d", "o_orderpriority"], "dtype": "datetime"})],
      """SELECT o_orderkey, TRY_CAST(substring(CAST(o_orderdate AS VARCHAR), 1, 10) AS TIMESTAMP) AS d,
         TRY_CAST(o_orderpriority AS TIMESTAMP) AS o_orderpriority FROM orders""")

steps("toggle_bool", "SELECT event_id, value > 50 AS high, event_type = 'click' AS clicked FROM events",
      [("toggle_bool", {"columns": ["high", "clicked"]})],
      "SELECT event_id, NOT (value > 50) AS high, NOT (event_type = 'click') AS clicked FROM events")

steps("merge_columns", NULLED_SEGMENT,
      [("merge_columns", {"column": "c_custkey", "column2": "seg", "separator": "-", "new_name": "tag"})],
      """SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY'
         THEN CAST(c_custkey AS VARCHAR) || '-' || c_mktsegment END AS tag FROM customer""",
      select=["c_custkey", "tag"])

steps("split_column", "pages", [("split_column", {"column": "url", "delimiter": "/"})],
      """SELECT page_id, url, string_split(url, '/')[1] AS url_split_1, string_split(url, '/')[2] AS url_split_2,
         string_split(url, '/')[3] AS url_split_3, string_split(url, '/')[4] AS url_split_4,
         string_split(url, '/')[5] AS url_split_5, string_split(url, '/')[6] AS url_split_6 FROM pages""",
      select=["page_id", "url", *[f"url_split_{i}" for i in range(1, 7)]])

steps("interaction_terms", "lineitem",
      [("interaction_terms", {"column": "l_extendedprice", "column2": "l_discount"})],
      """SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS l_extendedprice_x_l_discount
         FROM lineitem""", select=["l_orderkey", "l_linenumber", "l_extendedprice_x_l_discount"])

steps("log_transform", "SELECT event_id, value - 60 AS value FROM events",
      [("log_transform", {"column": "value", "shift": 1})],
      """SELECT event_id, round(CASE WHEN value - 60 + 1 > 0 THEN ln(value - 60 + 1)
         WHEN value - 60 + 1 = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END, 6) AS value FROM events""")

steps("sqrt_transform", "lineitem", [("sqrt_transform", {"column": "l_extendedprice"})],
      "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS l_extendedprice FROM lineitem",
      select=["l_orderkey", "l_linenumber", "l_extendedprice"])

steps("power_transform", "lineitem", [("power_transform", {"column": "l_quantity", "exponent": 1.5})],
      "SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 1.5), 6) AS l_quantity FROM lineitem",
      select=["l_orderkey", "l_linenumber", "l_quantity"])

steps("custom_formula", "lineitem",
      [("custom_formula", {"formula": "l_extendedprice * (1 - l_discount) / l_tax", "new_name": "ratio"}),
       ("custom_formula", {"formula": "(l_quantity > 25) & ~(l_discount <= 0.05) | (l_linenumber ** 2 >= 36)",
                           "new_name": "picked"})],
      """SELECT l_orderkey, l_linenumber,
         round(CASE WHEN l_tax = 0 THEN CASE WHEN l_extendedprice * (1 - l_discount) > 0
         THEN CAST('inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END
         ELSE l_extendedprice * (1 - l_discount) / l_tax END, 6) AS ratio,
         ((l_quantity > 25) AND NOT (l_discount <= 0.05)) OR (l_linenumber * l_linenumber >= 36) AS picked
         FROM lineitem""", select=["l_orderkey", "l_linenumber", "ratio", "picked"])

steps("flag_null", NULLED, [("flag_null", {"column": "value"})],
      """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS value_isnull FROM events""",
      select=["event_id", "value_isnull"])

# text

steps("lowercase", "documents", [("lowercase", {"columns": ["text"]})],
      "SELECT doc_id, lower(text) AS text FROM documents", select=["doc_id", "text"])
steps("uppercase", "customer", [("uppercase", {"columns": ["c_name"]})],
      "SELECT c_custkey, upper(c_name) AS c_name FROM customer", select=["c_custkey", "c_name"])
steps("trim_spaces", "SELECT doc_id, concat(chr(9), ' ', lang, ' ', source, chr(10)) AS s FROM documents",
      [("trim_spaces", {"column": "s"})], "SELECT doc_id, lang || ' ' || source AS s FROM documents")
steps("replace_substring", "documents", [("replace_substring", {"column": "text", "old_val": "e", "new_val": "<$1>"})],
      r"""SELECT doc_id, CASE WHEN instr(text, 'e') > 0 THEN substring(text, 1, instr(text, 'e') - 1) || '<$1>' ||
         substring(text, instr(text, 'e') + 1) ELSE text END AS text FROM documents""", select=["doc_id", "text"])
steps("replace_substring_all", "documents",
      [("replace_substring", {"column": "text", "old_val": "e.", "new_val": "_", "all": True})],
      "SELECT doc_id, replace(text, 'e.', '_') AS text FROM documents", select=["doc_id", "text"])
steps("regex_replace", "documents",
      [("regex_replace", {"column": "text", "pattern": r"([aeiou])([a-z])", "replacement": "$2-${1}"})],
      r"SELECT doc_id, regexp_replace(text, '([aeiou])([a-z])', '\2-\1') AS text FROM documents",
      select=["doc_id", "text"])
steps("regex_replace_all", "documents",
      [("regex_replace", {"column": "text", "pattern": "[0-9]+", "replacement": "#", "all": True})],
      "SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS text FROM documents", select=["doc_id", "text"])
steps("remove_special_chars", "documents", [("remove_special_chars", {"column": "text"})],
      r"SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g') AS text FROM documents",
      select=["doc_id", "text"])
steps("regex_extraction", "pages", [("regex_extraction", {"column": "url", "pattern": r"page=(\d+)", "new_name": "page"})],
      r"SELECT page_id, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page FROM pages",
      select=["page_id", "page"])
steps("extract_domain_of_url", "pages", [("extract_domain", {"column": "url"})],
      r"""SELECT page_id, regexp_extract(url, 'https?://(?:www\.)?([^/\s]+)', 1) AS url_domain FROM pages""",
      select=["page_id", "url_domain"])
steps("extract_domain_of_text", "documents", [("extract_domain", {"column": "text"})],
      r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '@([^\s]+)', 1), ''),
         nullif(regexp_extract(text, 'https?://(?:www\.)?([^/\s]+)', 1), ''), '') AS text_domain FROM documents""",
      select=["doc_id", "text_domain"])

# dates

steps("date_parts_default", "orders", [("date_parts", {"column": "o_orderdate"})],
      """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS o_orderdate_year,
         CAST(month(o_orderdate) AS INT) AS o_orderdate_month, CAST(day(o_orderdate) AS INT) AS o_orderdate_day
         FROM orders""", select=["o_orderkey", "o_orderdate_year", "o_orderdate_month", "o_orderdate_day"])
for _part, _sql in {
        "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "dayofweek": "isodow(ts) - 1",
        "hour": "hour(ts)", "quarter": "quarter(ts)", "minute": "minute(ts)", "second": "second(ts)"}.items():
    steps(f"date_part_{_part}", "events", [("date_parts", {"column": "ts", "parts": [_part, "unknown"]})],
          f"SELECT event_id, CAST({_sql} AS INT) AS ts_{_part} FROM events", select=["event_id", f"ts_{_part}"])
