"""Small fixtures for nulls, NaN, constants, empty and single-row tables."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values

NUM = "id bigint, x double"


def test_unknown_step_raises_and_missing_column_is_skipped(apply):
    with pytest.raises(ValueError, match="unknown step"):
        apply([(1, 1.0)], NUM, ("no_such_step", {}))
    for step in ("lowercase", "drop_columns", "fill_null", "log_transform", "cap_clip", "detect_iqr", "label_encode"):
        assert apply([(1, 1.0)], NUM, (step, {"column": "absent"})).columns == ["id", "x"]


def test_registered_user_step(spark, apply):
    from tablewright import register
    register("double_it", lambda df, p: df.withColumn(p["column"], F.col(p["column"]) * 2))
    assert values(apply([(1, 3.0)], NUM, ("double_it", {"column": "x"})), "x") == [6.0]


def test_log_and_sqrt_edges(apply):
    out = values(apply([(1, -1.0), (2, -5.0), (3, None), (4, 0.0)], NUM, ("log_transform", {"column": "x"})), "x")
    assert out[0] == -math.inf and math.isnan(out[1]) and out[2] is None and out[3] == 0.0
    assert math.isnan(values(apply([(1, -1.0)], NUM, ("sqrt_transform", {"column": "x"})), "x")[0])


def test_formula(apply):
    rows = [(1, 4.0), (2, 0.0), (3, None)]
    out = values(apply(rows, NUM, ("custom_formula", {"formula": "`id` / x + sqrt(4)", "new_name": "f"})), "f")
    assert out == [2.25, math.inf, None]
    out = values(apply(rows, NUM, ("custom_formula", {"formula": "(x > 1) & ~(id == 2)", "new_name": "f"})), "f")
    assert out == [True, False, None]
    out = values(apply(rows, NUM, ("custom_formula", {"formula": "id in [1, 3] and -id < -1", "new_name": "f"})), "f")
    assert out == [False, False, True]
    for bad in ("nope + 1", "__import__('os')", "x.real", "x +", "lambda: 1"):
        with pytest.raises(ValueError):
            apply(rows, NUM, ("custom_formula", {"formula": bad, "new_name": "f"}))


def test_strict_and_lenient_cast(apply):
    with pytest.raises(PySparkException):
        apply([("a",)], "s string", ("change_datatype", {"column": "s", "dtype": "int64"})).collect()
    assert values(apply([("a",), ("5",)], "s string",
                        ("change_datatype", {"column": "s", "dtype": "int64", "errors": "null"}))) == [None, 5]
    assert apply([("a",)], "s string", ("change_datatype", {"column": "s", "dtype": "other"})).dtypes == [("s", "string")]


def test_split_takes_the_delimiter_literally(apply):
    out = apply([("a|b|c",), ("d",), (None,)], "s string", ("split_column", {"column": "s", "delimiter": "|"}))
    assert [tuple(r) for r in out.collect()] == [("a|b|c", "a", "b", "c"), ("d", "d", None, None), (None,) * 4]
    assert len(apply([(",".join("x" * 1500),)], "s string", ("split_column", {"column": "s"})).columns) == 1501  # no cap


def test_text_steps(apply):
    def one(text, step, **params):
        return values(apply([(text,)], "s string", (step, {"column": "s", **params})), None)[0]
    assert one("\t a b \n", "trim_spaces") == "a b"
    assert one("aXbX", "replace_substring", old_val="X", new_val="$1") == "a$1bX"
    assert one("a.b.c", "replace_substring", old_val=".", new_val="") == "ab.c"
    assert one("abc", "replace_substring", old_val="", new_val="_") == "_abc"
    assert one("x12y34", "regex_replace", pattern=r"(\d)(\d)", replacement="$2${1}") == "x21y34"
    assert one("multi\nline 7\nend 8", "regex_replace", pattern=r"\d", replacement="#") == "multi\nline #\nend 8"
    assert one("ab1", "regex_replace", pattern=r"(?P<w>\p{L})", replacement=r"\${w}$$") == "\\a$b1"
    assert one("a.a", "regex_replace", pattern="a", replacement="$$1", all=True) == "$1.$1"
    assert one(None, "uppercase") is None
    assert one("Ab-9_é!", "remove_special_chars") == "Ab9"

    def domain(text):
        return values(apply([(text,)], "s string", ("extract_domain", {"column": "s"})), "s_domain")[0]
    assert domain("joe@mail.example") == "mail.example"
    assert domain("https://www.site.example:8080/p") == "site.example:8080"
    assert domain("nothing") == "" and domain(None) == ""


def test_contains_is_a_pattern_and_null_never_passes(apply):
    rows = [("a1",), ("b",), (None,)]
    assert values(apply(rows, "s string", ("filter_rows", {"column": "s", "operator": "contains", "value": r"\d"}))) == ["a1"]
    assert values(apply(rows, "s string", ("filter_rows", {"column": "s", "operator": "!=", "value": "b"}))) == ["a1"]
    whole = [(1,), (2,), (3,)]
    assert values(apply(whole, "i int", ("filter_rows", {"column": "i", "operator": ">", "value": "1.5"}))) == [2, 3]
    assert values(apply(whole, "i int", ("filter_rows", {"column": "i", "operator": "==", "value": "2"}))) == [2]


def test_drop_null_rows_keeps_nan(apply):
    rows = [(1, float("nan")), (2, None)]
    assert values(apply(rows, NUM, ("drop_null_rows", {"scope": "any"})), "id") == [1]


def test_scaling_edges(apply):
    rows = [(1, 5.0), (2, None), (3, 5.0)]
    for step in ("min_max_scale", "standardize"):
        assert values(apply(rows, NUM, (step, {"columns": ["x"]})), "x") == [0.0, 0.0, 0.0]
    assert values(apply(rows, NUM, ("robust_scale", {"column": "x"})), "x") == [0.0, 0.0, 0.0]
    assert values(apply([(1, 2.0)], NUM, ("standardize", {"column": "x"})), "x") == [None]
    assert values(apply([(1, None)], NUM, ("cap_clip", {"column": "x"})), "x") == [None]


def test_fill_null_edges(apply):
    assert values(apply([(1, None)], NUM, ("fill_null", {"column": "x"})), "x") == [None]
    rows = [(1, None), (2, 3.0), (3, 3.0), (4, 2.0), (5, 2.0)]
    assert values(apply(rows, NUM, ("fill_null", {"column": "x", "strategy": "mode"})), "x")[0] == 2.0
    assert values(apply(rows, NUM, ("fill_null", {"column": "x", "strategy": "constant"})), "x")[0] is None
    nan = [(1, float("nan")), (2, None)]
    out = values(apply(nan, NUM, ("fill_null", {"column": "x", "strategy": "constant", "value": 1})), "x")
    assert math.isnan(out[0]) and out[1] == 1.0


def test_one_hot_edges(apply):
    assert apply([(None,), (None,)], "s string", ("one_hot_encode", {"column": "s"})).columns == []
    assert apply([("a",)], "s string", ("one_hot_encode", {"column": "s"})).columns == []
    assert apply([], "s string", ("one_hot_encode", {"column": "s"})).columns == ["s"]
    out = apply([("b",), (None,), ("a",), ("c",)], "s string", ("one_hot_encode", {"column": "s"}))
    assert [tuple(r) for r in out.collect()] == [(1, 0), (None, None), (0, 0), (0, 1)]


def test_ordinal_and_binary(apply):
    out = values(apply([("lo",), ("hi",), (None,), ("x",)], "s string", ("ordinal_encode", {"column": "s", "order": "lo, hi"})))
    assert out == [0, 1, -1, -1]
    single = apply([("a",), ("a",)], "s string", ("binary_encode", {"column": "s"}))
    assert single.columns == ["s", "s_bin_0"] and values(single, "s_bin_0") == [0, 0]
    two = apply([("a",), ("b",)], "s string", ("binary_encode", {"column": "s"}))
    assert two.columns == ["s_bin_0"] and values(two) == [0, 1]


def test_label_encode_large_dictionary_without_broadcast(spark, monkeypatch):
    from tablewright.functions import lookup
    from tablewright import apply_steps
    monkeypatch.setattr(lookup, "is_small", lambda df, limit=0: False)
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("v"), "id")).alias("s"))
    out = apply_steps(df, [{"type": "label_encode", "params": {"column": "s"}}]).collect()
    words = sorted({r["s"] for r in df.collect() if r["s"] is not None})
    expected = {r["id"]: None if r["s"] is None else words.index(r["s"]) for r in df.collect()}
    assert {r["id"]: r["s"] for r in out} == expected


def test_binning_rules(apply):
    rows = [(i, v) for i, v in enumerate([0.0, 1.0, 5.0, 7.0, 10.0, None])]

    def bands(bins, **more):
        return values(apply(rows, NUM, ("binning", {"column": "x", "bins": bins, **more})), "x_Bin")
    assert bands([{"from": 1, "to": 5, "to_inclusive": False}, {"from": 6, "to": "10", "label": " top "}]) == [
        None, "1–5", None, "top", "top", None]
    assert bands([], defaultLabel="all") == ["all"] * 6
    for bad, message in (([{"from": 1}], "needed"), ([{"from": "a", "to": 2}], "numeric"), ([{"from": 3, "to": 2}], "above"),
                         ([{"from": 1, "to": 2}, {"from": 2, "to": 3}], "overlap")):
        with pytest.raises(ValueError, match=message):
            bands(bad)
    with pytest.raises(ValueError):
        apply(rows, NUM, ("binning", {"column": "absent"}))
    with pytest.raises(ValueError):
        apply(rows, NUM, ("binning", {"column": "x", "mode": "odd"}))
    assert "x_binned" not in apply([(1, 2.0), (2, 2.0)], NUM, ("bin_bucket", {"column": "x"})).columns


def test_outlier_flags_without_spread(apply):
    assert apply([(1, 2.0), (2, 2.0)], NUM, ("detect_zscore", {"column": "x"})).columns == ["id", "x"]
    assert apply([(1, 2.0), (2, None)], NUM, ("remove_outliers", {"column": "x", "method": "z"})).count() == 2
    assert values(apply([(1, 2.0), (2, None)], NUM, ("detect_iqr", {"column": "x"})), "x_outlier_iqr") == [0, None]


def test_group_aggregates_prefer_numbers_over_nan(apply):
    rows = [("a", float("nan")), ("a", 1.0), ("b", float("nan")), (None, 2.0)]
    out = apply(rows, "k string, x double", ("groupby_aggregate", {"group_cols": ["k"], "agg_col": "x", "agg_type": "max"}))
    found = {r["k"]: r["x"] for r in out.collect()}
    assert found["a"] == 1.0 and math.isnan(found["b"]) and found[None] == 2.0


def test_pivot_drops_null_keys_and_keeps_gaps(apply):
    rows = [("i", "a", 1.0), ("i", "a", 3.0), ("j", "b", 5.0), (None, "a", 9.0), ("j", None, 9.0), ("k", "a", None)]
    schema = "i string, c string, v double"
    params = {"index": "i", "columns_col": "c", "values": "v"}
    mean = apply(rows, schema, ("pivot_table", params)).orderBy("i")
    assert mean.columns == ["i", "a", "b"] and [tuple(r) for r in mean.collect()] == [("i", 2.0, None), ("j", None, 5.0)]
    total = apply(rows, schema, ("pivot_table", {**params, "aggfunc": "sum"})).orderBy("i")
    assert [tuple(r) for r in total.collect()] == [("i", 4.0, None), ("j", None, 5.0), ("k", 0.0, None)]


def test_melt_then_pivot_gives_the_table_back(apply):
    rows = [(1, 2.0, 3.0), (2, 4.0, 5.0)]
    out = apply(rows, "id bigint, a double, b double", ("melt", {"id_vars": ["id"]}),
                ("pivot_table", {"index": "id", "columns_col": "variable", "values": "value"})).orderBy("id")
    assert [tuple(r) for r in out.collect()] == rows


def test_transpose(apply, spark):
    out = apply([(2, 20), (1, 10)], "k int, v int", ("transpose", {"order_by": "k"}))
    assert [tuple(r) for r in out.collect()] == [("k", 1, 2), ("v", 10, 20)]
    from tablewright import apply_steps
    # no limit but the caller's own
    with pytest.raises(ValueError, match="transpose"):
        apply_steps(spark.range(2000), [{"type": "transpose", "params": {"order_by": "id", "max_rows": 1000}}])


def test_column_selection(apply):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.1, 5.0, 2.0)]
    schema = "t double, a double, k double, n double"
    assert apply(rows, schema, ("correlation_filter", {"target": "t", "threshold": 0.99})).columns == ["t", "a", "k", "n"]
    assert apply(rows, schema, ("remove_constant_cols", {})).columns == ["t", "a", "n"]
    assert apply(rows, schema, ("variance_threshold", {})).columns == ["t", "a", "n"]
    assert apply(rows, schema, ("select_k_best", {"target": "t", "k": 1})).columns == ["a", "t"]
    assert apply(rows, schema, ("remove_highly_correlated", {"threshold": 0.95})).columns == ["t", "k", "n"]
    half = [(None, 1), (5, 1)]
    assert apply(half, "a int, b int", ("remove_constant_cols", {})).columns == ["a"]
    assert apply([(None, 1), (None, 2)], "a int, b int", ("remove_constant_cols", {})).columns == ["b"]


def test_steps_on_empty_tables(apply):
    for step in ("min_max_scale", "standardize", "robust_scale", "cap_clip", "fill_null", "detect_iqr", "detect_zscore",
                 "remove_outliers", "bin_bucket", "label_encode", "binary_encode", "variance_threshold", "remove_constant_cols",
                 "drop_cols_null_threshold", "remove_highly_correlated", "sample_rows", "ffill", "bfill", "interpolate",
                 "rolling_window", "split_column"):
        assert apply([], NUM, (step, {"column": "x", "order_by": "id"})).count() == 0, step


def test_sort_puts_nulls_first_both_ways(apply):
    rows = [(1, 2.0), (2, None), (3, 1.0)]
    assert values(apply(rows, NUM, ("sort_column", {"column": "x"})), "x") == [None, 1.0, 2.0]
    assert values(apply(rows, NUM, ("sort_column", {"column": "x", "ascending": False})), "x") == [None, 2.0, 1.0]


def test_sample_is_the_same_under_any_partitioning(spark):
    from tablewright import apply_steps
    step = [{"type": "sample_rows", "params": {"value": 37, "random_state": 3}}]
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    a = sorted(values(apply_steps(df, step)))
    b = sorted(values(apply_steps(df.repartition(13), step)))
    assert a == b and len(a) == 37
    copies = spark.range(100).select(F.lit(1).alias("same"))
    assert apply_steps(copies, step).count() == 37


def test_document_round_trip(tmp_path):
    from tablewright.plans import from_document, read_steps, to_document, write_steps
    steps = [{"type": "fill_null", "params": {"column": "num", "strategy": "mean"}}]
    assert from_document(to_document(steps)) == steps
    write_steps(str(tmp_path / "s.json"), steps)
    assert read_steps(str(tmp_path / "s.json")) == steps
    assert read_steps(str(tmp_path / "none.json")) == [] and from_document("not json") == [] and from_document("[]") == []


def test_load_and_save(spark, tmp_path):
    from tablewright import load, save
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for name in ("t.parquet", "t.csv"):
        save(df, str(tmp_path / name))
        assert sorted(map(tuple, load(spark, str(tmp_path / name)).collect())) == [(1, "a"), (2, None)]
    assert load(spark, str(tmp_path / "t.csv"), "id double, s string").dtypes[0] == ("id", "double")
    with pytest.raises(ValueError, match="Excel"):
        load(spark, "book.XLSX")


def test_preview(spark):
    from tablewright import preview
    df = spark.createDataFrame([(1, float("inf")), (2, None), (3, float("nan"))], NUM)
    seen = preview(df, [{"type": "flag_null", "params": {"column": "x"}}], limit=2, order_by="id")
    assert (seen.rows, seen.columns, seen.nulls) == (3, 3, {"id": 0, "x": 1, "x_isnull": 0})
    assert [r["x"] for r in seen.page.collect()] == [None, None]
    assert preview(df, [], limit="all").page.count() == 3


def test_group_that_takes_no_part_is_null(apply):
    def one(text, pattern):
        return values(apply([(text,)], "s string", ("regex_extraction", {"column": "s", "pattern": pattern, "new_name": "g"})), "g")[0]
    assert one("b", "(a)|b") is None and one("ba", "(a)|b") is None and one("ab", "(a)|b") == "a"
    assert one("b", "b|(b)") is None and one("x1", r"x(\d)?") == "1" and one("x", r"x(\d)?") is None and one("x", r"x(\d*)") == ""
    assert one("a)b", r"[)](b)|(?:c)") == "b" and one("q", "a(b)") is None and one("aa", r"(a)\1") == "a"


def test_decimal_bound_keeps_its_scale(spark):
    from tablewright import apply_steps
    df = spark.sql("SELECT CAST(v AS DECIMAL(10, 2)) AS v FROM VALUES (10.55), (10.56) AS t(v)")
    kept = lambda op: [str(r.v) for r in apply_steps(df, [{"type": "filter_rows", "params": {
        "column": "v", "operator": op, "value": "10.555"}}]).collect()]
    assert kept(">") == ["10.56"] and kept("==") == []


def test_one_hot_refuses_a_name_twice(apply):
    with pytest.raises(ValueError, match="c_B"):
        apply([("A", 1), ("B", 2)], "c string, c_B int", ("one_hot_encode", {"column": "c"}))


def test_steps_that_need_all_rows_refuse_streams(spark, tmp_path):
    from tablewright import apply_steps
    spark.range(3).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "t"))
    for step in ({"type": "remove_duplicates"}, {"type": "groupby_aggregate", "params": {"group_cols": ["id"], "agg_col": "id"}}):
        with pytest.raises(ValueError):
            apply_steps(stream, [step])
