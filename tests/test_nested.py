"""JSON text, nested columns, and back."""

import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from tablewright.functions.nested import flattened, json_type, nested, parsed_json, unnested


def texts(spark, values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) and v.startswith("raw:") else json.dumps(v)) for i, v in enumerate(values)],
                                 "id int, t string").withColumn("t", F.regexp_replace("t", "^raw:", "")).repartition(3)


@pytest.mark.parametrize("values, kind", [
    ([1, 2, None], "bigint"), ([1, 2.5], "decimal(21,1)"), ([1, "x"], "string"), ([{"a": 1}, {"b": "x"}], "struct<a:bigint,b:string>"),
    ([[1], [], [2, 3]], "array<bigint>"), ([[1], {"a": 1}], "string"), ([{"a": [{"x": 1}, {"y": True}]}], "struct<a:array<struct<x:bigint,y:boolean>>>"),
    ([{"a": {"b": 1}}, {"a": {"b": "t", "c": None}}], "struct<a:struct<b:string,c:string>>"), ([None], "string"), (["raw:no json", 5], "bigint"),
    ([{"odd name": 1, "a:b": 2, "x`y": [3]}], "struct<a:b:bigint,odd name:bigint,x`y:array<bigint>>")])
def test_types_fit_all_rows(spark, values, kind):
    assert json_type(texts(spark, values), "t").simpleString() == kind


def test_values_survive(spark):
    rng = random.Random(1)

    def value(depth):
        if depth == 0:
            return rng.choice([1, -7, "text", "ünï \"quoted\"", None, True])
        return {k: value(depth - 1) if k != "list" else [value(0) for _ in range(rng.randrange(3))] for k in rng.sample(["a", "b", "c", "list"], 2)}
    values = [value(2) for _ in range(40)]
    found = {r.id: r.v for r in parsed_json(texts(spark, values), "t", "v").select("id", F.to_json("v").alias("v")).collect()}

    def same(a, b):
        """What was parsed holds the value; kinds that did not fit became text, and absent or null fields are left out."""
        if isinstance(b, dict):
            a = json.loads(a) if isinstance(a, str) else a or {}
            return all(same(a.get(k), v) for k, v in b.items()) and set(a) <= set(b)
        if isinstance(b, list):
            a = json.loads(a) if isinstance(a, str) else a
            return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
        return a == b or isinstance(a, str) and (a == json.dumps(b) or json.loads(a) == b if not isinstance(b, str) else a == b)
    assert all(same(json.loads(found[i]), v) for i, v in enumerate(values))


def test_texts_that_are_no_json_are_null(spark):
    found = parsed_json(texts(spark, [{"a": 1}, "raw:{broken", None, "raw:"]), "t", "v").orderBy("id").collect()
    assert [r.v and r.v.a for r in found] == [1, None, None, None]
    assert parsed_json(texts(spark, [{"a": 1}]).limit(0), "t").count() == 0


def test_flat_columns(spark):
    df = spark.createDataFrame([((1, ("x", [1, 2])), {"k": 1}), (None, None)], "s struct<a:int,b:struct<c:string,d:array<int>>>, m map<string,int>")
    flat = flattened(df)
    assert flat.columns == ["s.a", "s.b.c", "s.b.d", "m"] and [tuple(r) for r in flat.collect()] == [(1, "x", [1, 2], {"k": 1}), (None,) * 4]
    with pytest.raises(ValueError):
        flattened(df.withColumn("s_a", F.lit(1)), "_")


def test_lists_and_maps_there_and_back(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([None, "a", "b"]) for _ in range(rng.randrange(1, 6))]) for i in range(50)] + [(50, []), (51, None)]
    df = spark.createDataFrame(rows, "i int, l array<string>")
    spread = unnested(df, "l")
    assert spread.columns == ["i", "position", "l"] and spread.count() == sum(max(1, len(v or [])) for _, v in rows)
    assert {r.i: r.l for r in nested(spread.repartition(5), "i", "l").collect()} == {i: v or [] for i, v in rows}
    maps = spark.createDataFrame([(1, {"b": 2, "a": 1}), (2, {}), (3, None)], "i int, m map<string,int>")
    assert sorted((r.i, r.key, r.m) for r in unnested(maps, "m").collect() if r.key) == [(1, "a", 1), (1, "b", 2)] and unnested(maps, "m").count() == 4
    with pytest.raises(TypeError):
        unnested(df, "i")
    twice = nested(nested(unnested(unnested(spark.createDataFrame([(1, [[1, 2], [3]]), (2, [[]])], "i int, l array<array<int>>"), "l", "outer"), "l", "inner"),
                          ["i", "outer"], "l", "inner"), "i", "l", "outer")
    assert {r.i: r.l for r in twice.collect()} == {1: [[1, 2], [3]], 2: [[]]}
