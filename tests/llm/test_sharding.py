import collections
import zlib

from dataclasses import replace

from llm_data import EDGES, texts  # noqa: F401
from pyspark.sql import functions as F
from tablewright.llm.sharding import Shard, grown_by_one, shard_column, sharded, topology


def place(spark, shards, n=4000):
    return {r.id: r.s for r in spark.range(n).select("id", shard_column(F.col("id").cast("string"), shards).alias("s")).collect()}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    base = topology(40, 4, 2)
    before, after = place(spark, base), place(spark, grown_by_one(base))
    assert set(before.values()) == set(range(40))
    assert {after[i] for i in before if before[i] != after[i]} == {40}


def test_weight_change_is_confined(spark):
    base = topology(24, 3, 2)
    heavier = [replace(s, weight=3.0) if s.number == 0 else s for s in base]
    before, after = place(spark, base), place(spark, heavier)
    region = {s.number: s.region for s in base}
    rack = {s.number: s.rack for s in base}
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    # never between two regions, racks or shards whose weights are as before
    assert moved and all(region[b] == region[0] for _, b in moved)
    assert all(rack[b] == rack[0] for a, b in moved if region[a] == region[b])
    assert all(b == 0 for a, b in moved if rack[a] == rack[b])


def test_shares_follow_weights(spark):
    shards = [Shard("a", "a1", 0, 1.0), Shard("a", "a2", 1, 2.0), Shard("b", "b1", 2, 3.0), Shard("b", "b1", 3, 0.0)]
    counts = collections.Counter(place(spark, shards, 12000).values())
    assert 3 not in counts and all(abs(counts[s.number] / 12000 - s.weight / 6) < 0.02 for s in shards)


def test_operator(texts):
    base = topology(5, 2, 1)
    rows = EDGES + [(9, "again")] * 50
    found = sharded(texts(rows), base, grown_by_one(base)).collect()
    assert len(found) == len(rows) and {r.law for r in found} == {"key"}
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = collections.Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == expected
    assert sharded(texts([]), base, base).collect() == []


def test_rows_without_id_are_numbered_in_many_parts(spark, texts):
    """A third of the rows has no id: they share a shard, but no window holds them all."""
    from pyspark.sql import functions as F
    from tablewright.llm.sharding import sharded, topology
    rows = texts([(None if i % 3 == 0 else i, f"text {i}") for i in range(3000)])
    base = topology(40, 4, 2)
    found = sharded(rows, base, base)
    lost = found.where("doc_id is null")
    assert lost.select("shard").distinct().count() == 1 and lost.count() == 1000
    slots = sorted(r.slot for r in found.join(lost.select("shard").distinct(), "shard").collect())
    assert slots == list(range(len(slots)))
    mixed = F.concat_ws("|", F.lit(""), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    assert lost.select(F.substring(F.md5(mixed), 1, 4)).distinct().count() > 900
