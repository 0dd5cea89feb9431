"""Placing rows in shards by a hierarchical weighted hash tree: regions, racks, shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = ("region", "rack", "shard")
#: per shard, slots are numbered in so many parts
SLOT_BUCKETS = 1024
#: repeats of one row are numbered in stretches of this length
STRETCH = 1 << 16


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def topology(shards: int, regions: int, racks: int) -> list[Shard]:
    """Shards 0, 1, ... dealt evenly to ``regions`` regions of ``racks`` racks."""
    per_rack = -(-shards // (regions * racks))
    return [Shard(f"region{i // (per_rack * racks)}", f"rack{i // per_rack}", i) for i in range(shards)]


def tree(shards: list[Shard]) -> list[list[list[tuple[str, float, int]]]]:
    """Per level and parent: the children as name, weight (the sum of their shards') and number on their level."""
    paths = [((s.region,), (s.region, s.rack), (s.region, s.rack, str(s.number))) for s in shards if s.weight > 0]
    levels, parents = [], {(): 0}
    for k in range(len(LEVELS)):
        weight: dict[tuple, float] = {}
        for path, s in zip(paths, (s for s in shards if s.weight > 0)):
            weight[path[k]] = weight.get(path[k], 0.0) + s.weight
        number = {p: (int(p[-1]) if k == len(LEVELS) - 1 else i) for i, p in enumerate(sorted(weight))}
        children: list[list[tuple[str, float, int]]] = [[] for _ in parents]
        for p in sorted(weight):
            children[parents[p[:-1]]].append(("/".join(p), weight[p], number[p]))
        levels.append(children)
        parents = {p: i for i, p in enumerate(sorted(weight))}
    return levels


def _draw(key: Column, node: Column) -> Column:
    """An exponential draw with rate 1 for a key at a node: equal in every engine that has MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", key, node)), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13))


def shard_column(key: Column, shards: list[Shard]) -> Column:
    """The shard number of a text key: at each level the child with the smallest draw over weight.

    A child's draw does not depend on its siblings, so a change of weight moves keys only between the nodes whose
    weight changes and the rest, never among the rest. A new region takes keys only into itself.
    """
    at = F.lit(0)
    for children in tree(shards):
        listed = F.array(*[F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at"))
                                     for n, w, i in row]) for row in children])
        best = F.array_min(F.transform(F.get(listed, at), lambda c: F.struct(
            (_draw(key, c.node) / c.weight).alias("draw"), c.node.alias("node"), c["at"].alias("at"))))
        at = best["at"]
    return at


def sharded(docs: DataFrame, shards: list[Shard], grown: list[Shard], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``.

    Only the id decides on the shard (law ``key``); a null id counts as empty text. ``size`` is the text's UTF-8 bytes
    plus 16, ``text_crc32`` is null for a null text. ``slot`` numbers a shard's rows from 0 without gaps. Repeated
    rows share the shard and get slots of their own. An empty table gives an empty result; other columns are not read.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    # not by the id alone, which a third of the rows may share or lack
    mixed = F.concat_ws("|", key, F.col("size").cast("string"), F.coalesce(F.col("crc").cast("string"), F.lit("")))
    part = F.conv(F.substring(F.md5(mixed), 1, 4), 16, 10).cast("int") % SLOT_BUCKETS
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(F.col(text_col).cast("binary")).alias("crc"))
    distinct = (rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
                .select("*", shard_column(key, shards).alias("shard"), part.alias("part")))
    parts = (distinct.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
             .withColumn("base", F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows"))
             .select("shard", "part", "base"))
    inside = Window.partitionBy("shard", "part").orderBy("id", "size", "crc")
    # the joined side has at most SLOT_BUCKETS rows per shard
    placed = (distinct.withColumn("start", F.sum("n").over(inside) - F.col("n"))
              .join(F.broadcast(parts), ["shard", "part"]))
    copies = (placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))))
              .withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH - 1, F.col("n") - 1)))))
    return copies.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"),
                         "shard", (F.col("base") + F.col("start") + F.col("copy")).alias("slot"),
                         shard_column(key, grown).alias("grown_shard"))


def grown_by_one(shards: list[Shard]) -> list[Shard]:
    """One more shard of weight 1 in a region of its own, so that rows only move into it."""
    number = max((s.number for s in shards), default=-1) + 1
    return [*shards, Shard(f"region-of-{number}", f"rack-of-{number}", number)]
