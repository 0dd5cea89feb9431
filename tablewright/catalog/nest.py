"""Nested data from the tables: folded to JSON, typed, flattened and rebuilt."""

from pyspark.sql import functions as F

from ..functions.nested import flattened, nested, parsed_json, unnested
from .base import query, table


def _folded(spark, sf_dir):
    """A JSON text per conversation; turns of the user have a length, others have a mark."""
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.struct(
        "turn", "role", "text", F.when(F.col("role") == "user", F.struct(F.length("text").alias("chars"))).alias("user"),
        F.when(F.col("role") != "user", F.col("turn") % 3 == 0).alias("third")))
    by_turn = turns.select("conv_id", "turn", "said")
    lists = nested(by_turn, "conv_id", "said", "turn")
    return lists.select("conv_id", F.to_json(F.struct(F.lit(1).alias("version"), F.col("said").alias("turns"))).alias("doc"))


@query("turns_from_json", """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, turn, role, text,
       CASE WHEN role = 'user' THEN CAST(length(text) AS BIGINT) END AS chars, CASE WHEN role <> 'user' THEN turn % 3 = 0 END AS third
FROM conversations""")
def _turns(spark, sf_dir):
    docs = parsed_json(_folded(spark, sf_dir), "doc")
    flat = flattened(flattened(unnested(docs.select("conv_id", F.col("doc.turns").alias("said")), "said")))
    return flat.select("conv_id", "position", *[F.col(f"`said.{c}`").alias(c) for c in ("turn", "role", "text")],
                       F.col("`said.user.chars`").alias("chars"), F.col("`said.third`").alias("third"))


@query("event_properties", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def _properties(spark, sf_dir):
    return flattened(parsed_json(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), "props"))


@query("roles_of_conversations", """
SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id""")
def _roles(spark, sf_dir):
    spread = unnested(parsed_json(_folded(spark, sf_dir), "doc").select("conv_id", F.col("doc.turns").alias("said")), "said")
    again = nested(spread, "conv_id", "said")
    shown = F.transform("said", lambda t: F.concat(t["role"], F.lit(":"), F.length(t["text"]).cast("string")))
    return again.select("conv_id", F.array_join(shown, ",").alias("roles"), F.size("said").cast("long").alias("turns"))
