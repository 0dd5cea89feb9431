"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame``."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_near_duplicates")
def _near_duplicates(spark, sf_dir):
    from .neardup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_contamination", sql="""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS width,
           array_to_string(w[i + 1:i + least(13, len(w))], ' ') AS part
    FROM item, unnest(range(greatest(1, len(w) - 12))) AS r(i) WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
    SELECT doc_id, i, width, array_to_string(w[i + 1:i + width], ' ') AS part
    FROM doc, widths, unnest(range(greatest(0, len(w) - width + 1))) AS r(i)),
found AS (SELECT doc_id, item_id, i, p.width FROM places p JOIN windows s ON p.part = s.part AND p.width = s.width),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS spot FROM found) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)""")
def _contamination(spark, sf_dir):
    from .contamination import contamination, is_contaminated
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


@query("op5_quality")
def _quality(spark, sf_dir):
    from .quality import held_out, quality
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_toxicity")
def _toxicity(spark, sf_dir):
    from .quality import held_out
    from .toxicity import toxicity
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_bpe")
def _bpe(spark, sf_dir):
    from .bpe import encode
    ids = encode(table(spark, sf_dir, "documents"), outputs=("packed", "decoded"))
    return ids.select("doc_id", F.expr("octet_length(packed) div 4").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


#: the registered topology: 40 shards in 4 regions of 2 racks; the grown one has a fifth region for shard 40
_DRAWS = """SELECT d.key, t.parent, t.child, t.node, -ln((CAST('0x' || substr(md5(d.key || '|' || t.node), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / t.weight AS draw
            FROM (SELECT DISTINCT key FROM doc) d JOIN tree t ON t.level = {level} AND t.grown = {grown} {where}"""


def _sharding_sql() -> str:
    from .sharding import grown_by_one, topology, tree
    base = topology(40, 4, 2)
    rows = [(g, k, p, n, w, i) for g, shards in enumerate((base, grown_by_one(base))) for k, level in enumerate(tree(shards))
            for p, children in enumerate(level) for n, w, i in children]
    values = ", ".join(f"({g}, {k}, {p}, '{n}', {w}, {i})" for g, k, p, n, w, i in rows)
    parts = []
    for g in (0, 1):
        for k in range(3):
            where = f"JOIN l{g}{k - 1} u ON u.key = d.key AND u.child = t.parent" if k else ""
            parts.append(f"l{g}{k} AS (SELECT key, arg_min(child, (draw, node)) AS child FROM ({_DRAWS.format(level=k, grown=g, where=where)}) GROUP BY key)")
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
tree(grown, level, parent, node, weight, child) AS (VALUES {values}),
{", ".join(parts)},
step(n, c, k) AS (
    SELECT n, n, 0 FROM range(256) AS r(n)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM (SELECT n, CAST(c AS BIGINT) AS c, k FROM step) WHERE k < 8),
crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY n) AS t FROM step WHERE k = 8),
summed AS (
    SELECT doc_id, key, text, strlen(coalesce(text, '')) + 16 AS size,
           CASE WHEN text IS NOT NULL THEN xor(list_reduce(
               list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
               lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) END AS crc
    FROM doc, crc),
parted AS (
    SELECT *, CAST('0x' || substr(md5(key || '|' || CAST(size AS VARCHAR) || '|' || coalesce(CAST(crc AS VARCHAR), '')), 1, 4) AS INTEGER) % 1024 AS part
    FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(b.child AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY b.child ORDER BY part, doc_id NULLS FIRST, size, crc NULLS FIRST) - 1 AS slot, CAST(g.child AS INTEGER) AS grown_shard
FROM parted JOIN l02 b USING (key) JOIN l12 g USING (key)"""


@query("op1_sharding", sql=_sharding_sql())
def _sharding(spark, sf_dir):
    from .sharding import grown_by_one, sharded, topology
    base = topology(40, 4, 2)
    return sharded(table(spark, sf_dir, "documents"), base, grown_by_one(base))


@query("op4_token_counts")
def _token_counts(spark, sf_dir):
    from .lengths import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def _quality_rules(spark, sf_dir):
    from .rules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _licenses_sql() -> str:
    """Exact containment over all windows of the grid, without MinHash."""
    from .licenses import TEMPLATES, TENTHS, read_templates
    known = read_templates(TEMPLATES)
    rows = ", ".join(f"({t.number}, '{t.license}', {len(t.shingles)}, {t.width}, {t.stride}, '{s}')" for t in known for s in t.shingles)
    return f"""
WITH t(template, license, n, width, stride, shingle) AS (VALUES {rows}),
doc AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w
        FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS shingle FROM doc, unnest(range(greatest(0, len(w) - 4))) AS r(i)),
found AS (SELECT DISTINCT doc_id, template, license, n, k * stride AS start, shingle
          FROM places JOIN t USING (shingle),
               unnest(range(greatest(0, CAST(ceil((i + 5 - width) / stride) AS BIGINT)), i // stride + 1)) AS r(k)),
held AS (SELECT doc_id, template, license, start, count(*) / n AS containment FROM found
         GROUP BY doc_id, template, license, n, start HAVING count(*) * 10 >= n * {TENTHS})
SELECT doc_id, license, CAST(template AS INTEGER) AS template, max(containment) AS containment,
       CAST(arg_min(start, (-containment, start)) AS INTEGER) AS start
FROM held GROUP BY doc_id, license, template"""


@query("op10_licenses", sql=_licenses_sql())
def _licenses(spark, sf_dir):
    from .licenses import license_matches
    return license_matches(table(spark, sf_dir, "documents"))


@query("op9_secrets")
def _secrets(spark, sf_dir):
    from .credentials import secrets
    return secrets(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def _alignment(spark, sf_dir):
    from .alignment import link_support
    return link_support(table(spark, sf_dir, "documents"))


@query("op12_fill_in_middle", sql="""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
drawn AS (
    SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90
                THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM doc),
cut AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
           array_to_string(u[greatest(a, b) + 1:], '') AS suffix
    FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut""")
def _fill_in_middle(spark, sf_dir):
    from .middles import fill_in_middle
    return fill_in_middle(table(spark, sf_dir, "documents"), outputs=("digests",))


@query("op11_nearest")
def _nearest(spark, sf_dir):
    from .collisions import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
