"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .bpe import parsed_ranks, public_pattern, public_ranks, read_ranks
from .store import stored

#: lengths are summed in ranges of this width first
RANGE = 1024


def length_column(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """Number of tokens of a text column, over whole texts, without special tokens; null counts as empty."""
    spelled = pattern or public_pattern()
    shared = SparkSession.active().sparkContext.broadcast(read_ranks(ranks or public_ranks()))

    def lengths(texts: pa.Array) -> pa.Array:
        import tiktoken
        encode = tiktoken.Encoding("lengths", pat_str=spelled, mergeable_ranks=parsed_ranks(shared.value), special_tokens={}).encode_ordinary
        return pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in texts], pa.int64())
    lengths.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(lengths, "long")(text)


def suffix_sums(lengths: DataFrame, column: str = "length") -> DataFrame:
    """The histogram with what follows from it, one row per length that occurs.

    ``n_docs`` have exactly the length; ``docs_at_least`` and ``tokens_at_least`` sum over it and all greater ones;
    ``docs_at_most`` counts the rest and its own. ``truncated_tokens`` is the corpus total when every text is cut at
    this length. Rows with a null length are left out. The histogram is written once; only
    its rows, one per length, meet in a window.
    """
    histogram = stored(lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("length"))
                       .agg(F.count("*").alias("n_docs")).withColumn("range", F.expr(f"length div {RANGE}")), "lengths")
    ranges = histogram.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(F.expr("n_docs * length")).alias("tokens"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranges = ranges.select("range", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
                           F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
                           F.sum("docs").over(whole).alias("docs_all"), F.sum("tokens").over(whole).alias("tokens_all"))
    down = Window.partitionBy("range").orderBy(F.desc("length"))
    at_least = (histogram.join(ranges, "range")
                .withColumn("docs_at_least", F.col("docs_above") + F.sum("n_docs").over(down))
                .withColumn("tokens_at_least", F.col("tokens_above") + F.sum(F.expr("n_docs * length")).over(down)))
    return at_least.select("length", "n_docs", "docs_at_least", "tokens_at_least",
                           F.expr("docs_all - docs_at_least + n_docs").alias("docs_at_most"),
                           F.expr("tokens_all - tokens_at_least + docs_at_least * length").alias("truncated_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens of the corpus when every text is cut at ``limit``, any number of tokens."""
    row = sums.agg(
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("length") >= limit, F.col("length"))).alias("from"),
        F.max(F.struct("length", "truncated_tokens")).alias("longest"), F.max("tokens_at_least").alias("total")).first()
    if row.longest is None:
        return 0
    if row["from"] is None or row.longest.length < limit:
        return row.total
    return row.total - row["from"].tokens_at_least + row["from"].docs_at_least * limit


def length_quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the texts do not exceed."""
    docs = F.col("docs_at_least") + F.col("docs_at_most") - F.col("n_docs")
    return sums.where((F.col("docs_at_most") >= share * docs) & (F.col("docs_at_most") > 0)).agg(F.min("length")).first()[0]


def token_counts(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``suffix_sums`` over the encoded lengths of the texts.

    Null and empty texts have length 0 and are counted. Repeated rows count each. An empty table gives no rows. Other
    columns are not read.
    """
    return suffix_sums(docs.select(length_column(F.col(text_col), ranks, pattern).alias("length")))
