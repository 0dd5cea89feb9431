"""Quality rules: text statistics and decision lists learned from labels, as Spark expressions throughout."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
#: cut points per statistic between its ends; towards either end they halve the rest down to the rarest share
CUTS = 64
RAREST = 2.0**-16
#: a rule must cover so many rejected rows of the growing part, and be right this often on the pruning part
LEAST_ROWS = 3
LEAST_PRECISION = 0.8

FEATURES = ("n_words", "mean_chars", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "distinct_share")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside any window of ``WINDOW`` words that the text holds twice or more, the first included."""
    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_pairs(p: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(p, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | same(x, k + 1))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
            return F.aggregate(starts, empty, lambda a, s: F.struct(
                (a["n"] + s + WINDOW - F.greatest(s, a["reach"])).alias("n"), (s + WINDOW).alias("reach")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, of_pairs)).otherwise(0)

    def of_words(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) > WINDOW, let(hashes, of_hashes)).otherwise(0)
    return let(words, of_words).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts over its words ``[^\\x20\\x09-\\x0D]+`` and lines, and shares derived from them.

    Null and empty texts have no words; all their counts are 0 and their shares too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.array_remove(F.split(text, SPACE + "+"), "").alias("words"), lines.alias("lines"))
    counted = rows.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), _repeat_words(F.col("words")).alias("n_repeat_words"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.select(
        "*", share("word_chars", "n_words").alias("mean_chars"), share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_distinct", "n_words").alias("distinct_share"))


def base_failed() -> Column:
    """The fixed rules: under 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = list[Condition]


def _all(rule: Rule) -> Column:
    return reduce(Column.__and__, (c.column() for c in rule), F.lit(True))


def _cuts(rows: DataFrame, features: tuple[str, ...]) -> dict[str, list[float]]:
    """Cut points of each feature at its quantiles, from one aggregate over all rows."""
    tails = [2.0**-k for k in range(7, 1 - round(math.log2(RAREST)))]
    at = sorted({*(k / CUTS for k in range(CUTS)), *tails, *(1 - t for t in tails)})
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 200_000).alias(f) for f in features]).first()
    return {f: sorted(set(found[f] or [])) for f in features}


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cut points a feature is above."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(feature) > c))


def _best(rows: DataFrame, cuts: dict[str, list[float]], rejected: int, kept: int) -> Condition | None:
    """The condition of greatest information gain, from one pass that counts both labels per feature and bin."""
    bins = [F.struct(F.lit(f).alias("feature"), _bin(f, cs).alias("bin")) for f, cs in cuts.items() if cs]
    counts = (rows.select("rejected", F.inline(F.array(*bins))).groupBy("feature", "bin")
              .agg(F.sum("rejected").alias("r"), F.count("*").alias("n")).collect())
    before = math.log2(rejected / (rejected + kept))
    table = {(r.feature, r.bin): (r.r, r.n) for r in counts}
    best, gain = None, 1e-9
    for f, cs in sorted(cuts.items()):
        low_r = low_n = 0
        for k, cut in enumerate(cs):  # bin k holds the rows above k cut points
            r, n = table.get((f, k), (0, 0))
            low_r, low_n = low_r + r, low_n + n
            for above, p, total in ((False, low_r, low_n), (True, rejected - low_r, rejected + kept - low_n)):
                if p >= LEAST_ROWS and (got := p * (math.log2(p / total) - before)) > gain:
                    best, gain = Condition(f, above, cut), got
    return best


def _sums(rows: DataFrame, conditions: list[Column]) -> list[tuple[int, int]]:
    """Rejected and all rows under each condition, in one pass."""
    found = rows.agg(*[F.sum(F.when(c, F.lit(v)).otherwise(0)).alias(f"{name}{i}") for i, c in enumerate(conditions)
                       for name, v in (("r", F.col("rejected")), ("n", 1))]).first()
    return [(found[f"r{i}"] or 0, found[f"n{i}"] or 0) for i in range(len(conditions))]


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "id",
          features: tuple[str, ...] = FEATURES) -> list[Rule]:
    """An ordered list of rules that reject, by sequential covering over all labelled rows.

    Two thirds of the rows (by hash) grow a rule, condition by condition, until it covers no kept row or no condition
    tells the labels better apart; the rest prunes its last conditions away while that helps. Rows a rule covers leave;
    a rule that covers too few rows or is too often wrong ends the list, which has no other bound.
    Only counts per feature and bin reach the driver. Rows without id or label are left out, an id labelled twice
    counts with its smallest label. Without both labels the list is empty.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label")))
    rows = stored(stats.join(known, "id").select(*features, F.when(F.col("label") == 1, 0).otherwise(1).alias("rejected"),
                                                 (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).alias("grow")), "labelled")
    cuts = _cuts(rows, features)
    rules: list[Rule] = []
    left = rows
    while True:
        rule: Rule = []
        while True:
            mine = left.where(F.col("grow") & _all(rule))
            (rejected, n), = _sums(mine, [F.lit(True)])
            if rejected < LEAST_ROWS or rejected == n:
                break
            found = _best(mine, cuts, rejected, n - rejected)
            if found is None:
                break
            rule.append(found)
        if not rule:
            break
        prune = left.where(~F.col("grow"))
        worth = _sums(prune, [_all(rule[:k]) for k in range(1, len(rule) + 1)])
        value = [(2 * r - n) / n if n else -1.0 for r, n in worth]
        keep = max(range(len(rule)), key=lambda k: (value[k], -k))
        r, n = worth[keep]
        if not n or r / n < LEAST_PRECISION:
            break
        rules.append(rule[:keep + 1])
        left = left.where(~_all(rules[-1]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: one conditional expression, rules in their order."""
    out = F
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def quality_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    ``kept`` is false where the fixed rules fail or the learned list rejects. The list is fitted on the labels of rows
    that pass the fixed rules and whose crc32 of the id leaves no remainder 2 by 4. Null and empty texts have no words and fail. Repeated rows stay, an empty
    table gives an empty result, other columns are not read. Statistics are computed once and kept in the shared folder.
    """
    stats = stored(statistics(docs, id_col, text_col), "statistics")
    fitting = labels.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2).withColumnRenamed(id_col, "id")
    rules = learn(stats.where(~base_failed()), fitting, label_col)
    return stats.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
