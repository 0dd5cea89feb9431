"""From a table to training and test rows with numeric features."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.columns import as_text, col, is_numeric
from ..functions.ordering import INDEX, bucketed, with_row_index
from ..functions.quantiles import values_at_ranks
from ..functions.sampling import HASH, row_hash, split_exactly
from ..functions.values import most_frequent_of, value_counts
from ..operators.encoding import CODE, Codes, category_codes, with_code

# fixed values: defaults of the training form
TEST_SIZE, SEED, MISSING = 0.2, 48, "missing"
# rows of a class whose ranks one task may take
LARGE_CLASS = 1_000_000


@F.udf(VectorUDT())
def sparse_vector(size, places, values):
    return SparseVector(size, places, values)


def choose_columns(df: DataFrame, target: str | None, excluded: list[str] | None = None,
                   clustering: bool = False) -> tuple[str | None, list[str]]:
    """Target and features: the last column is the target unless one is named; clustering has none."""
    if clustering:
        return None, [c for c in df.columns if c not in (excluded or [])]
    target = target or df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    return target, [c for c in df.columns if c != target and c not in (excluded or [])]


def test_rows(rows: int, test_size: float) -> int:
    """How many rows go to the test part: a share is rounded up, a number above one is a count."""
    return min(rows, int(test_size) if test_size > 1 else math.ceil(round(test_size * rows, 9)))


def split_rows(df: DataFrame, test_size: float = TEST_SIZE, train_size: float | None = None, seed: int = SEED,
               shuffle: bool = True, stratify: str | None = None, order_by=None,
               key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of exact sizes.

    Shuffled splits take the rows with the smallest seeded hashes for the test, in
    total or per class; an unshuffled split takes the last rows by ``order_by``.
    ``key`` names columns identifying a row, needed for exact classes among copies.
    """
    rows = df.count()
    n_test = test_rows(rows, test_size)
    if not shuffle:
        numbered = with_row_index(ordered := bucketed(df, order_by))
        cut = rows - n_test
        n_train = cut if train_size is None else min(cut, _train_rows(rows, train_size))
        index = F.col(INDEX)
        return (ordered.restore(numbered.filter((index >= cut - n_train) & (index < cut))),
                ordered.restore(numbered.filter(index >= cut)))
    if stratify:
        test, train = _stratified(df, stratify, n_test, rows, seed, key)
    else:
        test, train = split_exactly(df, n_test, seed, rows, key)
    if train_size is not None:
        train = split_exactly(train, _train_rows(rows, train_size), seed + 1, rows - n_test, key)[0]
    return train, test


def _train_rows(rows: int, train_size: float) -> int:
    return int(train_size) if train_size > 1 else int(math.floor(round(train_size * rows, 9)))


def _quotas(counts: list[int], wanted: int) -> list[int]:
    """Shares of ``wanted`` in proportion to counts, largest remainders rounded up."""
    total = sum(counts)
    exact = [wanted * c / total for c in counts]
    quotas = [int(e) for e in exact]
    order = sorted(range(len(counts)), key=lambda i: (quotas[i] - exact[i], i))
    for i in order[:wanted - sum(quotas)]:
        quotas[i] += 1
    return quotas


def _stratified(df: DataFrame, label: str, wanted: int, rows: int, seed: int, key) -> tuple[DataFrame, DataFrame]:
    """Each class gives its quota of smallest hashes: a cut-off for a large class, a rank among the rows of a small one."""
    classes = value_counts(df, label).orderBy("value").collect()
    quotas = _quotas([r["count"] for r in classes], wanted)
    hashed = df.withColumn(HASH, row_hash(df, seed, key))
    shares = list(zip(classes, quotas))
    large = [(r, q) for r, q in shares if r["count"] > LARGE_CLASS]
    if len(large) < len(shares):
        return _ranked(hashed, label, [(r["value"], q) for r, q in shares if r["count"] <= LARGE_CLASS], large)
    used = [(r, q) for r, q in large if q]
    chosen = _cut(hashed, label, used)
    return hashed.filter(chosen).drop(HASH), hashed.filter(~chosen).drop(HASH)


def _ranked(hashed: DataFrame, label: str, small: list[tuple], large: list[tuple]) -> tuple[DataFrame, DataFrame]:
    quotas = hashed.sparkSession.createDataFrame(
        small, T.StructType([T.StructField("__value", hashed.schema[label].dataType), T.StructField("__quota", T.LongType())]))
    is_large = F.lit(False)
    for r, _ in large:
        is_large = is_large | col(label).eqNullSafe(F.lit(r["value"]))
    rest = hashed.filter(~is_large)
    # a second hash over all columns orders rows with equal keys; what is still tied are copies
    names = [c for c in hashed.columns if c != HASH]
    order = Window.partitionBy(col(label)).orderBy(HASH, F.xxhash64(*[col(c) for c in names]))
    ranked = (rest.withColumn("__rank", F.row_number().over(order))
              .join(quotas, col(label).eqNullSafe(F.col("__value"))))
    inside = F.col("__rank") <= F.col("__quota")
    test, train = (ranked.filter(c).select(*[col(n) for n in names]) for c in (inside, ~inside))
    if large:
        chosen = _cut(hashed, label, [(r, q) for r, q in large if q])
        test = test.unionByName(hashed.filter(is_large & chosen).drop(HASH))
        train = train.unionByName(hashed.filter(is_large & ~chosen).drop(HASH))
    return test, train


def _cut(hashed: DataFrame, label: str, used: list[tuple]):
    """Whether a row is among its class's quota, by the order statistic of the hashes."""
    mine = [col(label).eqNullSafe(F.lit(r["value"])) for r, _ in used]
    cuts = values_at_ranks(hashed, [(F.when(m, F.col(HASH)), r["count"], q - 1) for m, (r, q) in zip(mine, used)])
    chosen = F.lit(False)
    for m, cut in zip(mine, cuts):
        chosen = chosen | (m & (F.col(HASH) <= cut))
    return chosen


@dataclass
class Flags:
    """The values of a text column after the first, in order; a flag each. Many values are a table."""
    codes: Codes

    @property
    def count(self) -> int:
        return max(0, self.codes.count - 1)

    @cached_property
    def values(self) -> list:
        """For results with a column for each of them; a large table comes to the driver only here."""
        if self.codes.values is not None:
            return self.codes.values[1:]
        return [r[0] for r in self.codes.table.filter(F.col(CODE) > 0).orderBy(CODE).select("word").collect()]

    def numbered(self, df: DataFrame, word: str, index: str) -> DataFrame:
        """Add the number of each row's value; values without a flag share the number after the last."""
        codes = self.codes if self.codes.table is None else Codes(self.codes.count, table=self.codes.table.withColumnRenamed("word", word))
        coded = with_code(df, word, codes)
        return coded.withColumn(index, F.when(F.col(CODE) > 0, F.col(CODE) - 1).otherwise(self.count).cast("double")).drop(CODE)


@dataclass
class FeatureRules:
    """How raw columns become numbers: fill values and the categories that get a flag."""
    numeric: dict[str, float]
    text: dict[str, tuple[str, Flags]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}_{v}" for c, (_, flags) in self.text.items() for v in flags.values]]

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        numbers = [F.coalesce(col(c).cast("double"), F.lit(fill)).alias(c) for c, fill in self.numeric.items()]
        flags = [(F.coalesce(as_text(df, c), F.lit(fill)) == F.lit(v)).cast("double").alias(f"{c}_{v}")
                 for c, (fill, flags) in self.text.items() for v in flags.values]
        return df.select(*[col(c) for c in keep], *numbers, *flags)

    def vectors(self, df: DataFrame, keep: list[str], into: str = "features", described: bool = True) -> DataFrame:
        """The same features as one vector, sparse where text columns have values: no column per value.

        Columns get names of their own on the way, as shown names may hold any character. The library describes each
        feature in the schema, for trees to know flags from numbers; with many values that outgrows the driver. Vectors
        that are not ``described`` carry their size alone once a text column has a table of values.
        """
        if not described and any(flags.codes.table is not None for _, flags in self.text.values()):
            return self._sparse(df, keep, into)
        numbers = [F.coalesce(col(c).cast("double"), F.lit(fill)) for c, fill in self.numeric.items()]
        words = [F.coalesce(as_text(df, c), F.lit(fill)).alias(f"__word{i}") for i, (c, (fill, _)) in enumerate(self.text.items())]
        out = df.select(*[col(c) for c in keep], (array_to_vector(F.array(*numbers)) if numbers else F.lit(None)).alias("__numbers"), *words)
        parts = ["__numbers"] if numbers else []
        for i, (_, flags) in enumerate(self.text.values()):
            if not flags.count:
                continue
            # the encoder takes its size from the greatest number, that of words without a flag, which gets none
            encoder = OneHotEncoder(inputCols=[f"__index{i}"], outputCols=[f"__flags{i}"], dropLast=True)
            greatest = out.sparkSession.createDataFrame([(float(flags.count),)], f"__index{i} double")
            out = encoder.fit(greatest).transform(flags.numbered(out, f"__word{i}", f"__index{i}"))
            parts.append(f"__flags{i}")
        if not parts:
            raise ValueError("no features are left")
        joined = VectorAssembler(inputCols=parts, outputCol="__features").transform(out)
        return joined.select(*[col(c) for c in keep], F.col("__features").alias(into))

    def _sparse(self, df: DataFrame, keep: list[str], into: str) -> DataFrame:
        """Vectors from the places and values that are not zero."""
        places = [F.coalesce(col(c).cast("double"), F.lit(fill)) for c, fill in self.numeric.items()]
        places = [F.when(v != 0, F.struct(F.lit(i).alias("place"), v.alias("value"))) for i, v in enumerate(places)]
        words = [F.coalesce(as_text(df, c), F.lit(fill)).alias(f"__word{i}") for i, (c, (fill, _)) in enumerate(self.text.items())]
        out, size = df.select(*[col(c) for c in keep], F.array(*places).alias("__places"), *words), len(places)
        flagged = []
        for i, (_, flags) in enumerate(self.text.values()):
            out = flags.numbered(out, f"__word{i}", f"__index{i}")
            index = F.col(f"__index{i}").cast("int")
            flagged.append(F.when(index < flags.count, F.struct((index + size).alias("place"), F.lit(1.0).alias("value"))))
            size += flags.count
        places = F.array_compact(F.concat("__places", F.array(*flagged)) if self.numeric else F.array(*flagged))
        out = out.select(*[col(c) for c in keep], places.alias("__places"))
        vector = sparse_vector(F.lit(size), F.col("__places")["place"], F.col("__places")["value"])
        return out.select(*[col(c) for c in keep], vector.alias(into, metadata={"ml_attr": {"num_attrs": size}}))


def feature_rules(df: DataFrame, features: list[str]) -> FeatureRules:
    """Means for numbers, the lowest mode for text, one flag per text value after the first."""
    numeric = [c for c in features if is_numeric(df, c) or isinstance(df.schema[c].dataType, T.BooleanType)]
    row = df.agg(F.count(F.lit(1)), *[F.avg(col(c).cast("double")) for c in numeric]).first()
    fills = {c: float(m) if m is not None else 0.0 for c, m in zip(numeric, row[1:])}
    texts = [c for c in features if c not in numeric]
    words = df.select(*[as_text(df, c).alias(f"w{i}") for i, c in enumerate(texts)])
    modes = most_frequent_of(words, words.columns) if texts else {}
    text = {c: (modes[f"w{i}"] or MISSING, Flags(category_codes(words.select(F.col(f"w{i}").alias("word")), {"column": "word"}))) for i, c in enumerate(texts)}
    return FeatureRules(fills, text)


@dataclass
class Prepared:
    """Training and test rows of ``target`` and features, as tables with a column per feature or as vectors."""
    target: str
    rules: FeatureRules
    #: the parts before features were built
    rows: tuple[DataFrame, DataFrame]

    @property
    def train(self) -> DataFrame:
        return self.rules.apply(self.rows[0], [self.target])

    @property
    def test(self) -> DataFrame:
        return self.rules.apply(self.rows[1], [self.target])

    @property
    def features(self) -> list[str]:
        return self.rules.names

    def vectors(self, described: bool = True) -> tuple[DataFrame, DataFrame]:
        """Training and test rows as ``label`` and ``features``, for models."""
        return tuple(self.rules.vectors(part, [self.target], described=described).select(col(self.target).cast("double").alias("label"), "features")
                     for part in self.rows)


def prepare(df: DataFrame, target: str | None = None, excluded: list[str] | None = None, leaky: bool = False,
            **split) -> Prepared:
    """Training and test tables of the target and numeric features.

    Rows without a target go. Fill values and categories come from the training
    rows; ``leaky=True`` takes them from all rows before the split.
    """
    target, features = choose_columns(df, target, excluded)
    rows = df.filter(col(target).isNotNull())
    # only what the model, the split's row identity and its order need
    needed = [target, *features, *(split.get("key") or [])]
    order = split.get("order_by")
    needed += [order] if isinstance(order, str) else list(order or [])
    rows = rows.select(*[col(c) for c in dict.fromkeys(needed)])
    train, test = split_rows(rows, **split)
    rules = feature_rules(rows if leaky else train, features)
    return Prepared(target, rules, (train, test))
