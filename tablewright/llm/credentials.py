"""Secret scans: candidate strings judged by a random forest that was trained on labelled findings."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.lookup import broadcast_if_small
from .store import frequent, stored, unused
from .words import Block, Hasher, packed_strings, portions

#: a candidate is a run of these characters with a digit and a letter, anything assigned to a name that holds a telling
#: word, or the password of a URL
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LEAST_RUN, LEAST_ASSIGNED = 12, 6
#: where a run goes over from a name to its value
SIGN_IN_RUN = re.compile(r"(?<=[A-Za-z0-9_-])=+(?=[^=])")
#: up to where the value begins; names are taken whole, so that long words are read once
ASSIGNED = re.compile(r"""(?i)(?<![\w.-])(?=[\w.-]*?(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential))"""
                      r"""[\w.-]++\\?["']?\]?\s*+(?:=>|:=|==?|:)\s*+\\?["']?(?:(?:bearer|basic|digest|token)\s++)?""")
VALUE = re.compile(r"""[^\s"'<>]{6,}""")
URL_PASSWORD = re.compile(r"""://[^\s/:@"'<>]*+:([^\s/"'<>]+)@""")
HINT = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential")
WORD = re.compile(r"[A-Za-z]+")
#: how far to either side the words around a candidate are read
AROUND = 80
#: words that tell secrets from identifiers, one flag each
NEIGHBOURS = ("token", "secret", "password", "passwd", "key", "api", "access", "auth", "bearer", "credential", "private",
              "commit", "sha", "md5", "checksum", "hash", "digest", "uuid", "id", "version", "example", "test", "sample",
              "image", "png", "file", "url", "http", "href", "order", "isbn", "integrity", "placeholder", "your")
#: other neighbouring words share so many hashed flags
HASHED = 16
SHAPES = ("length", "digits", "upper", "lower", "other", "distinct", "entropy", "hex", "changes", "vowels", "coverage",
          "slashes", "after_slash", "before_dot", "in_url", "assigned", "quoted")
N_FEATURES = len(SHAPES) + len(NEIGHBOURS) + HASHED
#: size of the dictionary, and of the set of planted findings a forest is trained on where none are given
DICTIONARY = 20_000
PLANTED_DOCUMENTS = 1500
PLANTED_IN_EACH = 10
TREES, DEPTH = 40, 10
LEAST_SCORE = 0.5


def _mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _runs(text: str):
    """Runs with a digit and a letter; one of a name, ``=`` and a value gives the value, and the name if it is as long as a run."""
    for m in RUN.finditer(text):
        run, (start, stop) = m.group(), m.span()
        if not _mixed(run):
            continue
        sign = SIGN_IN_RUN.search(run)
        parts = []
        if sign:
            name, value = run[:sign.start()], run[sign.end():]
            if len(name) >= LEAST_RUN and _mixed(name):
                parts.append((start, start + len(name)))
            if len(value) >= LEAST_ASSIGNED and _mixed(value):
                parts.append((start + sign.end(), stop))
        yield from parts or [(start, stop)]


def _assigned(text: str):
    """Values of telling names, each up to a space, quote or angle bracket; assignments inside a value are part of it."""
    stop = 0
    for m in ASSIGNED.finditer(text):
        value = VALUE.match(text, m.end()) if m.end() >= stop else None
        if value:
            yield value.span()
            stop = value.end()


def candidates(text: str) -> list[tuple[int, int]]:
    """Character ranges of the candidates of a text, in order, none overlapping."""
    found = []
    if re.search("[0-9]", text):
        found += _runs(text)
    if HINT.search(text):
        found += _assigned(text)
    if "://" in text:
        found += [m.span(1) for m in URL_PASSWORD.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _coverage(value: str, dictionary: set[str]) -> float:
    """Share of the characters inside dictionary words of 4 to 12 letters, longest first from the left."""
    covered = k = 0
    low = value.lower()
    while k < len(low):
        for n in range(min(12, len(low) - k), 3, -1):
            if low[k:k + n] in dictionary:
                covered, k = covered + n, k + n
                break
        else:
            k += 1
    return covered / max(1, len(low))


def described(text: str, start: int, stop: int, dictionary: set[str]) -> list[float]:
    """The features of a candidate: shape, character transitions, dictionary coverage, path and neighbouring words."""
    value = text[start:stop]
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = [kinds.count(k) / n for k in range(4)]
    each = [value.count(c) / n for c in set(value)]
    letters = [c for c in value.lower() if c.isalpha()]
    before, after = text[max(0, start - AROUND):start], text[stop:stop + AROUND]
    token = re.search(r"\S*$", before).group()
    near = [w.lower() for w in WORD.findall(before)[-4:]] + [w.lower() for w in WORD.findall(after)[:2]]
    hashed = [0.0] * HASHED
    for w in near:
        if w not in NEIGHBOURS:
            hashed[hashlib.md5(w.encode()).digest()[0] % HASHED] = 1.0
    return [
        float(n), *counts, len(set(value)) / n, -sum(p * math.log2(p) for p in each),
        float(all(c in "0123456789abcdefABCDEF" for c in value)), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(c in "aeiou" for c in letters) / max(1, len(letters)), _coverage(value, dictionary),
        float((token + value).count("/")), float(before[-1:] in ("/", "\\", "#", "?")), float(after[:1] == "."),
        float("://" in token or token.startswith(("www.", "data:"))), float(bool(re.search(r"(=|:)\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]),
        *(float(w in near) for w in NEIGHBOURS), *hashed]


def _word_counts(batches):
    hasher = Hasher()
    for batch in batches:
        for _, _, texts in portions(batch.column(0)):
            block = Block(texts)
            length = block.ends - block.starts
            some = (length >= 4) & (length <= 12)
            starts, ends = block.starts[some], block.ends[some]
            _, first, n = np.unique(hasher(block.data, starts, ends), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([packed_strings(block.data, starts[first], ends[first]), pa.array(n)], names=["word", "n"])


def dictionary_of(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> set[str]:
    """The most frequent words of 4 to 12 bytes, counted over all texts: at most ``size``, none that ties with one left out."""
    counted = docs.select(text_col).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return set(frequent(stored(counted, "words"), size).select("word").toArrow()["word"].to_pylist())


def _scan(shared):
    """All candidates of each text with their features."""
    def scan(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for start, stop in candidates(text) if text else ():
                    at.append(i)
                    rows.append((start, stop, hashlib.sha256(text[start:stop].encode()).hexdigest(),
                                 described(text, start, stop, shared.value)))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
                names=["id", "start", "stop", "value_sha256", "features"])
    return scan


def scanned(docs: DataFrame, dictionary: set[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, stop, value_sha256, features)`` for every candidate; ranges count characters from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(shared), f"id {dict(docs.dtypes)[id_col]}, start int, stop int, value_sha256 string, features array<double>")


HEX, ALPHA = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PUNCTUATION = "!#$%^&*.-_~@+?"


def planted(text: str, seed: int) -> list[tuple[str, int, int, bool]]:
    """Labelled findings for training: the text with a made-up secret or a lookalike between two of its words.

    Values are random; the words around them are the text's own. ``(text, start, stop, is_secret)``, where the range is
    what ``candidates`` cuts out there, as in a scan.
    """
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    words = text.split(" ")
    word = lambda: re.sub(r"[^A-Za-z]", "", words[int(rng.integers(0, len(words)))]).lower() or "item"
    name = str(rng.choice(["token", "secret", "api_key", "apikey", "access_token", "auth_token", "password", "client_secret",
                           "DB_PASSWORD", "db.password", "github_token", "secretKey", "AUTH_TOKEN_PROD", "smtp_passwd"]))
    sign, quote = str(rng.choice([" = ", "=", ": ", ":"])), str(rng.choice(['"', "'", ""]))
    size = int(rng.choice([24, 32, 40, 64]))
    uuid = "-".join(pick(HEX, n) for n in (8, 4, 4, 4, 12))
    odd = pick(ALPHA, 3) + pick("0123456789", 1) + pick(PUNCTUATION, 1) + pick(ALPHA + PUNCTUATION, int(rng.integers(2, 14)))
    pieces = [pick(ALPHA, int(n)) for n in rng.integers(2, 5, 3)] + [pick("0123456789", 2)]
    parted = "".join(pieces[int(i)].lower() + pick(PUNCTUATION, 1) * (k < 3) for k, i in enumerate(rng.permutation(4)))
    long = pick(ALPHA + "._-", int(rng.integers(200, 600)))
    made = [
        (f"{name}{sign}{quote}", pick(HEX, size), quote, True), (f"{name}{sign}{quote}", pick(ALPHA, size), quote, True),
        (f"{name}{sign}{quote}", pick(ALPHA + "+/", size) + "=", quote, True), ("aws key ", "AKIA" + pick(ALPHA[:26] + "234567", 16), "", True),
        (f"{name}{sign}{quote}", "ghp_" + pick(ALPHA, 36), quote, True), ("Authorization: Bearer ", "eyJ" + pick(ALPHA, size), "", True),
        (f"password{sign}{quote}", pick(ALPHA, 10) + pick("0123456789", 2), quote, True),
        (f"{name}{sign}{quote}", odd, quote, True), (f"{name}{sign}{quote}", parted, quote, True), (f"{name}{sign}{quote}", long, quote, True),
        (f"{name}{sign}{quote}", pick(ALPHA, 6) + pick("0123456789", 2), quote, True),
        (f"{word()}://{word()}:", odd, f"@{word()}.example.com/{word()}", True), (f"postgres://{word()}:", pick(ALPHA, 8) + pick("0123456789", 1), "@db:5432/x", True),
        ("commit ", pick(HEX, 40), "", False), ("sha256 checksum ", pick(HEX, 64), "", False), ("md5 ", pick(HEX, 32), "", False),
        (f"uuid{sign}{quote}", uuid, quote, False), ("id ", uuid, "", False), ("data:image/png;base64,", pick(ALPHA + "+/", size), "", False),
        (f"https://{word()}.example.com/", f"{word()}-{word()}-{pick('0123456789', 4)}", "", False),
        ("see file /", f"{word()}/{word()}_{pick('0123456789', 3)}", ".txt", False),
        ("", f"{word()}{word()}{word()}{pick('0123456789', 4)}", "", False), (f"{name}{sign}{quote}", f"your_{name}_here_123", quote, False),
        (f"{name}{sign}{quote}", "x" * size, quote, False), (f"{name}{sign}{quote}", f"example{word()}{word()}1", quote, False),
        ("", f"{word()}_{word()}_{word()}_{pick('0123456789', 2)}", "", False),
        (f"{name}{sign}{quote}", word(), quote, False), (f"{name}{sign}", f"{word()}.{word()}({word()})", "", False),
        ("author: ", word(), "", False), ("passenger: ", word(), "", False), (f"max_tokens{sign}", pick("0123456789", 6), "", False),
        (f"{word()}={word()}", pick("0123456789", 6), "", False), (f"https://{word()}:{word()}", "", f"@{word()}.example.com/", False),
    ]
    out = []
    for k in rng.choice(len(made), PLANTED_IN_EACH, replace=False):
        before, value, after, secret = made[int(k)]
        if rng.random() < 0.15:  # shouted like any other text
            before, value = before.upper(), value.upper() if set(value) <= set(HEX + "-") else value
        at = int(rng.integers(0, len(words) + 1))
        head = " ".join(words[:at])
        head += " " * bool(head) + before
        tail = after + str(rng.choice(["", ".", "!!", "###", ","])) * (after != "" or quote == "") + " " + " ".join(words[at:])
        whole, start, stop = head + value + tail, len(head), len(head) + len(value)
        out += [(whole, a, b, secret) for a, b in candidates(whole) if a < stop and b > start]
    return out


def _planted_rows(batches):
    for batch in batches:
        rows = []
        for text, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += planted(text or "", seed & 0x7FFFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.string(), pa.int32(), pa.int32(), pa.bool_()))], names=["text", "start", "stop", "is_secret"])


def planted_findings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = PLANTED_DOCUMENTS) -> DataFrame:
    """Labelled findings in about ``most`` documents chosen by hash (all of them, if there are fewer)."""
    total = docs.count()
    seed = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(9), text_col)).otherwise(F.xxhash64(F.lit(9), F.col(id_col)))
    rows = docs.select(F.col(text_col).alias("text"), seed.alias("seed"))
    rows = rows.where(F.pmod("seed", F.lit(2**32)) < int(min(1.0, most / max(1, total)) * 2**32))
    return rows.mapInArrow(_planted_rows, "text string, start int, stop int, is_secret boolean")


def _labelled_features(shared):
    def labelled(batches):
        for batch in batches:
            rows = [(described(t, a, b, shared.value), float(y)) for t, a, b, y in
                    zip(*(batch.column(c).to_pylist() for c in ("text", "start", "stop", "is_secret"))) if t and y is not None and b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())),
                                              pa.array([r[1] for r in rows], pa.float64())], names=["features", "label"])
    return labelled


def train(labelled: DataFrame, dictionary: set[str]) -> RandomForestClassificationModel:
    """A forest on findings ``(text, start, stop, is_secret)``; rows without text, range or label are left out.

    Meant for a bounded table of reviewed findings; their features are put in one order, so the forest depends on the
    findings only, not on how they were spread.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.select("text", "start", "stop", "is_secret").mapInArrow(
        _labelled_features(spark.sparkContext.broadcast(dictionary)), "features array<double>, label double"), "findings")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("the labelled findings must hold secrets and others")
    ordered = rows.coalesce(1).sortWithinPartitions("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=2, seed=11)
    return forest.fit(ordered.select("label", array_to_vector("features").alias("features")))


def secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with its ``score`` and verdict: ``(id, start, stop, value_sha256, score, is_secret)``.

    The forest is trained on ``labelled`` findings, or without them on findings planted in documents of the table. The
    dictionary is counted over all texts, which are scanned whole. Values leave only as hashes. Null and empty texts
    have no candidates, repeated rows repeat theirs, an empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stored(scanned(rows, dictionary := dictionary_of(rows), "id"), "candidates")
    if found.isEmpty():
        return found.select(F.col("id").alias(id_col), "start", "stop", "value_sha256", F.lit(0.0).alias("score"), F.lit(False).alias("is_secret"))
    forest = train(labelled if labelled is not None else planted_findings(rows, "text", "id"), dictionary)
    scored = forest.transform(found.withColumn("features", array_to_vector("features")))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 9)
    return scored.select(F.col("id").alias(id_col), "start", "stop", "value_sha256", score.alias("score"), (score >= LEAST_SCORE).alias("is_secret"))


def redacted(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each secret replaced by ``[SECRET]``; all rows stay, and texts without secrets as they are.

    Null and empty texts stay, repeated rows are all cut, rows without id are told apart by a hash of their texts, an
    empty table stays empty, and other columns pass, whatever their names.
    """
    key, = unused(docs, "key")
    marked = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    found = secrets(marked, labelled, key, text_col).where("is_secret")
    spans = (found.groupBy(F.col(key).alias("key")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
             .select(F.struct(F.col("key.id").alias("id"), F.col("key.h").alias("h"), "spans").alias("cut")))
    cut, = unused(marked, "cut")
    spans = stored(spans.withColumnRenamed("cut", cut), "spans")
    # few documents hold secrets; while their spans are small, the texts are not shuffled to meet them
    joined = marked.join(broadcast_if_small(spans), marked[key]["id"].eqNullSafe(F.col(f"{cut}.id")) & (marked[key]["h"] == F.col(f"{cut}.h")), "left")
    spans_of = F.col(cut)["spans"]
    return joined.select(*[F.when(spans_of.isNotNull(), _redact(F.col(text_col), spans_of)).otherwise(F.col(c)).alias(c)
                           if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _redact(text, spans):
    """Pieces between the ordered spans, joined by the mark."""
    edges = F.array_sort(spans)
    pieces = F.transform(F.sequence(F.lit(0), F.size(edges)), lambda i: F.substring(
        text, F.when(i == 0, F.lit(0)).otherwise(F.get(edges, i - 1)["stop"]) + 1,
        F.when(i == F.size(edges), F.length(text)).otherwise(F.get(edges, i)["start"])
        - F.when(i == 0, F.lit(0)).otherwise(F.get(edges, i - 1)["stop"])))
    return F.array_join(pieces, "[SECRET]")
