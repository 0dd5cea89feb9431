"""Benchmark decontamination over a positional inverted index, kept in segments of whole documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored, unused
from .words import Block, Hasher, packed_strings, portions

WINDOW = 13
#: a word is hit when a window covers it; a text with hits in at least one of so many words is contaminated
SHARE = 20
#: UTF-8 bytes of search terms that are sent to the tasks at once; larger sets go in several passes
QUERY_BYTES = 16 << 20

#: bytes of text in a segment, and the columns of one
SEGMENT_BYTES = 1 << 20
SEGMENT = ("first_words array<int>, n_words array<int>, terms array<string>, counts array<int>, positions array<int>")


def _segment(hasher: Hasher, texts: list[bytes]) -> dict[str, pa.Array]:
    """Postings of some texts: distinct terms, and for each the ascending word numbers in the segment.

    Texts are numbered through with a gap of one between them, so no phrase runs from one into the next.
    """
    block = Block(texts)
    n = len(block.starts)
    h = hasher(block.data, block.starts, block.ends)
    order = np.argsort(h, kind="stable")
    h, g = h[order], hasher(block.data, block.starts, block.ends, 1)[order]
    new = np.ones(n, dtype=bool)
    new[1:] = h[1:] != h[:-1]
    if n and not (new[1:] | (g[1:] == g[:-1])).all():  # two words share the first hash: order by both
        h, g = h[np.argsort(order)], g[np.argsort(order)]
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    heads = np.flatnonzero(new)
    at = order[heads]
    owner = np.searchsorted(block.first[1:], order, side="right")
    return {"first_words": block.first[:-1] + np.arange(len(texts)), "n_words": np.diff(block.first),
            "terms": packed_strings(block.data, block.starts[at], block.ends[at]),
            "counts": np.diff(np.append(heads, n)), "positions": order + owner}


def _listed(values) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(np.asarray(values, dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _segments(batches):
    hasher, number = Hasher(), TaskContext.get().partitionId() << 33
    for batch in batches:
        for begin, end, texts in portions(batch.column(1), SEGMENT_BYTES):
            parts = _segment(hasher, texts)
            ids = pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), batch.column(0).slice(begin, end - begin))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *(_listed(x) for x in parts.values())],
                                             names=["segment", "ids", *parts])
            number += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: one row per segment of about 1 MB of whole texts, written to the shared folder.

    ``terms`` are the distinct words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) of all its texts,
    ``counts`` their numbers of postings and ``positions`` the postings, term after term, ascending. ``ids``,
    ``first_words`` and ``n_words`` describe the texts. Null and empty texts are indexed without words, repeated rows
    as texts of their own; an empty table gives an index without segments.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_segments, f"segment long, ids array<{kind}>, {SEGMENT}"), "postings")


class Segment:
    """One row of the index inside a task."""

    def __init__(self, batch: pa.RecordBatch, i: int, terms: pa.Array) -> None:
        part = {name: batch.column(name)[i].values for name in batch.schema.names if name != "segment"}
        self.ids = part["ids"]
        self.first, self.n_words = (part[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("first_words", "n_words"))
        self.positions = part["positions"].to_numpy(zero_copy_only=False)
        ends = np.cumsum(part["counts"].to_numpy(zero_copy_only=False), dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at = pc.index_in(terms, value_set=part["terms"]).fill_null(-1).to_numpy(zero_copy_only=False)
        #: of the search terms: where their postings lie, none for a term that does not occur
        self.known = at >= 0
        at = np.maximum(at, 0)
        self.begin = np.where(self.known, begins[at], 0) if len(ends) else np.zeros(len(at), dtype=np.int64)
        self.end = np.where(self.known, ends[at], 0) if len(ends) else np.zeros(len(at), dtype=np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term]:self.end[term]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Word numbers at which the terms follow each other: offset-adjusted lists, from the rarest term on."""
        rarity = np.argsort(self.end[terms] - self.begin[terms], kind="stable")
        found = self.postings(terms[rarity[0]]) - rarity[0]
        for k in rarity[1:]:
            if not len(found):
                break
            found = found[_among(self.postings(terms[k]), found + k)]
        return found

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Word numbers at which a stretch of ``span`` words begins that holds every term; only starts at a term."""
        terms = np.unique(terms)
        terms = terms[np.argsort(self.end[terms] - self.begin[terms], kind="stable")]
        starts = np.unique(np.concatenate([self.postings(t) for t in terms]))
        doc = self.text_of(starts)
        until = np.minimum(starts + span, self.first[doc] + self.n_words[doc])
        for t in terms:
            held = self.postings(t)
            after = np.searchsorted(held, starts)
            inside = after < len(held)
            inside[inside] = held[after[inside]] < until[inside]
            starts, until = starts[inside], until[inside]
        return starts

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, side="right") - 1


def _among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == wanted if len(sorted_values) else np.zeros(len(wanted), dtype=bool)


def query_words(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, words)`` with the words of each query text in order; texts without words are left out."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    return queries.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where("size(words) > 0")


def query_passes(words: DataFrame):
    """The query texts in portions of bounded size: ``(items, lists of words)``."""
    size = words.agg(F.sum(F.length(F.array_join("words", " ")) * 2)).first()[0] or 0
    passes = size // QUERY_BYTES + 1
    for k in range(passes):
        rows = words.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == k).collect()
        if rows:
            yield [r.item for r in rows], [r.words for r in rows]


def _numbered(lists: list[list[str]]) -> tuple[pa.Array, list[np.ndarray]]:
    place: dict[str, int] = {}
    numbers = [np.array([place.setdefault(w, len(place)) for w in words]) for words in lists]
    return pa.array(list(place), pa.string()), numbers


class Windows:
    """The distinct windows of numbered queries, each with the ``(query, offset)`` pairs it comes from."""

    def __init__(self, numbers: list[np.ndarray], width: int) -> None:
        found: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.uses: list[list[tuple[int, int]]] = []
        for q, words in enumerate(numbers):
            for k in range(max(1, len(words) - width + 1)):
                part = words[k:k + width]
                at = found.setdefault(part.tobytes(), len(self.parts))
                if at == len(self.parts):
                    self.parts.append(part)
                    self.uses.append([])
                self.uses[at].append((q, k))
        self.table = np.full((len(self.parts), width), -1)
        for i, part in enumerate(self.parts):
            self.table[i, :len(part)] = part

    def possible(self, known: np.ndarray):
        """Windows all of whose terms occur; -1 in the table stands for no term."""
        for i in np.flatnonzero(np.append(known, True)[self.table].all(axis=1)):
            yield self.parts[i], self.uses[i]


def _search(index: DataFrame, words: DataFrame, task, schema: str) -> list[DataFrame]:
    """Run ``task(portion)`` over the segments for each portion of the numbered queries, about ``QUERY_BYTES`` at most.

    Of several portions each one's finds are written and its broadcast is given up before the one after the next is read.
    """
    context, found = index.sparkSession.sparkContext, []
    passes = query_passes(words)
    portion = next(passes, ([], []))
    while portion is not None:
        items, lists = portion
        shared = context.broadcast((items, *_numbered(lists)))
        here, portion = index.mapInArrow(task(shared), schema), next(passes, None)
        if portion is not None:
            here = stored(here, "finds")
            shared.destroy()
        found.append(here)
    return found


def _kind(index: DataFrame) -> str:
    return dict(index.dtypes)["ids"][len("array<"):-1]


def phrase_matches(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text",
                   width: int = WINDOW) -> DataFrame:
    """Every occurrence of a window of ``width`` query words: ``(id, item, offset, start, n_words)``.

    ``offset`` and ``start`` count words from 0 in the query and in the text. A shorter query is one window. Repeated
    queries give repeated rows.
    """
    def task(shared):
        def search(batches):
            items, terms, numbers = shared.value
            windows = Windows(numbers, width)
            for batch in batches:
                for i in range(batch.num_rows):
                    seg = Segment(batch, i, terms)
                    rows: list[tuple] = []
                    for part, uses in windows.possible(seg.known):
                        found = seg.phrase(part)
                        doc = seg.text_of(found)
                        rows += [(int(d), items[q], k, int(s)) for d, s in zip(doc, found - seg.first[doc]) for q, k in uses]
                    doc = np.array([r[0] for r in rows], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [seg.ids.take(pa.array(doc)), pa.array([r[1] for r in rows], pa.string()),
                         pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
                         pa.array(seg.n_words[doc], pa.int64())], names=["id", "item", "offset", "start", "n_words"])
        return search
    schema = f"id {_kind(index)}, item string, offset int, start int, n_words long"
    return reduce(DataFrame.unionByName, _search(index, query_words(queries, id_col, text_col), task, schema))


def proximity_matches(index: DataFrame, queries: DataFrame, span: int, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Stretches of ``span`` words that hold every distinct word of a query: ``(id, item, start)``.

    ``start`` is a word of the query; each word of the text that begins such a stretch gives a row.
    """
    def task(shared):
        def search(batches):
            items, terms, numbers = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    seg = Segment(batch, i, terms)
                    for item, part in zip(items, numbers):
                        if seg.known[part].all():
                            found = seg.near(part, span)
                            doc = seg.text_of(found)
                            yield pa.RecordBatch.from_arrays(
                                [seg.ids.take(pa.array(doc)), pa.array([item] * len(doc), pa.string()),
                                 pa.array((found - seg.first[doc]).astype(np.int32))], names=["id", "item", "start"])
        return search
    found = _search(index, query_words(queries, id_col, text_col), task, f"id {_kind(index)}, item string, start int")
    return reduce(DataFrame.unionByName, found)


def _merged(pairs: list[tuple[int, int]]) -> list[dict]:
    """The union of stretches ``(start, width)`` as separate stretches."""
    out: list[dict] = []
    for start, width in sorted(pairs):
        if out and start <= out[-1]["until"]:
            out[-1]["until"] = max(out[-1]["until"], start + width)
        else:
            out.append({"start": start, "until": start + width})
    return out


def _hits(shared, width: int):
    """Per text of a segment: its place, id, number of words, hit stretches and met items."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("until", pa.int32())]))

    def search(batches):
        items, terms, numbers = shared.value
        windows = Windows(numbers, width)
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch, i, terms)
                pairs: list[list] = [[] for _ in seg.first]
                met: list[set] = [set() for _ in seg.first]
                for part, uses in windows.possible(seg.known):
                    found = seg.phrase(part)
                    names = {items[q] for q, _ in uses}
                    for d, s in zip(seg.text_of(found).tolist(), found.tolist()):
                        pairs[d].append((s, len(part)))
                        met[d] |= names
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column("segment")[i], n), pa.array(range(n), pa.int32()), seg.ids,
                     pa.array(seg.n_words), pa.array([_merged(p) for p in pairs], kind),
                     pa.array([sorted(m) for m in met], pa.list_(pa.string()))],
                    names=["segment", "place", "id", "n_words", "stretches", "items"])
    return search


#: the number of words in stretches that may overlap
N_HIT = """aggregate(array_sort(stretches), named_struct('n', 0L, 'reach', 0),
                     (a, s) -> named_struct('n', a.n + greatest(0, s.until - greatest(s.start, a.reach)),
                                            'reach', greatest(a.reach, s.until)), a -> a.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit`` (words inside any occurrence of a benchmark window), ``items``.

    ``items`` lists the ids, as sorted strings, of the items with a window in the text. A window is ``width``
    consecutive words of an item, or the whole of a shorter one; an item without words has none. Null and empty texts
    have no words. Repeated rows and ids stay rows of their own. Without items nothing is hit; without documents the
    result is empty. Other columns are not read. All lists of a document are in one segment, so a benchmark of one
    portion is searched without a shuffle; several portions are merged per document.
    """
    index = build_index(docs, id_col, text_col)
    schema = (f"segment long, place int, id {_kind(index)}, n_words long, stretches array<struct<start:int,until:int>>, "
              "items array<string>")
    parts = _search(index, query_words(benchmark, item_col, item_text_col), lambda shared: _hits(shared, width), schema)
    found = parts[0]
    if len(parts) > 1:
        found = (reduce(DataFrame.unionByName, parts).groupBy("segment", "place")
                 .agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"),
                      F.flatten(F.collect_list("stretches")).alias("stretches"),
                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    return found.select(F.col("id").alias(id_col), "n_words", F.expr(N_HIT).alias("n_hit"), "items")


def is_contaminated() -> Column:
    """Hit words are at least one in ``SHARE`` of the text's."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are contaminated, with all their columns.

    Rows without id are judged by their text like any other, null and empty texts are never contaminated, repeated
    rows stay or go together, an empty table stays empty and an empty benchmark leaves all rows.
    """
    row, bad_name = unused(docs, "row", "bad")
    kept = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    bad = (contamination(kept.select(row, text_col), benchmark, row, text_col).where(is_contaminated())
           .select(F.struct(F.col(f"{row}.id").alias("id"), F.col(f"{row}.text").alias("text")).alias("bad")).distinct())
    on = kept[row]["id"].eqNullSafe(F.col(f"{bad_name}.id")) & kept[row]["text"].eqNullSafe(F.col(f"{bad_name}.text"))
    return kept.join(bad.withColumnRenamed("bad", bad_name), on, "left_anti").select(*docs.columns)
