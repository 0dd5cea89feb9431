"""Cross-tokenizer alignment: two tokenizations of the same bytes are merged in lockstep over many texts at once."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import _pack, _unpack, public_pattern
from .store import stored
from .words import portions

#: bytes of text whose alignment is held at a time; a longer text is alone
BLOCK_BYTES = 2 << 20
#: a text is advanced from every so many bytes at the same time, so a long one takes no more steps than a short one
LANE_BYTES = 1024
#: different words whose ids a task remembers from block to block; with more it begins anew
WORDS = 1 << 17


def public_tokenizer(name: str) -> bytes:
    """Content of a file among the public tokenizers."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    rest for the characters from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class ByteLevel:
    """A byte-level BPE file. Ids in merge order allow the faster library, where both read Unicode alike."""

    def __init__(self, content: bytes, pattern: str, rare: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        model, alphabet = json.loads(content)["model"], byte_alphabet()
        known = {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in alphabet for c in piece)}
        self.pieces = [b""] * (max(model["vocab"].values()) + 1)
        for piece, i in known.items():
            self.pieces[i] = piece
        self.exact = Tokenizer.from_str(content.decode())
        self.exact.encode_special_tokens = True
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.fast, self.rare = None, regex.compile(rare)
        if [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged))):
            ranks = {p: i for p, i in known.items() if i < 256 + len(merged)}
            self.fast = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part with a space before it."""
        return [self.fast.encode_ordinary(" " + t) if self.fast and (t.isascii() or not self.rare.search(t))
                else self.exact.encode(" " + t, add_special_tokens=False).ids for t in parts]


class Pieces:
    """A sentence-piece file with byte fallback; it puts the space before a text itself."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.pieces = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(names)]
        #: no piece goes on over a space and no character is rewritten, so a text's parts can be encoded alone
        self.parted = not any("▁" in p.lstrip("▁") for p in names) and self.model.normalize(EVERY) == "▁" + EVERY.replace(" ", "▁")

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1) if parts else []


#: every character
EVERY = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@lru_cache(maxsize=None)
def classes(pattern: str) -> tuple[str, str]:
    """A pattern for the characters that the two BPE libraries put into different classes (letter, number, space), and
    one for the places where both split whatever stands around: a space between characters that nobody takes for one."""
    import tiktoken
    from tokenizers import Regex, pre_tokenizers
    single, differ, spaces = {bytes([i]): i for i in range(256)}, set(), {c for c in EVERY if c.isspace()}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        asked = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        fast = set(bytes(asked.encode_ordinary(EVERY)).decode())
        split = pre_tokenizers.Split(Regex(f"[^{kind}]"), "removed").pre_tokenize_str(EVERY)
        exact = {c for run, _ in split for c in run}
        differ |= fast ^ exact
        spaces |= fast | exact if kind == r"\s" else set()
    one_of = lambda chars: "".join(f"\\U{ord(c):08x}" for c in sorted(chars))
    return f"[{one_of(differ)}]" if differ else "(?!)", f"(?<=[^{one_of(spaces)}]) (?=[^{one_of(spaces)}])"


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens ``(i, j)`` of two tokenizations of one line of bytes, in order, and whether both end there.

    ``ends`` are the tokens' ascending end positions, ``lanes`` ascending positions from 0 on. All lanes advance one
    step at a time: the state is a vector of pairs of pointers, each step hands on every lane's pair and moves the
    pointer whose token ends first (both where they end together), and lanes that reach the next one's begin leave
    the vector. A pair that began in an earlier lane is handed on there.
    """
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    stops = np.append(lanes[1:], ends_a[-1:])
    i, j = (np.searchsorted(e, lanes, side="right") for e in (ends_a, ends_b))
    own = np.maximum(starts_a[i], starts_b[j]) >= lanes
    place = np.full(len(ends_a) + len(ends_b), -1, dtype=np.int64)
    ended = np.zeros(len(place), dtype=bool)
    while len(i):
        a, b = ends_a[i], ends_b[j]
        at, both = np.minimum(a, b), a == b
        # pointers only grow, so their sum is the pair's place in the line
        slot = i + j
        if own is None:
            place[slot], ended[slot] = i, both
        else:
            place[slot[own]], ended[slot[own]], own = i[own], both[own], None
        i, j = i + (a == at), j + (b == at)
        going = at < stops
        if not going.all():
            i, j, stops = i[going], j[going], stops[going]
    found = np.flatnonzero(place >= 0)
    return place[found], found - place[found], ended[found]


class Aligned:
    """Tokens, links and cuts of some texts, as one line: texts without tokens hold no place in it."""

    def __init__(self, texts: list[bytes], sides: "Sides") -> None:
        read = [t.decode(errors="replace") for t in texts]
        part, per_text = sides.words.numbers([sides.parts(t) if t else [] for t in read])
        text = np.repeat(np.arange(len(texts)), per_text)
        good = per_text > 0
        good[text[~sides.words.same[part]]] = False
        good[[k for k, t in enumerate(read) if "\ufffd" in t and t.encode() != texts[k]]] = False
        self.kept = np.flatnonzero(good)
        part, text = part[good[text]], text[good[text]]
        tokens = [found.expanded(part) for found in sides.words.ids]
        self.ids = tuple(t for t, _ in tokens)
        #: token numbers at which each kept text begins, and the totals
        self.cuts = tuple(np.concatenate([[0], np.cumsum(np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)[self.kept])])
                          for _, n in tokens)
        size = np.array([len(texts[k]) + 1 for k in self.kept], dtype=np.int64)
        begins = np.cumsum(size) - size
        n_lanes = -(-size // LANE_BYTES)
        lanes = np.repeat(begins, n_lanes) + LANE_BYTES * (np.arange(n_lanes.sum()) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes))
        ends = [np.cumsum(length[i], dtype=np.int64) for length, i in zip(sides.lengths, self.ids)]
        if len(self.kept):
            self.a, self.b, self.ended = lockstep(*ends, lanes)
        else:
            self.a = self.b = np.zeros(0, dtype=np.int64)
            self.ended = np.zeros(0, dtype=bool)
        self.links = np.searchsorted(self.a, self.cuts[0])
        self.until = np.concatenate([[0], np.cumsum(self.ended)])[self.links]

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ``(text, id pair)`` in order: text numbers, pairs as ``a << bits | b`` and how often each is linked."""
        text = np.repeat(np.arange(len(self.kept)), np.diff(self.links))
        key = (self.ids[0][self.a].astype(np.int64) << bits) | self.ids[1][self.b]
        key, n = np.unique((text << (2 * bits)) | key, return_counts=True)
        return key >> (2 * bits), key & ((1 << 2 * bits) - 1), n

    def groups(self, digits: np.ndarray, width: np.ndarray) -> list[memoryview]:
        """``a1,a2|b1;a3|b2,b3`` of every kept text: ids of the groups between common ends."""
        last_a, last_b = self.a[self.ended], self.b[self.ended]
        at_a = np.arange(len(self.ids[0])) + np.repeat(np.append(0, last_b + 1)[:-1], np.diff(last_a, prepend=-1))
        at_b = np.arange(len(self.ids[1])) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        token = np.empty(len(at_a) + len(at_b), dtype=np.int32)
        token[at_a], token[at_b] = self.ids
        mark = np.full(len(token), ord(","), dtype=np.uint8)
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        shown, used = digits[token], width[token]
        shown[np.arange(len(token)), used] = mark
        out = memoryview(shown[np.arange(digits.shape[1]) <= used[:, None]])
        at = np.concatenate([[0], np.cumsum(used + 1, dtype=np.int64)])[self.cuts[0] + self.cuts[1]]
        return [out[x:y - 1] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


class Lists:
    """Lists of ids that grow, in one row."""

    def __init__(self) -> None:
        self.flat, self.until = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def add(self, found: list[list[int]]) -> None:
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=n.sum())])
        self.until = np.concatenate([self.until, self.until[-1] + np.cumsum(n)])

    def expanded(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of parts, and how many each part has."""
        begin = self.until[part]
        n = self.until[part + 1] - begin
        return self.flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Words:
    """Parts of texts with their ids by both tokenizers; each is encoded when it first comes up."""

    def __init__(self, sides: tuple) -> None:
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = Lists(), Lists()
        #: whether both tokenizers keep the part byte for byte
        self.same = np.zeros(0, dtype=bool)

    def numbers(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' parts in a row, and how many parts each text has."""
        if len(self.place) > WORDS:
            self.clear()
        place, known = self.place, len(self.place)
        per_text = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        part = np.fromiter((place.setdefault(p, len(place)) for p in chain.from_iterable(parts)), dtype=np.int64, count=per_text.sum())
        new = list(islice(place, known, None))
        whole = [b" " + w.encode() for w in new]
        same = np.ones(len(new), dtype=bool)
        for side, ids in zip(self.sides, self.ids):
            found = side.encode(new)
            ids.add(found)
            pieces = [b"".join([side.pieces[i] for i in w]) for w in found]
            if pieces != whole:
                same &= np.fromiter(map(eq, pieces, whole), dtype=bool, count=len(new))
        self.same = np.concatenate([self.same, same])
        return part, per_text


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, a row each with room for a mark, and how many each has."""
    words = np.array([str(k) for k in range(n)], dtype=bytes)
    table = np.zeros((n, words.itemsize + 1), dtype=np.uint8)
    table[:, :-1] = words.view(np.uint8).reshape(n, -1)
    return table, np.char.str_len(words).astype(np.int64)


class Sides:
    """Both tokenizers, read."""

    def __init__(self, pair: "Pair") -> None:
        self.sides = ByteLevel(pair.first, pair.pattern, pair.rare), Pieces(pair.second)
        self.lengths = tuple(np.array([len(p) for p in s.pieces], dtype=np.int64) for s in self.sides)
        self.digits = _digits(max(map(len, self.lengths)))
        self.words = Words(self.sides)
        cut = re.compile(pair.cut)
        self.parts = cut.split if self.sides[1].parted else lambda text: [text]


class Pair:
    """Both tokenizers as the tasks get them: the files' bytes, which each Python worker reads.

    Between words both tokenizers split, so a block's distinct words are encoded once; a second tokenizer with pieces
    over several words gets whole texts.
    """

    def __init__(self, first: bytes | None = None, second: bytes | None = None, pattern: str | None = None) -> None:
        self.first = first or public_tokenizer("byte_bpe_50k.json")
        self.second = second or public_tokenizer("piece_bpe_32k.model")
        self.pattern = pattern or public_pattern()
        self.rare, self.cut = classes(self.pattern)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair: Pair | None = None) -> DataFrame:
    """One row per document with its tokens, links and cuts.

    ``a_ids`` and ``b_ids`` are the tokens of a space and the text by either tokenizer, ``link_a`` and ``link_b`` the
    token numbers of all overlapping pairs in order, ``cut_a`` and ``cut_b`` how many tokens of either side end at
    each common end. Null and empty texts, and texts that either tokenizer does not keep byte for byte, have empty
    lists. Repeated rows stay, an empty table gives an empty result, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pair or Pair())
    kind = dict(docs.dtypes)[id_col]
    names = ("a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b")

    def aligned(batches):
        sides = Sides(shared.value)
        for batch in batches:
            for begin, end, texts in portions(batch.column(1), BLOCK_BYTES):
                found = Aligned(texts, sides)
                ended = [x[found.ended] + 1 for x in (found.a, found.b)]
                per_text = [(found.ids[0], found.cuts[0], 0), (found.ids[1], found.cuts[1], 0),
                            (found.a, found.links, found.cuts[0]), (found.b, found.links, found.cuts[1]),
                            (ended[0], found.until, found.cuts[0]), (ended[1], found.until, found.cuts[1])]
                lists = []
                for values, cut, base in per_text:
                    n = np.zeros(end - begin + 1, dtype=np.int32)
                    n[found.kept + 1] = np.diff(cut)
                    if not np.isscalar(base):
                        values = values - np.repeat(base[:-1], np.diff(cut))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(n, dtype=np.int32)), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *lists], names=["id", *names])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = out.mapInArrow(aligned, f"id {kind}, " + ", ".join(f"{n} array<int>" for n in names))
    return found.select(F.col("id").alias(id_col), *names)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(shared, bits: int, kind: pa.DataType):
    """Blocks of texts: what is counted of each, its links as places in the block's list of distinct pairs, and for
    each of these how many of the block's texts hold it."""
    def blocks(batches):
        sides = Sides(shared.value)
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin, end, texts in portions(batch.column(1), BLOCK_BYTES):
                found = Aligned(texts, sides)
                text, key, n = found.pairs(bits)
                pairs, held = np.unique(key, return_inverse=True)
                step = np.diff(held, prepend=0)
                first = np.searchsorted(text, np.arange(len(found.kept)))
                step[first] = held[first]
                sums = np.zeros((len(COUNTS), len(texts)), dtype=np.int32)
                for k, cut in enumerate((*found.cuts, found.until, found.links)):
                    sums[k, found.kept] = np.diff(cut)
                digest = [""] * len(texts)
                for k, shown in zip(found.kept.tolist(), found.groups(*sides.digits)):
                    digest[k] = hashlib.sha256(shown).hexdigest()
                distinct = np.zeros(len(texts), dtype=np.int32)
                distinct[found.kept] = np.bincount(text, minlength=len(found.kept))
                row = [task << 32 | number, batch.column(0).slice(begin, end - begin).to_pylist(), *sums.tolist(), digest, distinct.tolist(),
                       _pack(step.astype("<i4")), _pack(n.astype("<i4")), pairs.tolist(), np.bincount(held, minlength=len(pairs)).tolist()]
                kinds = [pa.int64(), pa.list_(kind), *[pa.list_(pa.int32())] * len(COUNTS), pa.list_(pa.string()), pa.list_(pa.int32()),
                         pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)],
                                                 names=["block", "ids", *COUNTS, "digests", "distinct", "steps", "times", "pairs", "holding"])
    return blocks


def _summed(kind: pa.DataType):
    """Documents of blocks that got the corpus-wide counts of their pairs back, in the order of the pairs."""
    def summed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                count, best = (np.asarray(row[x].values) if row[x].is_valid else np.zeros(0, dtype=np.int64) for x in ("count", "best"))
                distinct = np.asarray(row["distinct"].values, dtype=np.int64)
                until = np.cumsum(distinct)
                step, times = (_unpack(row[x].as_py(), "<i4").astype(np.int64) for x in ("steps", "times"))
                # places were written as differences that begin anew at each text
                held = np.cumsum(step)
                before = np.concatenate([[0], held])[until - distinct]
                held -= np.repeat(before, distinct)
                sums = [np.concatenate([[0], np.cumsum(times * of[held])]) for of in (count, best)]
                total, top = ((s[until] - s[until - distinct]) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [row["ids"].values.cast(kind), *(row[c].values.cast(pa.int64()) for c in COUNTS), pa.array(top), pa.array(total), row["digests"].values],
                    names=["id", *COUNTS, "n_best", "count_sum", "groups_sha256"])
    return summed


def link_support(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair: Pair | None = None) -> DataFrame:
    """One row per document: how its two tokenizations link, and how usual the links are in all documents.

    ``n_a``, ``n_b`` tokens, ``n_groups`` groups between common ends, ``n_links`` overlapping token pairs;
    ``count_sum`` adds up, over its links, in how many documents the pair of ids is linked; ``n_best`` counts the
    links whose pair is in as many documents as any pair of that first id; ``groups_sha256`` is the digest of the
    groups. Documents without tokens (see ``alignments``) have zeros and an empty digest. Repeated rows stay and
    count as documents, an empty table gives an empty result, other columns are not read.

    Texts are aligned once and written in blocks. A block's distinct pairs meet the other blocks' in a sum by pair,
    and the counts go back to the blocks that asked for them; no step holds the pairs of all documents.
    """
    pair = pair or Pair()
    bits = (max(map(len, Sides(pair).lengths)) - 1).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    name, kind = dict(docs.dtypes)[id_col], to_arrow_type(docs.schema[id_col].dataType)
    lists = ", ".join(f"{c} array<int>" for c in COUNTS)
    blocks = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _blocks(shared, bits, kind), f"block long, ids array<{name}>, {lists}, digests array<string>, distinct array<int>, steps binary, times binary, "
                                     "pairs array<long>, holding array<int>"), "alignments")
    asked = blocks.select("block", F.explode(F.arrays_zip("pairs", "holding")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.holding").alias("n"))
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", bits))
    counts = stored(counts, "pairs")
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    told = (asked.join(known, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("x"))
            .select("block", F.col("x.count").alias("count"), F.col("x.best").alias("best")))
    found = (blocks.drop("pairs", "holding").join(told, "block", "left").drop("block").mapInArrow(
        _summed(kind), f"id {name}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"))
    return found.withColumnRenamed("id", id_col)
