"""Byte-level BPE: each distinct pre-token of the corpus is encoded once and its ids go back to every place."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import portions

#: bytes of text whose distinct pre-tokens travel together
BLOCK_BYTES = 4 << 20
#: texts decoded or hashed at a time, in tokens
TOKENS_AT_ONCE = 1 << 18
ROWS = "block string, bucket int, ids array<{kind}>, counts array<int>, payload binary"


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a rank file among the public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parsed_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def _ranges(chars: set[str]) -> str:
    """The characters as the inside of a pattern's class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def matching(pattern: str) -> tuple[str, str, str]:
    """``pattern`` for the splitting library, the same with the encoding library's letters and numbers, and a pattern
    for the texts that need the second.

    The two libraries may know different versions of Unicode. Which characters each takes for a letter or number is
    asked of both, so texts with characters on which they differ are split as the encoding library does.
    """
    import regex
    import tiktoken
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    exact, differ = pattern, set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        ours = set("".join(regex.findall(kind, every)))
        asked = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(asked.encode_ordinary(every)).decode())
        if ours != theirs:
            differ |= ours ^ theirs
            more, less = _ranges(theirs - ours), _ranges(ours - theirs)
            wider = f"[{kind}{more}]" if more else kind
            exact = exact.replace(kind, f"[{wider}--[{less}]]" if less else wider)
    return pattern, "(?V1)" + exact, f"[\\U{ord(min(differ)):08x}-\\U0010ffff]" if differ else r"(?!)"


def splitter(patterns: tuple[str, str, str]):
    """A function that lists the pre-tokens of a text."""
    import regex
    plain, exact, rare = (regex.compile(p) for p in patterns)
    return lambda text: (plain if text.isascii() or not rare.search(text) else exact).findall(text)


def _pack(array: np.ndarray, level: int = 1) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=level).compress(array.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _pack_strings(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return _pack(np.frombuffer(np.array([len(words)], dtype="<u4").tobytes() + lengths.tobytes() + b"".join(words), dtype=np.uint8))


def _unpack_strings(data: bytes) -> list[bytes]:
    whole = _unpack(data, "u1").tobytes()
    n = int.from_bytes(whole[:4], "little")
    ends = np.cumsum(np.frombuffer(whole, dtype="<u4", count=n, offset=4), dtype=np.int64) + 4 + 4 * n
    cuts = [4 + 4 * n, *ends.tolist()]
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def _rows(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.list_(kind), pa.list_(pa.int32()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                      names=["block", "bucket", "ids", "counts", "payload"])


def _exploded(patterns: tuple[str, str, str], buckets: int):
    """Blocks of texts as the places of their pre-tokens (bucket -1) and, per bucket, their distinct pre-tokens.

    A pre-token is a number in the block: distinct ones are numbered bucket by bucket, so the buckets' rows in order
    list them all. The block's name holds a digest of its content: if a lost task is run again over rows in another
    order, old and new blocks do not mix.
    """
    def exploded(batches):
        find, task, number = splitter(patterns), TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin, end, texts in portions(batch.column(1), BLOCK_BYTES):
                place: dict[str, int] = {}
                places, counts, digest = [], [], xxhash.xxh64()
                for t in texts:
                    found = find(t.decode())
                    places.append(np.array([place.setdefault(p, len(place)) for p in found], dtype="<u4"))
                    counts.append(len(found))
                    digest.update(t)
                name = f"{task}-{number}-{digest.hexdigest()}"
                number += 1
                words = [p.encode() for p in place]
                bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(len(words), dtype="<u4")
                rank[order] = np.arange(len(words), dtype="<u4")
                rows = [(name, -1, batch.column(0).slice(begin, end - begin).to_pylist(), counts,
                         _pack(rank[np.concatenate(places)]))]
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in range(buckets):
                    if cut[k] < cut[k + 1]:
                        rows.append((name, k, None, [int(cut[k + 1] - cut[k])], _pack_strings([words[i] for i in order[cut[k]:cut[k + 1]]])))
                yield _rows(batch.schema.field(0).type, rows)
    return exploded


def _encoded(ranks):
    """Rows of a bucket after each other: every distinct pre-token is encoded once, each block gets its ids back."""
    def encoded(batches):
        import tiktoken
        one = tiktoken.Encoding("bpe", pat_str=r".", mergeable_ranks=parsed_ranks(ranks.value), special_tokens={})._encode_single_piece
        known, bucket = {}, None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                name, k, payload = (batch.column(c)[i].as_py() for c in ("block", "bucket", "payload"))
                if k != bucket:
                    known, bucket = {}, k
                words = _unpack_strings(payload)
                for w in words:
                    if w not in known:
                        known[w] = one(w)
                ids = [known[w] for w in words]
                flat = np.fromiter((i for part in ids for i in part), dtype="<u4")
                rows.append((name, k, None, [len(part) for part in ids], _pack(flat)))
            yield _rows(batch.schema.field("ids").type.value_type, rows)
    return encoded


def _gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after another."""
    until = np.cumsum(lengths)
    return values[np.repeat(begins - until + lengths, lengths) + np.arange(until[-1] if len(until) else 0)]


def _cut(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Stretches of bytes as an Arrow binary array."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1,
                                       [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _token_bytes(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and where each id's begin and how many they are."""
    table = parsed_ranks(content)
    values = [b""] * (max(table.values(), default=-1) + 1)
    for token, i in table.items():
        values[i] = token
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def _reassembled(kind: pa.DataType, outputs: tuple[str, ...], ranks):
    """Rows of a block after each other, places first: the ids of each text in order, in the wanted forms."""
    def finish(places_row, counts: list[list[int]], parts: list[np.ndarray], table):
        ids, per_text, payload = places_row
        lengths = np.array([n for c in counts for n in c], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, dtype="<u4"), *parts])
        places = _unpack(payload, "<u4")
        if len(places) and places.max() >= len(lengths):
            raise RuntimeError("pre-tokens of a block are missing: its rows come from different runs of a task")
        begins = np.cumsum(lengths) - lengths
        cut = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        begin = 0
        while begin < len(per_text):  # some texts at a time
            end = int(np.searchsorted(cut, cut[begin] + TOKENS_AT_ONCE, side="right")) - 1
            end = min(max(end, begin + 1), len(per_text))
            mine = places[cut[begin]:cut[end]]
            sizes = lengths[mine]
            tokens = _gather(flat, begins[mine], sizes)
            run = np.concatenate([[0], np.cumsum(sizes)])
            offsets = run[cut[begin:end + 1] - cut[begin]]
            made = {"id": pa.array(ids[begin:end], kind)}
            if "tokens" in outputs:
                made["tokens"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.astype(np.int32)))
            if "packed" in outputs:
                made["packed"] = _cut(tokens.astype("<u4").view(np.uint8), 4 * offsets)
            if table is not None:
                data, starts, widths = table
                until = np.concatenate([[0], np.cumsum(widths[tokens])])
                made["decoded"] = _cut(_gather(data, starts[tokens], widths[tokens]), until[offsets])
            yield pa.RecordBatch.from_pydict(made)
            begin = end

    def reassembled(batches):
        table = _token_bytes(ranks.value) if "decoded" in outputs else None
        block, places, counts, parts = None, None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                name, bucket, ids, n, payload = (column[i].as_py() for column in batch.columns)
                if name != block:
                    if block is not None:
                        yield from finish(places, counts, parts, table)
                    block, places, counts, parts = name, None, [], []
                if bucket < 0:
                    places = (ids, n, payload)
                else:
                    counts.append(n)
                    parts.append(_unpack(payload, "<u4"))
        if block is not None:
            yield from finish(places, counts, parts, table)
    return reassembled


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
           pattern: str | None = None, outputs: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """The id and ``tokens``, the token ids of each whole text, without special tokens.

    ``outputs`` asks for the ids as a list (``tokens``), as little-endian unsigned 32-bit integers in one binary
    (``packed``), or for the bytes they decode to by the token-byte table (``decoded``).
    Each match of ``pattern`` is encoded by the merge ranks in the file ``ranks`` (read on the driver; the public
    50k vocabulary if not given). Null counts as empty, and an empty text has no tokens. Repeated rows stay rows; an
    empty table gives an empty result; other columns are not read. Texts themselves are not shuffled: places and
    distinct pre-tokens are, packed by block.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(read_ranks(ranks or public_ranks()))
    schema = ROWS.format(kind=kind)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    exploded = rows.mapInArrow(_exploded(matching(pattern or public_pattern()), 2 * width), schema)
    words = exploded.where("bucket >= 0").repartition(width, "bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(_encoded(shared), schema)
    back = (exploded.where("bucket < 0").unionByName(encoded).repartition(width, "block")
            .sortWithinPartitions("block", "bucket"))
    wanted = [c for c in ("tokens", "packed", "decoded") if c in outputs]
    kinds = ", ".join([f"id {kind}", *(f"{c} {'array<int>' if c == 'tokens' else 'binary'}" for c in wanted)])
    task = _reassembled(to_arrow_type(rows.schema["id"].dataType), tuple(wanted), shared)
    return back.mapInArrow(task, kinds).withColumnRenamed("id", id_col)


def decoded_column(tokens: Column, ranks: str | None = None) -> Column:
    """The bytes of a column of token ids, by the token-byte table."""
    shared = SparkSession.active().sparkContext.broadcast(read_ranks(ranks or public_ranks()))

    def decoded(lists: pa.Array) -> pa.Array:
        data, begins, lengths = _token_bytes(shared.value)
        out = []
        for one in lists:
            ids = one.values.to_numpy() if one.is_valid else np.zeros(0, dtype=np.int32)
            out.append(b"".join(_gather(data, begins[part], lengths[part]).tobytes() for part in
                                (ids[k:k + TOKENS_AT_ONCE] for k in range(0, len(ids), TOKENS_AT_ONCE))))
        return pa.array(out, pa.binary())
    decoded.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(decoded, "binary")(tokens)
