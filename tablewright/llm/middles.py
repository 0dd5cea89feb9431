"""Fill-in-middle transformation over texts kept as seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import stored
from .words import portions

#: bytes of text in a frame; no step holds more of a text than this and its compressed frames
FRAME_BYTES = 1 << 16
#: bytes of texts compressed from one Arrow slice
BLOCK_BYTES = 4 << 20
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = MARKERS = b"<P>", b"<S>", b"<M>"

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True
#: bytes that begin a character
IS_FIRST = np.ones(256, dtype=bool)
IS_FIRST[128:192] = False

FRAMES = "frames array<struct<data: binary, bytes: long, units: long, chars: long>>"


def unit_begins(data: np.ndarray, joined: bool) -> np.ndarray:
    """Where a unit begins in a frame: at every character but a letter after a letter. ``joined``: a letter came before."""
    letter = IS_LETTER[data]
    follows = np.empty(len(data), dtype=bool)
    follows[:1] = joined
    follows[1:] = letter[:-1]
    return IS_FIRST[data] & ~(letter & follows)


def frames(text: bytes, compressor, size: int = FRAME_BYTES) -> list[dict]:
    """The text as independent zstandard frames with the bytes, units and characters that begin up to each one's end."""
    out, at, units, chars = [], 0, 0, 0
    for begin in range(0, len(text), size):
        part = text[begin:begin + size]
        data = np.frombuffer(part, dtype=np.uint8)
        units += int(np.count_nonzero(unit_begins(data, begin > 0 and bool(IS_LETTER[text[begin - 1]]))))
        chars += int(np.count_nonzero(IS_FIRST[data]))
        at += len(part)
        out.append({"data": compressor.compress(part), "bytes": at, "units": units, "chars": chars})
    return out


class Framed:
    """A text in frames, read without holding it whole."""

    def __init__(self, data: list[bytes], until: list[int], units: list[int], chars: list[int]) -> None:
        import zstandard
        self.data, self.until, self.units, self.chars = data, until, units, chars
        self.decompressor = zstandard.ZstdDecompressor()

    @property
    def size(self) -> int:
        return self.until[-1] if self.until else 0

    def frame(self, k: int) -> bytes:
        return self.decompressor.decompress(self.data[k])

    def read(self, begin: int, end: int):
        """The bytes from ``begin`` to ``end``, frame by frame."""
        for k in range(bisect_right(self.until, begin), len(self.data)):
            start = self.until[k - 1] if k else 0
            if start >= end:
                break
            yield self.frame(k)[max(0, begin - start):end - start]

    def place(self, unit: int) -> tuple[int, int]:
        """Bytes and characters before unit number ``unit``; only the frame it begins in is decompressed."""
        k = bisect_right(self.units, unit)
        if k == len(self.data):
            return self.size, self.chars[-1] if self.chars else 0
        before, start, chars = (x[k - 1] if k else 0 for x in (self.units, self.until, self.chars))
        data = np.frombuffer(self.frame(k), dtype=np.uint8)
        begins = np.flatnonzero(unit_begins(data, False))
        # a run of letters that goes on from the frame before is not counted here
        over = len(begins) - (self.units[k] - before)
        at = int(begins[unit - before + over])
        return start + at, chars + int(np.count_nonzero(IS_FIRST[data[:at]]))


class Output:
    """A transformed text: markers and byte ranges of a framed text in the order of the form; it can be read anywhere."""

    def __init__(self, text: Framed, form: str, first: int, second: int) -> None:
        prefix, middle, suffix = (0, first), (first, second), (second, text.size)
        self.text = text
        self.parts = {"psm": [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle],
                      "spm": [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]}.get(form, [(0, text.size)])
        sizes = [len(p) if isinstance(p, bytes) else p[1] - p[0] for p in self.parts]
        self.begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()

    @property
    def size(self) -> int:
        return self.begins[-1]

    def read(self, begin: int = 0, end: int | None = None):
        end = self.size if end is None else end
        for part, start, stop in zip(self.parts, self.begins, self.begins[1:]):
            low, high = max(begin, start) - start, min(end, stop) - start
            if low < high:
                if isinstance(part, bytes):
                    yield part[low:high]
                else:
                    yield from self.text.read(part[0] + low, part[0] + high)


def marker_places(chunks) -> dict[bytes, int]:
    """Where each marker first occurs in a stream of bytes; the stream may be cut anywhere."""
    found, tail, at = {}, b"", 0
    for chunk in chunks:
        window = tail + chunk
        for marker in MARKERS:
            if marker not in found and (k := window.find(marker)) >= 0:
                found[marker] = at + k
        at += max(0, len(window) - 2)
        tail = window[-2:]
    return found


def restored(form: str, places: dict[bytes, int], read, size: int):
    """The text rebuilt from an output, piece by piece: ``read(begin, end)`` gives the output's bytes.

    The pieces hold no marker, so a marker's first occurrence ends the piece before it.
    """
    if form == "plain":
        yield from read(0, size)
        return
    order = sorted(MARKERS, key=places.__getitem__)
    ends = dict(zip(order, [*(places[m] for m in order[1:]), size]))
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from read(places[marker] + len(marker), ends[marker])


def draws(doc_id: Column) -> list[Column]:
    """h1 to h4 of a document id: groups of eight digits of a digest; no id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``(id, marked, frames)`` per document: its whole text as independent zstandard frames with cumulative counts.

    ``marked`` tells whether the text holds a marker. Units are runs of ASCII letters and single other characters. A
    null text is an empty one, without frames; repeated rows stay; an empty table gives an empty result.
    """
    name, kind = dict(docs.dtypes)[id_col], to_arrow_type(docs.schema[id_col].dataType)
    frame = pa.struct([("data", pa.binary()), *((n, pa.int64()) for n in ("bytes", "units", "chars"))])

    def cut(batches):
        import zstandard
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for begin, end, texts in portions(batch.column(1), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin).cast(kind), pa.array([any(m in t for m in MARKERS) for t in texts], pa.bool_()),
                     pa.array([frames(t, compressor, frame_bytes) for t in texts], pa.list_(frame))], names=["id", "marked", "frames"])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {name}, marked boolean, {FRAMES}")


def _documents(batch: pa.RecordBatch):
    """Framed texts of a batch, one at a time, with the form and the cuts in units."""
    lists = batch.column("frames")
    inner = lists.values
    data, *numbers = (inner.field(n) for n in ("data", "bytes", "units", "chars"))
    numbers = [n.to_numpy(zero_copy_only=False) for n in numbers]
    cuts = lists.offsets.to_pylist()
    forms, first, second = (batch.column(n).to_pylist() for n in ("form", "first", "second"))
    for k in range(batch.num_rows):
        a, b = cuts[k], cuts[k + 1]
        yield Framed(data.slice(a, b - a).to_pylist(), *(n[a:b].tolist() for n in numbers)), forms[k], first[k], second[k]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_from: int = 90, spm_below: int = 20,
                   outputs: tuple[str, ...] = ("output",), frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document: its id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``outputs``.

    A text is cut before two of its units, drawn from its id, into prefix, middle and suffix, and put in the order
    prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``, a draw below ``spm_below`` of 100), each
    behind its marker. It stays ``plain``, without counts of characters, if it is empty or null, holds a marker, or by
    a draw from ``plain_from`` on. ``outputs``: ``output`` (the transformed text), ``digests`` (``output_sha256`` and,
    of the text rebuilt from the output and the form alone, ``restored_sha256``). Documents without id draw alike.
    Repeated rows stay, an empty table gives an empty result, other columns are not read.

    Texts are compressed once into frames, written to the shared folder; only the frames that hold a cut are
    decompressed to find it, and digests stream the frames in order.
    """
    name, kind = dict(docs.dtypes)[id_col], to_arrow_type(docs.schema[id_col].dataType)
    kept = stored(framed(docs, id_col, text_col, frame_bytes), "frames")
    units = F.coalesce(F.try_element_at("frames", F.lit(-1))["units"], F.lit(0))
    drawn = kept.select("id", "marked", "frames", units.alias("n"), *draws(F.col("id")))
    cuts = [F.pmod(h, F.col("n") + 1) for h in ("h1", "h2")]
    form = (F.when((F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= plain_from), "plain")
            .when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm"))
    planned = drawn.select("id", "n", form.alias("form"), F.least(*cuts).alias("first"), F.greatest(*cuts).alias("second"), "frames")
    columns = {"output": ("output string",), "digests": ("output_sha256 string", "restored_sha256 string")}
    extra = [c for o in outputs for c in columns[o]]

    def transformed(batches):
        for batch in batches:
            rows = []
            for text, shape, first, second in _documents(batch):
                if shape == "plain":
                    out, row = Output(text, shape, 0, 0), [None, None]
                else:
                    (a, before), (b, until) = text.place(first), text.place(second)
                    out, row = Output(text, shape, a, b), [before, until - before]
                if "output" in outputs:
                    row.append(b"".join(out.read()))
                if "digests" in outputs:
                    digest, again = hashlib.sha256(), hashlib.sha256()

                    def told():
                        for chunk in out.read():
                            digest.update(chunk)
                            yield chunk
                    places = marker_places(told())
                    for chunk in restored(shape, places, out.read, out.size):
                        again.update(chunk)
                    row += [digest.hexdigest(), again.hexdigest()]
                rows.append(row)
            values = list(zip(*rows)) if rows else [()] * (2 + len(extra))
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * len(extra)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(kind), batch.column("n"), batch.column("form"), *(pa.array(v, t) for v, t in zip(values, kinds))],
                names=["id", "n", "form", "prefix_chars", "middle_chars", *(c.split()[0] for c in extra)])
    found = planned.mapInArrow(transformed, ", ".join([f"id {name}", "n long", "form string", "prefix_chars long", "middle_chars long", *extra]))
    return found.withColumnRenamed("id", id_col)
