"""Words of many texts at once: NumPy over the bytes of a block of documents."""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 20
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: after lower-casing A-Z: digits, a-z and every byte of a character beyond ASCII
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def inverse(base: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2**64."""
    return np.uint64(pow(int(base), -1, 2**64))


class Hasher:
    """64-bit hashes of byte ranges by differences of running sums; two bases give 128 bits."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of a base and of its inverse, at least ``n`` of each."""
        if which not in self.known or len(self.known[which][0]) < n:
            self.known[which] = powers(BASES[which], n + n // 8), powers(inverse(BASES[which]), n + n // 8)
        return self.known[which]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        return next(self.spans(data, [(starts, ends)], which))

    def spans(self, data: np.ndarray, ranges, which: int = 0):
        """Hashes of several lists of ranges over the same bytes."""
        up, down = self.powers(which, len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        for starts, ends in ranges:
            h = (total[ends] - total[starts]) * down[starts]
            h ^= h >> np.uint64(32)
            yield h * BASES[1 - which]


class Block:
    """The words of some texts, in order: byte ranges, document numbers and the running word count of each text."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[1:] = IN_WORD[self.data]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        #: word number at which each text begins, and the total
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths)]))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def portions(column, most: int = BLOCK_BYTES):
    """Slices ``(from, to, texts)`` of an Arrow text column with about ``most`` UTF-8 bytes each, null as no bytes.

    A longer text is alone. Only one slice is held as Python objects at a time.
    """
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(column.cast("binary")), 0).to_numpy(zero_copy_only=False).tolist()
    begin = total = 0
    for i, size in enumerate([*sizes, most + 1]):
        if i > begin and total + size > most:
            yield begin, i, [b"" if t is None else t for t in column.slice(begin, i - begin).cast("binary").to_pylist()]
            begin, total = i, 0
        total += size + 1


def packed_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Byte ranges as an Arrow text array, without a loop over them."""
    import pyarrow as pa
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))
