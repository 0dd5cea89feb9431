"""Fill-in-middle against cutting whole texts; frames; rebuilding."""

import hashlib
import re

import pytest
import zstandard
from llm_data import EDGES, texts  # noqa: F401

from tablewright.llm import middles as fm

ODD = [(100 + k, t) for k, t in enumerate(
    ["a<P>b", "x<S>", "<M>", "<P", "<<P", "P><", "a" * 500, "a1b2 c3\n\tÄöü🙂 end", "<" * 50 + "S" * 40 + ">" * 50, "🙂" * 90, "zz zz " * 60, "<P <S <M>"[:8]])]


def expected(rows, plain_from=90, spm_below=20):
    out = []
    for i, text in rows:
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
            out.append((i, len(units), "plain", None, None, text))
            continue
        prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        form = "spm" if h4 % 100 < spm_below else "psm"
        shown = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
        out.append((i, len(units), form, len(prefix), len(middle), shown))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, fm.FRAME_BYTES])
@pytest.mark.parametrize("plain_from, spm_below", [(90, 20), (100, 50)])
def test_equals_brute_force(spark, texts, frame_bytes, plain_from, spm_below):  # noqa: F811
    rows = [(i, t if t is None else t[:2000]) for i, t in EDGES + ODD] + [(k, f"word{k} and\nmore {k}! " * 9) for k in range(200, 240)]
    found = fm.fill_in_middle(texts(rows).repartition(3), plain_from=plain_from, spm_below=spm_below, outputs=("output", "digests"),
                              frame_bytes=frame_bytes).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == expected(rows, plain_from, spm_below)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert all(r.output_sha256 == sha(r.output) for r in found)
    assert sorted(r.restored_sha256 for r in found) == sorted(sha(t) for _, t in rows)


def test_very_long_text(spark, texts):  # noqa: F811
    rows = [(k, "some long words and numbers 123 " * 20_000) for k in range(4)]
    found = fm.fill_in_middle(texts(rows)).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_rebuilding_reads_only_the_output():
    """The digests of a text rebuilt from a changed output change with it."""
    shown = b"<S>tail<P>head <M>mid "
    read = lambda a, b: [shown[a:b]]
    assert b"".join(fm.restored("spm", fm.marker_places([shown]), read, len(shown))) == b"head mid tail"


def test_markers_are_found_over_any_cut():
    shown = b"<<P>pre<S<S>s<M>m"
    places = fm.marker_places([shown])
    for size in range(1, 6):
        assert fm.marker_places([shown[k:k + size] for k in range(0, len(shown), size)]) == places


def test_frames_are_independent_and_counted():
    text = ("abc def 12 ÄÖ🙂" * 30).encode()
    cut = fm.frames(text, zstandard.ZstdCompressor(), 11)
    assert b"".join(zstandard.ZstdDecompressor().decompress(f["data"]) for f in cut) == text
    assert cut[-1]["units"] == len(re.findall("[A-Za-z]+|[^A-Za-z]", text.decode())) and cut[-1]["chars"] == len(text.decode())
    whole = fm.Framed(*([f[n] for f in cut] for n in ("data", "bytes", "units", "chars")))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text.decode())
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert whole.place(k) == (len(before.encode()), len(before))


def test_empty_table(texts):  # noqa: F811
    found = fm.fill_in_middle(texts([]), outputs=("digests",))
    assert found.count() == 0 and found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
