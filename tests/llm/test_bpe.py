import hashlib
import random
import struct

import pytest
import tiktoken

import tablewright.llm.bpe as bpe
from llm_data import EDGES, texts  # noqa: F401
from pyspark.sql import functions as F
from tablewright.llm.lengths import length_quantile, suffix_sums, token_counts, truncated_total


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("test", pat_str=bpe.public_pattern(), mergeable_ranks=bpe.parsed_ranks(bpe.read_ranks(bpe.public_ranks())), special_tokens={})


def strange(rng):
    return "".join(rng.choice([chr(rng.randrange(0x300)), rng.choice(" \n\t\x85\xa0　'"), "'s", "a1", " the",
                               chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)]))]) for _ in range(rng.randrange(14)))


def test_split_as_the_encoding_library_does(encoding):
    rng, split = random.Random(1), bpe.splitter(bpe.matching(bpe.public_pattern()))
    for _ in range(5000):
        text = strange(rng)
        assert "".join(split(text)) == text
        assert [i for p in split(text) for i in encoding._encode_single_piece(p.encode())] == encoding.encode_ordinary(text)


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_encode_and_decode(texts, encoding, monkeypatch, block_bytes):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block_bytes)  # small: many blocks share words
    rng = random.Random(7)
    rows = EDGES + [(100 + i, strange(rng) + "<|endoftext|>" * (i % 2)) for i in range(60)]
    found = bpe.encode(texts(rows), outputs=("tokens", "packed", "decoded"))
    out = found.select("doc_id", "tokens", F.sha2("packed", 256).alias("digest"), F.col("decoded").alias("back"),
                       bpe.decoded_column(F.col("tokens")).alias("again")).collect()
    assert all(r.back == r.again for r in out)
    expected = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        expected.append((i, ids, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), (t or "").encode()))
    key = lambda r: (str(r[0]), r[3])
    assert sorted(((r.doc_id, r.tokens, r.digest, bytes(r.back)) for r in out), key=key) == sorted(expected, key=key)
    assert bpe.encode(texts([])).collect() == [] and bpe.encode(texts([])).columns == ["doc_id", "tokens"]


def test_token_counts(texts, encoding):
    rows = EDGES + [(50, "one two three"), (51, "x")]
    lengths = [len(encoding.encode_ordinary(t or "")) for _, t in rows]
    sums = token_counts(texts(rows))
    assert {r.length: (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_at_most, r.truncated_tokens) for r in sums.collect()} == {
        n: (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(x <= n for x in lengths),
            sum(min(x, n) for x in lengths)) for n in set(lengths)}
    for limit in (0, 1, 2, 7, 1000, 10**9):
        assert truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    for share in (0.0, 0.3, 0.5, 1.0):
        assert length_quantile(sums, share) == min(n for n in lengths if sum(x <= n for x in lengths) >= share * len(lengths))


def test_no_lengths(spark, texts):
    empty = token_counts(texts([]))
    assert empty.collect() == [] and truncated_total(empty, 5) == 0 and length_quantile(empty, 0.5) is None
    assert suffix_sums(spark.createDataFrame([(None,)], "length long")).collect() == []
