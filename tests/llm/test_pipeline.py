"""Each stage against a brute-force version, on the rows that the stage before it kept."""

import collections
import hashlib
import re

import numpy as np
import tiktoken

import corpus_pipeline
from tablewright.llm.bpe import parsed_ranks, public_pattern, public_ranks, read_ranks
from tablewright.llm.quality import fit, held_out, scores
from tablewright.llm.store import stored
from tablewright.llm.words import Hasher
from test_contamination import brute
from test_neardup import brute_fingerprint, brute_groups

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, rows = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        rows.append({r.doc_id: r for r in docs.collect()})
        docs = stored(stage(spark, docs, SMALL), "test")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert _ == "tokens" or docs.columns == columns
    before, good, single, clean, safe = rows

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = fit(spark.read.parquet(f"{SMALL}/documents.parquet"), labels.where(~held_out()), "quality")
    assert set(good) == {i for i, r in before.items() if scores(model, [r.text.encode()], Hasher())[0] >= 0.7}
    assert len(good) > 0.7 * len(before)

    ids = sorted(good)
    label = brute_groups(np.array([brute_fingerprint(good[i].text) for i in ids], dtype=np.uint64))
    assert set(single) == {ids[label.index(g)] for g in set(label)}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = set()
    for i, r in single.items():
        n, hit, _ = brute(r.text, items, 13)
        if hit and 20 * hit >= n:
            bad.add(i)
    assert set(clean) == set(single) - bad

    secret = re.compile(r'(?i)(token = ")[0-9a-f]{40}')
    assert set(safe) == set(clean)
    for i, r in safe.items():
        assert r.text == secret.sub(r"\1[SECRET]", clean[i].text) and r.n_chars == len(r.text)

    encoding = tiktoken.Encoding("test", pat_str=public_pattern(), mergeable_ranks=parsed_ranks(read_ranks(public_ranks())), special_tokens={})
    assert set(kept[-1]) == set(safe)
    for i, r in kept[-1].items():
        assert r.tokens == encoding.encode_ordinary(safe[i].text) and r.n_tokens == len(r.tokens)
        assert r.decoded_sha256 == hashlib.sha256(safe[i].text.encode()).hexdigest()


def test_run_is_registered():
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()


ODD = "doc_id long, text string, lang string, source string, n_chars long, spans string, key string, row string, fp int, bad string, cut string, id string, n string"


def odd_tables(spark, path, rows):
    """A folder of tables whose documents are ``(doc_id, text)`` with columns of clashing names."""
    docs = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t), "s", "k", "r", 1, "b", "c", "x", "y") for i, t in rows], ODD)
    docs.write.parquet(f"{path}/documents.parquet")
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return small


def test_stages_with_odd_rows(spark, tmp_path, monkeypatch):
    """Null ids and texts, repeated ids and rows, columns of any name; without labels every score is 0.5."""
    from tablewright.llm import quality
    monkeypatch.setattr(quality.good_documents, "__defaults__", (0.4, *quality.good_documents.__defaults__[1:]))
    words = "river stone window garden letter mountain paper evening silver morning".split()
    text = lambda k: " ".join(words[(k * 7 + j * (k % 9 + 1)) % 10] + str(k * j % 11) for j in range(40))
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(k, text(k)) for k in range(1, 30)] + [(None, text(40)), (None, text(41)), (7, text(42)), (8, text(8)), (31, f'{text(31)} token = "{token}" {text(32)}')]
    rows += [(50, None), (51, ""), (52, " \n "), (60, "again " * 3000)]
    odd_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "odd")
        seen.append(docs)
        assert name == "tokens" or docs.columns == [f.split()[0] for f in ODD.split(", ")]
    good, single, clean, safe, tokens = (s.collect() for s in seen)
    assert collections.Counter((r.doc_id, r.text) for r in good) == before
    # one of the two rows of 8, one of the three texts without words; rows without id and the second text of 7 stay
    assert len(single) == len(rows) - 3 and sum(r.doc_id is None for r in single) == 2 and sum(r.doc_id == 7 for r in single) == 2
    assert sum(not (r.text or "").strip() for r in single) == 1 and len(clean) == len(single)
    assert {r.doc_id: r.text for r in safe if r.doc_id == 31}[31] == f'{text(31)} token = "[SECRET]" {text(32)}'
    assert len(safe) == len(tokens) == len(single) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in safe)
    assert all(r.decoded_sha256 for r in tokens)


def test_empty_documents(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
