import random

import pytest

from llm_data import EDGES, texts  # noqa: F401
from tablewright.llm.credentials import N_FEATURES, candidates, described, dictionary_of, planted, redacted, secrets

TOKEN = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_candidates():
    text = f'token = "{TOKEN}" and plainwordsonly 4111111111111111 password: hunter-two!'
    assert [text[a:b] for a, b in candidates(text)] == [TOKEN, "hunter-two!"]
    assert candidates("") == [] and candidates("no digits at all in thisverylongtext") == []


def test_features_have_one_length():
    assert len(described(f"x {TOKEN} y", 2, 42, {"word"})) == N_FEATURES
    assert len(described("a1", 0, 2, set())) == N_FEATURES
    for seed in range(200):
        for text, a, b, _ in planted("some words of a text", seed):
            assert text[a:b].strip() == text[a:b] != "" and len(described(text, a, b, set())) == N_FEATURES


@pytest.fixture
def docs(texts):
    rng = random.Random(1)
    words = ["river", "stone", "window", "garden", "letter", "mountain", "paper", "evening"]
    plain = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, plain()) for i in range(200)]
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows += [(1000 + i, f'{plain()} token = "{hexes()}" {plain()}') for i in range(20)]
    rows += [(2000 + i, f"{plain()} commit {hexes()} {plain()}") for i in range(20)]
    return texts(rows + EDGES), rows


def test_finds_secrets_and_leaves_lookalikes(docs):
    table, rows = docs
    found = secrets(table).collect()
    verdicts = {r.doc_id: r.is_secret for r in found}
    assert sum(verdicts[1000 + i] for i in range(20)) >= 19 and sum(verdicts[2000 + i] for i in range(20)) <= 1
    assert set(verdicts) == {i for i, _ in rows if i >= 1000}
    clean = {r.doc_id: r.text for r in redacted(table).where("doc_id >= 1000").collect()}
    for i, t in rows:
        if i >= 1000:
            assert clean[i] == (t.replace(next(w for w in t.replace('"', " ").split() if len(w) == 40), "[SECRET]") if verdicts[i] else t)


def test_dictionary(texts):
    assert dictionary_of(texts([(1, "Aaaa aaaa bbbb cc"), (2, "bbbb cccc")]), size=2) == {"aaaa", "bbbb"}


def test_edges(texts):
    assert secrets(texts([])).collect() == [] and secrets(texts(EDGES)).collect() == []
    assert sorted(str(r.doc_id) for r in redacted(texts(EDGES)).collect()) == sorted(str(i) for i, _ in EDGES)


def test_given_findings(spark, texts):
    rows = [(f"token = {TOKEN}{i % 10}", 8, 49, True) for i in range(30)] + [(f"see page{i:04d}number{i}", 4, 18, False) for i in range(30)]
    labelled = spark.createDataFrame(rows + [(None, 0, 1, True), ("x1", 0, 0, True), ("x1", 0, 2, None)], "text string, start int, stop int, is_secret boolean")
    found = secrets(texts([(1, f"token = {TOKEN}"), (2, "see page7777number9")]), labelled).collect()
    assert {r.doc_id: r.is_secret for r in found} == {1: True, 2: False}
    with pytest.raises(ValueError):
        secrets(texts([(1, f"token = {TOKEN}")]), labelled.where("is_secret"))


LONG = "".join(f"k{i * 7919 % 1000:03d}Zq" for i in range(60))
FORMS = [('DB_PASSWORD="{}"', "S3cr3t!pass#9"), ("client_secret: {}", "q9!Xz@71kk"), ("github_token={}", "ab.cd!12.ef"),
         ("postgres://user:{}@host/db", "pw7!xQ2z"), ("db.password = '{}'", "zK4$wq8Lp"), ("secret_key_prod={}", "9f86d081884c7d659a2feaa0c55ad015"),
         ("access_token: {}", LONG), ("password={}", "hV7kQ2xz")]


def test_candidates_of_every_form():
    for form, value in FORMS:
        text = f"before it {form.format(value)} after it"
        assert [text[a:b] for a, b in candidates(text)] == [value], form
    assert candidates("a=" + "b" * 20 + " id=" + "c1" * 3 + " x") == []
    assert candidates("token=x" * 20_000) == [(6, 140_000)] and candidates("://a:" * 20_000 + " token" * 20_000) == []


def test_planted_ranges_are_candidates():
    for seed in range(200):
        for text, a, b, _ in planted("some words of a text", seed):
            assert (a, b) in candidates(text)


def test_every_form_is_found_and_redacted(docs, texts):
    _, rows = docs
    plain = [t for i, t in rows if i < 200]
    forms = [(3000 + k, f"{plain[k]} {form.format(value)} {plain[k + 50]}") for k, (form, value) in enumerate(FORMS)]
    prose = [(4000 + k, f"{plain[k]} {x} {plain[k + 50]}") for k, x in enumerate(("author: Evening", "the password: mountain", "passenger: window"))]
    table = texts(rows + forms + prose)
    found = {(r.doc_id, r.start, r.stop): r.is_secret for r in secrets(table).collect() if r.doc_id >= 3000}
    clean = {r.doc_id: r.text for r in redacted(table).where("doc_id >= 3000").collect()}
    for (i, text), (form, value) in zip(forms, FORMS):
        start = text.index(value)
        assert found[i, start, start + len(value)], form
        assert clean[i] == text.replace(value, "[SECRET]"), form
    assert all(clean[i] == t for i, t in prose)
