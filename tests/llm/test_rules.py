import collections
import random
import re

import pytest

from llm_data import EDGES, texts  # noqa: F401
from tablewright.llm.rules import Condition, learn, quality_rules, statistics, verdict

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    w, seen, dup, hit = WORDS.findall(text or ""), set(), 0, set()
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    for i in range(len(w) - 4):
        if count[tuple(w[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_statistics(texts):
    rng = random.Random(3)
    rows = EDGES[:-1] + [(7, "long words come again and again " * 500), (8, "a b c d e a b c d e"), (9, "x\n\nx\n \nx y"), (10, "a a a a a a a")]
    rows += [(20 + i, "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\x0b"]) for _ in range(rng.randrange(200)))) for i in range(40)]
    found = statistics(texts(rows)).collect()
    got = collections.Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == collections.Counter((i, *brute(t)) for i, t in rows)


@pytest.fixture
def labelled(spark, texts):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        t = [rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()) + str(rng.randrange(90)) for _ in range(40)]
        rows.append((i, " ".join(t) if i % 4 else "### ".join(t) if i % 8 else " ".join(t).upper()))
    return texts(rows + EDGES), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")


def test_learned_list_separates(labelled):
    docs, labels = labelled
    found = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert not any(found[i].base_failed for i in range(8, 300))
    assert sum(found[i].kept == (i % 4 > 0) for i in range(8, 300)) >= 290  # a cut may fall beside a rare value


def test_edges(spark, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_rules(texts(EDGES), none).collect()
    assert len(found) == len(EDGES)
    assert all(r.kept == (not r.base_failed) for r in found) and all(r.base_failed for r in found if r.n_words < 10)
    assert quality_rules(texts([]), none).collect() == []
    assert learn(statistics(texts(EDGES)), none.withColumnRenamed("doc_id", "id")) == []


def test_order_of_rules(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (3.0, 1.0)], "a double, b double")
    rules = [[Condition("a", True, 2.0), Condition("b", True, 2.0)], [Condition("b", False, 1.0)]]
    assert [r.v for r in rows.select(verdict(rules).alias("v")).collect()] == [True, False, False]
    assert str(rules[0][0]) == "a > 2"


def test_rare_junk_and_many_kinds_of_it(spark):
    """A kind of bad rows rarer than one in 64, and more kinds than a fixed list would hold."""
    rng = random.Random(4)
    names = tuple(f"f{k}" for k in range(15))
    rows = [(i, *[rng.random() for _ in names], 1) for i in range(6000)]
    for k in range(15):
        rows += [(10_000 + 100 * k + j, *[rng.random() + 5 * (n == k) for n in range(15)], 0) for j in range(60)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", quality int").coalesce(4)
    rules = learn(df.drop("quality"), df.select("id", "quality"), "quality", features=names)
    wrong = df.where(verdict(rules) != (df.quality == 1)).count()
    assert len(rules) >= 13 and wrong <= 150
