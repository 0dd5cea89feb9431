"""Rows and the table fixture that the tests of this folder share."""

import pytest

#: rows every operator must take: null and empty texts, white space only, repeats, ties, a null id, a very long text
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (None, "loose text here"),
         (6, "Wörter ÉÈ 中文 𝔘 \x00 \x1c end"), (7, "long words come again and again " * 8000)]


@pytest.fixture
def texts(spark):
    """A documents table from ``(doc_id, text)``, with columns beyond those the operators read."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, id string, label double")
    return make
