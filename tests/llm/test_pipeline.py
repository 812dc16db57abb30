from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import mixing, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """A third of the rows without doc_id, another third in threes of one doc_id with texts of other lengths."""
    rows = []
    for i in range(600):
        text = " ".join(f"w{i}x{k}" for k in range(20 + i * 7 % 90))
        rows.append(([None, i // 9, 1000 + i][i % 3], text, "en", ["a", "b", None][i // 3 % 3], len(text)))
    return spark.createDataFrame(rows, SCHEMA)


def test_mixed_rows_are_those_taken(spark, odd):
    by = {r.text: r for r in mixing.mix(odd, F.col("text")).collect()}
    got = corpus_pipeline.mix_sources(spark, odd, "").collect()
    assert len(by) == 600 and all(r.n_chars == len(r.text) for r in got)
    assert Counter(r.text for r in got) == {t: n for t, r in by.items() if (n := (2 * r.taken + r["size"]) // (2 * r["size"]))}
    assert any(r.taken % r["size"] for r in by.values())  # some are at the border of a quota
    assert any(r.doc_id is None for r in got)
    source = {t: r.source for t, r in by.items()}
    assert all(r.source == source[r.text] for r in got)


def test_one_row_of_each_component(spark):
    long = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"v{i}" for i in range(120))
    third = " ".join(f"u{i}" for i in range(120))
    rows = [
        (1, long), (1, long), (2, long + " tail"), (None, long + " end"),  # a component with repeated and unnamed rows
        (3, other), (3, third), (4, third + " tail"), (5, other + " tail"),  # one doc_id with two texts, each with a near copy
        (None, "only in rows without doc_id"), (None, "Only in rows without doc_id"), (6, ""), (6, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.clean_near(spark, docs, "").collect())
    assert got == {(1, long): 1, (3, other): 1, (3, third): 1, (None, "only in rows without doc_id"): 1, (6, ""): 2, (None, ""): 1}
    found = Counter((r.doc_id, r.component_id) for r in ngram_join.joined(docs).collect())
    assert found == {(1, 1): 2, (2, 1): 1, (3, 3): 2, (4, 3): 1, (5, 3): 1, (6, 6): 2, (None, None): 4}
