"""The registered queries on small tables with odd rows, and held-out figures on the given ones."""
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import common, line_dedup, mixing, ngram_join, quality_model, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i}" for i in range(120))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in all columns, repeated rows and ids, empty and long texts, clashing labels, extra columns with the operators' own names."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i if i % 9 else None, [f"{LONG} tail {i}", f"good text number {i} here. " * 30, "", None, "idiot moron scum " * 20, "one"][i % 6], "en", ["a", "b", None][i % 3], i, 0.5, 1, 2, 3, 4) for i in range(240)]
    rows += rows[:20] + [(1, "another text under a known id", None, None, None, None, None, None, None, None), (7777, "x" * 150_000 + " end", "en", "a", 5, 0.1, 1, 1, 1, 1), (7778, "w " * 60_000, "en", "a", 5, 0.1, 1, 1, 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, n_lines long, k long, row_key long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 1), int(i % 6 == 4)) for i in range(1, 240)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, None, None), (1, "u", "h"), (1, "u", "h")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def none(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op8_warc_fixity", "pipeline")])
def test_odd_and_empty_tables(spark, odd, none, name):
    assert queries.QUERIES[name](spark, odd).count() == 263
    assert queries.QUERIES[name](spark, none).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, none):
    out = corpus_pipeline.run(spark, odd)
    assert out.count() > 0 and out.where("n_tokens IS NULL").count() == 0
    assert corpus_pipeline.run(spark, none).count() == 0 and queries.QUERIES["op8_warc_fixity"](spark, none).count() == 0
    docs = common.table(spark, odd, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns, name
    kept = corpus_pipeline.clean_toxicity(spark, docs, odd)
    assert kept.where("text LIKE 'idiot%'").count() == 0 and kept.where("text LIKE 'good%' OR text IS NULL").count() == docs.where("text LIKE 'good%' OR text IS NULL").count()


def test_callers_columns_survive(spark, odd):
    docs = common.table(spark, odd, "documents")
    out = line_dedup.dedup(docs.withColumn("_id", F.lit("mine")).withColumn("dedup_id", F.lit("too")))
    assert {(r["_id"], r.dedup_id) for r in out.select("_id", "dedup_id").distinct().collect()} == {("mine", "too")} and "_n_lines" in out.columns
    assert set(docs.columns) <= set(ngram_join.keep_one(docs).columns)


def test_mix_is_the_same_under_other_settings(spark, odd):
    docs = common.table(spark, odd, "documents")
    own = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def test_op4_keeps_by_its_list(spark, odd):
    docs, labels = common.table(spark, odd, "documents"), common.table(spark, odd, "labels")
    rules = quality_rules.fit(docs, labels)
    stats = common.with_stats(docs).collect()

    def kept(r):
        if r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words:
            return False
        return not any(all(r[n] >= c if op == ">=" else r[n] < c for n, op, c in rule) for rule in rules)

    got = quality_rules.op4_quality_rules(spark, odd)
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got.collect()) == sorted((r.doc_id or 0, r.n_words, kept(r)) for r in stats)


def auc(score, y):
    o = np.argsort(score)
    rank = np.empty(len(score))
    rank[o] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y > 0].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, label, mod, rest, least", [("op5_quality_classifier", "quality", 5, 0, 0.9), ("op6_toxicity", "toxic", 4, 2, 0.75)])
def test_held_out(spark, name, label, mod, rest, least):
    got = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % mod == rest)).all() and (got.predicted == (got.score >= 0.3)).all()
    own = got[got.held_out]
    assert auc(own.score.to_numpy(), own[label].to_numpy()) >= least
    if label == "toxic":
        assert own[own.toxic == 1].predicted.sum() >= 6 and own[own.toxic == 0].predicted.mean() <= 0.1


def test_wordless_texts_and_lone_labels(spark):
    m = toxicity.Model(["idiot here " * 30, "all is well " * 30, "a fine day " * 30, "idiot again " * 30, "good " * 50, "idiot " * 9], np.array([1.0, 0, 0, 1, 0, 1]))
    assert m.score("") == m.score("  ") and m.score("idiot " * 70) > m.score("well " * 70)
    assert toxicity.Model(["a", "b"], np.array([1.0, 1.0])).score("a") < 1e-9 and toxicity.Model([], np.zeros(0)).score("x") < 1e-9
    assert quality_model.Gam(np.zeros((2, 3)), np.ones(2)).score(np.zeros((1, 3)))[0] == 0.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
