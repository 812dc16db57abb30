"""What retrieval reads: texts of the documents in question alone, the corpus only for questions that name none."""
import math

from pyspark.sql import functions as F

from folioscan.operators import retrieve
from folioscan.plans import retrieval_queries as R

QUESTIONS = "qid string, question string, options map<string,string>, domain string, doc_ids array<string>"
DOCS = "doc_id string, domain string, source_title string, source_kind string, source_path string"


def units(spark, rows):
    """Candidates split from texts (doc_id, text)."""
    own = retrieve.chunked(spark, spark.createDataFrame(rows, "doc_id string, text string"))
    return own.select(F.concat_ws("::", "doc_id", "chunk_no").alias("candidate_id"), "doc_id", "text", F.lit("").alias("section_title"), F.array().cast("array<string>").alias("numbers"), F.lit(None).cast("int").alias("page_id"), F.col("chunk_no").alias("reading_order"))


def test_given_documents_need_no_corpus(spark):
    q = spark.createDataFrame([("q", "what?", {"A": "a"}, "", ["d2", "d1"])], QUESTIONS)
    read = F.udf(lambda x: 1 / 0, "string")("text")
    got = retrieve.route(q, spark.createDataFrame([("d1", "", "", "", "")], DOCS), retrieve.with_candidate_features(units(spark, [("d1", "a"), ("d2", "b")]).withColumn("text", read)))
    assert sorted((r.doc_id, r.doc_pos) for r in got.collect()) == [("d1", 1), ("d2", 0)]


def test_other_texts_are_not_split(spark):
    routed = spark.createDataFrame([("q", "d1", 0)], "qid string, doc_id string, doc_pos int")
    got = retrieve.featured(units(spark, [("d1", "one two"), ("d2", "three")]), routed)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("(doc_id")
    assert [r.candidate_id for r in got.collect()] == ["d1::0"]


def test_ranked_rows_are_kept(spark):
    assert R._top(spark, "/root/testdata/sf0.001", True).storageLevel.useMemory


def test_seed_scores_split_only_given_documents(spark):
    assert "INSET" in R.score_seed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_words_counted_in_batches(spark):
    rows = [(f"d{i % 3}", t) for i, t in enumerate(["The the 5-3 (1,234.5)5 -7% ab12,345 +2", "第三条 保险责任等待期为180天 ５% 2020-2021", "x\n1,2345 " + "9 " * 150, "", "a.b-c K 12%3"])]
    u = retrieve.with_candidate_features(spark.createDataFrame([(f"c{i}", d, t, "", None, None, i) for i, (d, t) in enumerate(rows)], "candidate_id string, doc_id string, text string, section_title string, numbers array<string>, page_id int, reading_order int"))
    docs = spark.createDataFrame([(f"d{i}", "en", "s", "text", f"docs/{i}.txt") for i in range(3)], DOCS)
    want = {tuple(r) for r in retrieve.doc_token_counts(docs, u).collect()}
    words = spark.createDataFrame([(x,) for x in {t for _, t, _ in want} | {"none"}], "token string")
    assert {tuple(r) for r in retrieve.doc_token_counts(docs, u, words).collect()} == want and len(want) > 30


def test_routing_reads_texts_twice_and_scores_documents_without_candidates(spark):
    docs = spark.createDataFrame([("d1", "en", "s", "text", "x"), ("d2", "en", "s", "text", "x")], DOCS)
    q = spark.createDataFrame([("q", "report en", {"A": "en"}, "en", None)], QUESTIONS)
    got = retrieve.routing_scores(q, docs, retrieve.with_candidate_features(units(spark, [("d1", "a report"), ("d2", " ")])))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 2
    # d2 has no candidate: its metadata alone is met, as in the SQL: en twice in the question, once in d2
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores["d2"] == round(2 * (1 + math.log(2)), 6) and scores["d1"] > scores["d2"]
