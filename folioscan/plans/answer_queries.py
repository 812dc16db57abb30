"""Answers, judgements, verification, repair and arithmetic over the driver's tables."""
from pyspark.sql import functions as F

from folioscan.operators import answers, calculator, retrieve

from . import adapters as A
from . import retrieval_queries as R

C = F.col


def _labels(spark, sf_dir):
    """Answers made from the labels: letters, formats."""
    i = C("doc_id")
    raw = F.concat(F.when(C("quality") == 1, "answer is a").otherwise("b, "), F.when(i % 3 == 0, " or D").otherwise(""), F.when(i % 11 == 0, " A").otherwise(""))
    return A.read(spark, sf_dir, "labels").select("doc_id", F.when(i % 13 == 0, "").otherwise(raw).alias("raw"), F.get(F.array(*map(F.lit, ("mcq", "multi", "tf", "numeric"))), (i % 4).cast("int")).alias("fmt"))


_RAW = """l AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE CASE WHEN quality = 1 THEN 'answer is a' ELSE 'b, ' END || CASE WHEN doc_id % 3 = 0 THEN ' or D' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' A' ELSE '' END END AS raw, (['mcq', 'multi', 'tf', 'numeric'])[doc_id % 4 + 1] AS fmt FROM labels),
x AS (SELECT *, regexp_extract_all(upper(raw), '[ABCD]') AS ls FROM l), n AS (SELECT *, CASE WHEN len(ls) = 0 THEN '' WHEN fmt IN ('mcq', 'tf') THEN ls[1] ELSE array_to_string(list_sort(list_distinct(ls)), '') END AS answer,
CASE WHEN len(ls) = 0 THEN 'answer_empty' WHEN fmt IN ('mcq', 'tf') AND len(list_distinct(ls)) > 1 THEN 'format_conflict_multiple_letters_for_single_answer' WHEN fmt = 'numeric' THEN 'unknown_answer_format' ELSE '' END AS warnings FROM x)"""


def normalize_answer(spark, sf_dir):
    n = answers.normalize_answer(C("raw"), C("fmt"))
    return _labels(spark, sf_dir).select("doc_id", n.answer.alias("answer"), F.array_join(n.warnings, ",").alias("warnings"))


def legal_answer(spark, sf_dir):
    raw = F.upper(F.translate("raw", "ensw i,or", ""))
    return _labels(spark, sf_dir).select("doc_id", answers.legal_answer(raw, C("fmt")).alias("reason"))


def answer_match(spark, sf_dir):
    i = C("l_orderkey")
    a = F.when(i % 4 == 0, F.concat(C("l_linenumber").cast("string"), F.lit("%"))).when(i % 4 == 1, "Yes").otherwise(C("l_linenumber").cast("string"))
    b = F.when(i % 4 == 0, (C("l_linenumber") / 100).cast("string")).when(i % 4 == 1, "yes ").when(i % 4 == 2, "n/a").otherwise(F.concat((C("l_linenumber")).cast("string"), F.lit(".0")))
    return A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answers.answer_match(a, b).alias("match"))


def answer_text(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", answers.answer_text(answers.letters(C("raw"))).alias("answer"))


def _judgement(i):
    """A response: JSON alone, JSON within prose, or none."""
    j = F.concat(F.lit('{"option_judgement": {"A": {"verdict": "true", "evidence_ids": [1, "2", "x"], "reason": "r"}, "B": {"verdict": "maybe"}}, "n": '), i.cast("string"), F.lit("}"))
    return F.when(i % 3 == 0, j).when(i % 3 == 1, F.concat(F.lit("Here: "), j, F.lit(" ok"))).when(i % 2 == 0, "no json").otherwise("[1]")


def json_extract(spark, sf_dir):
    e = A.read(spark, sf_dir, "events").select("event_id", answers.json_object(_judgement(C("event_id"))).alias("r"))
    j = answers.judgements(C("r.json"), F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    e = e.select("event_id", F.array_join("r.warnings", ",").alias("warnings"), F.get_json_object("r.json", "$.n").alias("n"), j.alias("j"))
    return e.select("event_id", "warnings", "n", *[F.element_at("j", x).verdict.alias(f"verdict_{x.lower()}") for x in "ABC"], F.array_join(F.transform(F.element_at("j", "A").evidence_ids, lambda i: i.cast("string")), ",").alias("ids_a"), F.element_at("j", "C").reason.alias("reason_c"))


def _evidence(spark, sf_dir):
    rows = retrieve.best(R._scored(spark, sf_dir)).where("rank <= 3 AND label IS NOT NULL")
    one = rows.groupBy("qid", "candidate_id").agg(F.min("rank").alias("rank"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.array_sort(F.collect_set("label")).alias("options"))
    packed = F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "doc_id", "text", "options")))
    return one.groupBy("qid").agg(F.transform(packed, lambda x, i: F.struct((i + 1).alias("evidence_id"), x.candidate_id.alias("candidate_id"), x.doc_id.alias("doc_id"), x.text.alias("text"), x.options.alias("options"), F.sha2(x.text, 256).alias("quote_sha256"))).alias("evidence"))


def _case(spark, sf_dir):
    f = R._features(spark, sf_dir, True).withColumnRenamed("warnings", "feature_warnings")
    df = f.join(_evidence(spark, sf_dir), "qid", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<evidence_id:int,candidate_id:string,doc_id:string,text:string,options:array<string>,quote_sha256:string>>")))
    i = C("qid").cast("long")
    prior = F.get(F.array(*map(F.lit, ("A", "BD", "ABCD", ""))), (i % 4).cast("int"))
    labels = F.map_keys("options")
    ev = F.transform("evidence", lambda e: F.struct(e.evidence_id.alias("evidence_id"), e.options.alias("retrieval_options")))
    df = df.withColumn("answer_raw", prior).withColumn("judgement", answers.prior_judge(labels, C("answer_raw"), ev))
    return df.withColumn("answer_norm", answers.normalize_answer(C("answer_raw"), C("answer_format")).answer).withColumn("judge_warnings", F.array().cast("array<string>")).withColumn("judge_status", F.lit("model_judged")).withColumn("judge_mode", F.lit("prior")).withColumn("candidate_docs", C("doc_ids"))


def prior_judgements(spark, sf_dir):
    out = _case(spark, sf_dir).select("qid", F.explode("judgement").alias("label", "j"))
    return out.select("qid", "label", "j.verdict", F.size("j.evidence_ids").alias("cited"))


def no_judgements(spark, sf_dir):
    q = A.questions(spark, sf_dir, True).select("qid", F.explode(answers.no_judge(F.map_keys("options"))).alias("label", "j"))
    return q.select("qid", "label", "j.verdict", "j.reason")


def verify_flags(spark, sf_dir):
    v = answers.verified(_case(spark, sf_dir))
    return v.select("qid", "status", F.array_join("all_warnings", ",").alias("warnings"), F.array_join("needs_review", ",").alias("needs_review"))


def validate_citations(spark, sf_dir):
    """Every third question cites evidence that it doesn't have, every fifth has a changed quote."""
    i = C("qid").cast("long")
    df = _case(spark, sf_dir)
    bad = F.transform_values("judgement", lambda k, v: F.struct(v.verdict.alias("verdict"), F.when((i % 3 == 0) & (k == "A"), F.array(F.lit(99))).otherwise(v.evidence_ids).alias("evidence_ids"), v.reason.alias("reason")))
    ev = F.transform("evidence", lambda e: e.withField("text", F.when(i % 5 == 0, F.concat(e.text, F.lit("!"))).otherwise(e.text)))
    v = answers.validated(df.withColumn("judgement", bad).withColumn("evidence", ev))
    return v.select("qid", C("valid_answer").alias("answer"), C("valid_status").alias("status"), F.array_join("problems", ",").alias("problems"))


def repair_plan(spark, sf_dir):
    """Which questions are searched again, for which options, and the number of the queries' lines."""
    f = answers.verified(_case(spark, sf_dir))
    oq = R.option_queries(spark, sf_dir).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("label", "query"))).alias("option_queries"))
    f = f.join(oq, "qid").withColumn("targets", answers.repair_targets(C("options"), C("answer_norm"), C("needs_review"), C("judgement")))
    again = f.where(answers.repairable(C("needs_review"), C("all_warnings")))
    return answers.repair_queries(again).select("qid", "label", F.sha2("query", 256).alias("query"))


def calc_execute(spark, sf_dir):
    """Growth in percent of each line's price over its discount, by a plan over two cited facts; the factor of 100 by which percents are shown goes."""
    a, b = F.format_number("l_extendedprice", 2), F.format_number(C("l_quantity") + 1, 2)
    plan = F.concat(F.lit('{"status": "ready", "expression": "(a - b) / b * 100", "output_unit": "percent", "answer": 1, "operands": {"a": {"fact_id": "f1", "source_token": "'), a, F.lit('", "unit": "money"}, "b": {"fact_id": "f2", "source_token": "'), b, F.lit('", "unit": "money"}}}'))
    facts = F.create_map(F.lit("f1"), F.concat(F.lit("The price was $"), a, F.lit(" then.")), F.lit("f2"), F.concat(F.lit("It was "), b, F.lit(" before.")))
    r = calculator.plan_results(plan, facts, F.lit("What was it?"))
    out = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))
    return out.select("l_orderkey", "l_linenumber", F.round("r.value", 8).alias("value"), "r.status", F.array_join("r.problems", ",").alias("problems"), F.array_join("r.evidence_ids", ",").alias("cited"))


def calc_refused(spark, sf_dir):
    """Plans that must not be computed: by key, another fault each."""
    i = C("o_orderkey") % 6
    expr = F.get(F.array(*map(F.lit, ("a + b", "a / (b - b)", "__import__(1)", "a * b", "a > b", "a ** 11 + b - b"))), i.cast("int"))
    plan = F.concat(F.lit('{"status": "ready", "answer": null, "output_unit": "money", "expression": "'), expr, F.lit('", "operands": {"a": {"fact_id": "f", "source_token": "12", "unit": "money"}, "b": {"fact_id": "f", "source_token": "(3)", "unit": "'), F.when(i == 0, "count").otherwise("money"), F.lit('"}}}'))
    r = calculator.plan_results(plan, F.create_map(F.lit("f"), F.lit("From 12 to (3) now.")), F.lit(""))
    out = A.read(spark, sf_dir, "orders").select("o_orderkey", r.alias("r"))
    return out.select("o_orderkey", "r.answer", "r.status", F.array_join("r.problems", ",").alias("problems"))


QUERIES = {f.__name__: f for f in (normalize_answer, legal_answer, answer_match, answer_text, json_extract, prior_judgements, no_judgements, verify_flags, validate_citations, repair_plan, calc_execute, calc_refused)}

_AT3 = "b3 AS (SELECT qid, candidate_id, min(rank) AS rank, any_value(text) AS text, any_value(doc_id) AS doc_id, list_sort(list(DISTINCT label)) AS labels FROM tk WHERE label <> '' AND rank <= 3 GROUP BY ALL)"
_CASE = f"""{R._SC}, {_AT3}, cs AS (SELECT qf.*, (['A', 'BD', 'ABCD', ''])[CAST(qid AS BIGINT) % 4 + 1] AS raw FROM qf), lb AS (SELECT qid, unnest(['A', 'B', 'C', 'D']) AS label FROM qf),
ct AS (SELECT lb.qid, lb.label, least(3, count(b3.qid)) AS cited FROM lb LEFT JOIN b3 ON b3.qid = lb.qid AND list_contains(b3.labels, lb.label) GROUP BY ALL)"""
_PLANS = "(['calculation_invalid:incompatible_addition_units', 'calculation_invalid:division_by_zero', 'calculation_invalid:unsupported_expression', 'calculation_invalid:unsupported_product_units', 'model_comparison_corrected', 'calculation_invalid:unsupported_power'])[o_orderkey % 6 + 1]"
ORACLE_SQL = {
    "normalize_answer": f"WITH {_RAW} SELECT doc_id, answer, warnings FROM n",
    "legal_answer": f"""WITH {_RAW}, u AS (SELECT *, upper(translate(raw, 'ensw i,or', '')) AS a FROM l) SELECT doc_id, CASE WHEN a = '' THEN 'empty_answer' WHEN NOT regexp_full_match(a, '[A-D]+') THEN 'invalid_characters' WHEN fmt IN ('mcq', 'tf') THEN CASE WHEN length(a) <> 1 THEN 'single_answer_has_multiple_letters' ELSE '' END
WHEN fmt = 'multi' THEN CASE WHEN array_to_string(list_sort(list_distinct(string_split(a, ''))), '') <> a THEN 'multi_answer_not_sorted_unique' ELSE '' END ELSE 'unknown_answer_format' END AS reason FROM u""",
    "answer_match": "SELECT l_orderkey, l_linenumber, l_orderkey % 4 <> 2 AS match FROM lineitem",
    "answer_text": f"WITH {_RAW} SELECT doc_id, array_to_string(ls, '') AS answer FROM x",
    "json_extract": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'judge_response_required_json_extraction' WHEN event_id % 2 = 0 THEN 'judge_response_required_json_extraction' ELSE '' END AS warnings, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS VARCHAR) END AS n,
CASE WHEN event_id % 3 < 2 THEN 'TRUE' ELSE 'UNKNOWN' END AS verdict_a, 'UNKNOWN' AS verdict_b, 'UNKNOWN' AS verdict_c, CASE WHEN event_id % 3 < 2 THEN '1,2' ELSE '' END AS ids_a, CASE WHEN event_id % 3 < 2 THEN 'Missing judgement for option.' ELSE 'Missing option_judgement object.' END AS reason_c FROM events""",
    "no_judgements": f"WITH {A.ques(True)} SELECT qid, unnest(['A', 'B', 'C', 'D']) AS label, 'UNKNOWN' AS verdict, 'model_judge_not_run' AS reason FROM qs",
    "prior_judgements": f"{_CASE} SELECT qid, label, CASE WHEN contains(raw, label) THEN 'TRUE' ELSE 'FALSE' END AS verdict, CAST(cited AS INTEGER) AS cited FROM ct JOIN cs USING (qid)",
    "calc_execute": "SELECT l_orderkey, l_linenumber, round((round(l_extendedprice, 2) - (l_quantity + 1)) / (l_quantity + 1), 8) AS value, 'validated_calculation' AS status, 'model_arithmetic_corrected' AS problems, 'f1,f2' AS cited FROM lineitem",
    "calc_refused": f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 THEN 'yes' END AS answer, CASE WHEN o_orderkey % 6 = 4 THEN 'validated_calculation' ELSE 'needs_review' END AS status, {_PLANS} AS problems FROM orders",
}
_NEED = f"question || chr(10) || CASE WHEN norm = '' THEN concat_ws(chr(10), o0, o1, o2, o3) ELSE concat_ws(chr(10), CASE WHEN contains(norm, 'A') THEN o0 END, CASE WHEN contains(norm, 'B') THEN o1 END, CASE WHEN contains(norm, 'C') THEN o2 END, CASE WHEN contains(norm, 'D') THEN o3 END) END"
_VER = f"""{_CASE}, sh AS (SELECT qid, string_agg(text, chr(10)) AS shown, count(DISTINCT doc_id) AS docs FROM b3 GROUP BY qid), nm AS (SELECT *, CASE WHEN answer_format IN ('mcq', 'tf') THEN left(raw, 1) ELSE raw END AS norm FROM cs),
ba AS (SELECT qid, list_sort(list('selected_option_without_retrieved_evidence:' || label)) AS bare FROM ct JOIN nm USING (qid) WHERE contains(norm, label) AND cited = 0 GROUP BY qid),
nd AS (SELECT nm.*, {_NEED} AS need, coalesce(shown, '') AS shown, coalesce(docs, 0) AS docs, coalesce(bare, []) AS bare FROM nm LEFT JOIN sh USING (qid) LEFT JOIN ba USING (qid)),
fl AS (SELECT *, list_concat(bare, list_filter([CASE WHEN answer_format = 'multi' AND norm = 'ABCD' THEN 'answer_suspicious_all_options' END, CASE WHEN contains(joined, '第一份') AND len(doc_ids) >= 2 AND docs < 2 THEN 'doc_imbalance_for_cross_document_question' END,
CASE WHEN len({A.years('need')}) > 0 AND len(list_intersect({A.years('need')}, {A.years('shown')})) = 0 THEN 'missing_year_in_packed_evidence' END, CASE WHEN len({A.nums('need')}) > 0 AND len(list_intersect({A.nums('need')}, {A.nums('shown')})) = 0 THEN 'missing_number_in_packed_evidence' END], lambda x: x IS NOT NULL)) AS found FROM nd),
rv AS (SELECT *, list_sort(list_distinct(list_concat(found, CASE WHEN norm = '' THEN ['answer_empty'] WHEN answer_format IN ('mcq', 'tf') AND length(raw) > 1 THEN ['format_conflict_multiple_letters_for_single_answer'] ELSE [] END))) AS review,
list_sort(list_distinct(list_concat(found, CASE WHEN answer_format = 'numeric' THEN ['unknown_answer_format'] ELSE [] END, CASE WHEN raw = '' THEN ['answer_empty'] WHEN answer_format IN ('mcq', 'tf') AND length(raw) > 1 THEN ['format_conflict_multiple_letters_for_single_answer'] ELSE [] END))) AS warns FROM fl)"""
ORACLE_SQL["verify_flags"] = f"{_VER} SELECT qid, CASE WHEN len(review) > 0 THEN 'needs_review' ELSE 'model_judged' END AS status, array_to_string(warns, ',') AS warnings, array_to_string(review, ',') AS needs_review FROM rv"
ORACLE_SQL["validate_citations"] = f"""{_CASE}, nm AS (SELECT *, CASE WHEN answer_format IN ('mcq', 'tf') THEN left(raw, 1) ELSE raw END AS norm, CAST(qid AS BIGINT) AS i FROM cs), ev AS (SELECT qid, count(*) AS n FROM b3 GROUP BY qid),
pb AS (SELECT ct.qid, list(CASE WHEN i % 3 = 0 AND label = 'A' THEN 'invalid_citation:A' END) AS p1, list(CASE WHEN (i % 3 = 0 AND label = 'A') OR cited = 0 THEN 'uncited_verdict:' || label END) AS p2 FROM ct JOIN nm USING (qid) GROUP BY ct.qid),
al AS (SELECT nm.qid, norm, list_sort(list_distinct(list_filter(list_concat(p1, p2, [CASE WHEN i % 5 = 0 AND coalesce(n, 0) > 0 THEN 'quote_hash_mismatch' END, CASE WHEN raw = '' THEN 'answer_empty' WHEN answer_format IN ('mcq', 'tf') AND length(raw) > 1 THEN 'format_conflict_multiple_letters_for_single_answer' WHEN answer_format = 'numeric' THEN 'unknown_answer_format' END,
CASE WHEN raw <> norm THEN 'answer_verdict_mismatch' END, CASE WHEN norm = '' THEN 'empty_answer' END]), lambda x: x IS NOT NULL))) AS ps FROM nm JOIN pb USING (qid) LEFT JOIN ev USING (qid)) SELECT qid, norm AS answer, CASE WHEN len(ps) > 0 THEN 'needs_review' ELSE 'validated_structure' END AS status, array_to_string(ps, ',') AS problems FROM al"""
