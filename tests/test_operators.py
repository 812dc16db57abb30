"""Packing, arithmetic, answers, sources, sinks and measures against plain Python."""
import json

import pytest
from pyspark.sql import functions as F

from folioscan.operators import answers, calculator, metrics, pack
from folioscan.sources import sinks, tables

Q = {"qid": "q", "answer_format": "mcq", "question": "which?", "options": {"A": "a", "B": "b"}, "doc_ids": ["d1", "d2"]}
POOL = [{"candidate_id": f"c{i}", "doc_id": f"d{1 + i % 3}", "score": 10.0 - i, "text": "t" * (50 + 40 * (i % 4)), "support_options": [], "retrieval_options": ["A"] if i % 2 else ["B"]} for i in range(9)]


def best_first(budget):
    chosen, covered = [], set()
    goals = {("doc", "d1"), ("doc", "d2"), ("option", "A"), ("option", "B")}
    while len(chosen) < budget.max_evidence:
        now, options = pack.prompt_chars(Q, chosen), []
        for r in (r for r in POOL if r["candidate_id"] not in {c["candidate_id"] for c in chosen}):
            cost = pack.prompt_chars(Q, [*chosen, {**r, "evidence_id": len(chosen) + 1}])
            if cost <= budget.max_prompt_chars:
                got = {("doc", r["doc_id"]), *(("option", x) for x in r["retrieval_options"])}
                options.append((len((got & goals) - covered), r["score"] / max(1, cost - now), r["candidate_id"], got, {**r, "evidence_id": len(chosen) + 1}))
        if not options:
            break
        top = max(options, key=lambda x: x[:3])
        chosen.append(top[4])
        covered |= top[3]
    return [c["candidate_id"] for c in chosen]


@pytest.mark.parametrize("size", [900, 1300, 5000])
def test_cover_and_fit(size):
    budget = pack.Budget(size, 6, 900)
    got, used = pack.cover(Q, POOL, budget)
    assert [g["candidate_id"] for g in got] == best_first(budget) and used <= size
    facts = [{"fact_id": c["candidate_id"], "text": c["text"], "doc_id": c["doc_id"]} for c in POOL]
    kept, left, used = pack.fit("which?", facts, budget)
    want = []
    for f in facts:
        if len(want) < 6 and pack.numeric_chars("which?", [*want, f]) <= size:
            want.append(f)
    assert kept == want and left == [f["fact_id"] for f in facts if f not in want] and used <= size
    with pytest.raises(ValueError):
        pack.cover(Q, POOL, pack.Budget(10, 6, 900))
    with pytest.raises(ValueError):
        pack.Budget(0)


def test_packed_in_spark(spark):
    rows = spark.createDataFrame([("q", "A" if i % 2 else "B", p["candidate_id"], p["doc_id"], p["text"], p["score"], 1 + i // 2) for i, p in enumerate(POOL)], "qid string, label string, candidate_id string, doc_id string, text string, score double, rank int")
    q = spark.createDataFrame([(Q["qid"], Q["question"], Q["options"], Q["answer_format"], Q["doc_ids"])], "qid string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    got = pack.greedy(q, rows, pack.Budget(1300, 6, 900)).orderBy("evidence_id").collect()
    assert [r.candidate_id for r in got] == best_first(pack.Budget(1300, 6, 900))
    assert pack.first_fit(q, rows.withColumn("rank", F.row_number().over(__import__("pyspark").sql.Window.orderBy("candidate_id"))), pack.Budget(700, 6, 900)).count() > 0


def run(expression, operands, unit, facts, **more):
    plan = {"status": "ready", "expression": expression, "output_unit": unit, "operands": operands, **more}
    return calculator.checked({"status": "ok", "finish_reason": "stop", "content": json.dumps(plan)}, facts)


def op(token, unit, fact="f"):
    return {"fact_id": fact, "source_token": token, "unit": unit}


def test_calculator():
    f = {"f": "Of 375 million, 5% and (1,000) thousand; 262 less 472 less 102; 3 million."}
    assert run("a * b", {"a": op("375", "number"), "b": op("5%", "percent")}, "number", f)[0] == 18.75
    assert run("a + b", {"a": op("(1,000)", "money_thousand"), "b": op("3", "money_million")}, "money_million", f)[0] == 2.0
    assert run("a - b - c", {"a": op("262", "number"), "b": op("472", "number"), "c": op("102", "number")}, "number", f, answer=457)[:3] == (-312.0, "validated_calculation", ["model_arithmetic_corrected"])
    assert run("a > b", {"a": op("262", "number"), "b": op("102", "number")}, "number", f)[0] == "yes"
    assert run("(a / b) * 100", {"a": op("262", "number"), "b": op("472", "number")}, "percent", f)[3]["output_unit"] == "ratio"
    for expression, reason in (("a + 101", "unsupported_expression"), ("a.b", "unsupported_expression"), ("a", "unused_or_missing_operands"), ("a // b", "unsupported_operator"), ("a / (b - b)", "division_by_zero"), ("a **", "SyntaxError"), ("b ** a", "unsupported_power")):
        got = run(expression, {"a": op("262", "number"), "b": op("102", "number")}, "number", f)
        assert got[0] is None and got[2] == [f"calculation_invalid:{reason}"]
    for operand, reason in ((op("37", "number"), "operand_not_in_cited_evidence"), (op("5%", "number"), "percent_source_requires_percent_unit"), (op("375", "miles"), "unknown_unit"), (op("375", "number", "g"), "unknown_citation")):
        assert run("a", {"a": operand}, "number", f)[2] == [f"calculation_invalid:{reason}"]
    say = lambda content, **more: calculator.checked({"status": "ok", "finish_reason": "stop", "content": content, **more}, f)[2]
    assert say("no") == ["invalid_json_plan"] and say("[]") == ["invalid_json_plan"] and say("{}", finish_reason="length") == ["incomplete_model_output"] and say('{"status": "insufficient"}') == ["insufficient_evidence"]
    assert calculator.checked({"status": "ok", "finish_reason": "stop", "content": '{"status": "boolean", "answer": "no", "evidence_ids": ["f"]}'}, f)[:2] == ("no", "validated_citations")


def test_answers(spark):
    cases = [("14.464%", "0.14464", True), ("yes", "Yes ", True), ("1,000", "1000", True), ("true", "yes", False), ("nan", "nan", False), (None, "1", False), ("0.123456", "0.1234562", True)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", answers.answer_match(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [c[2] for c in cases]
    prompts = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "r")], "qid string, prompt string")
    assert {r.qid: r.response for r in answers.judged(spark, prompts, lambda p: p.upper()).collect()} == {"a": "P", "b": "P", "c": "R"}


def test_measures(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "d", "x"]), (["a"], ["a", "a"])], "found array<string>, gold array<string>")
    got = metrics.recalls(df).collect()
    assert [(round(r.recall_at_3, 3), r.all_at_3, round(r.recall_at_5, 3), r.all_at_5) for r in got] == [(0.333, 0, 0.667, 0), (1.0, 1, 1.0, 1)]
    with pytest.raises(Exception, match="No gold evidence"):
        metrics.recalls(spark.createDataFrame([(["a"], [])], df.schema)).collect()
    d = spark.createDataFrame([("v", f"c{i % 7}", float(i % 3)) for i in range(70)], "variant string, company string, difference double")
    r = metrics.cluster_interval(d, "company", ["variant"], 400).first()
    assert r.low <= r.difference <= r.high and r.clusters == 7 and metrics.cluster_interval(d.repartition(5), "company", ["variant"], 400).first() == r


def test_sources(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"unit_id": "u1", "doc_id": "d", "text": "x", "page_id": "7", "evidence_weight": "bad", "new": 1}\n\n[1]\n{"candidate_id": "c2", "page_id": "x", "evidence_weight": 0.5}\n')
    got = tables.as_candidates(tables.jsonl(spark, f"{tmp_path}/u.jsonl", tables.UNIT)).collect()
    assert [(r.candidate_id, r.unit_id, r.doc_id, r.page_id, r.evidence_weight) for r in got] == [("u1", "u1", "d", 7, 1.0), ("c2", "c2", "", None, 0.5)]
    (tmp_path / "bad.jsonl").write_text('{"a": \n')
    with pytest.raises(Exception, match="malformed JSON line"):
        tables.jsonl(spark, f"{tmp_path}/bad.jsonl", tables.UNIT).collect()
    assert tables.jsonl_or_empty(spark, f"{tmp_path}/none.jsonl", tables.UNIT).count() == 0
    (tmp_path / "a.csv").write_text("qid,answer,answer_draft\nsummary,,\nq1,,b\nq2,a,\nq2,c,\n")
    assert {r.qid: r.answer for r in tables.prior_answers(spark, f"{tmp_path}/a.csv").collect()} == {"q1": "B", "q2": "C"}
    docs = spark.createDataFrame([("d", "x", "t", "a" * 2000), ("e", "x", "t", "b")], "doc_id string, domain string, title string, text string")
    q = spark.createDataFrame([("q1", ["d"], 1)], "qid string, doc_ids array<string>, gold int")
    full = q.select("qid", *[F.lit(None).cast(t).alias(c) for c, t in tables.RAW.items() if c not in ("qid", "doc_ids")], "doc_ids", "gold")
    qs, metas, units = tables.adapted(full, docs)
    assert "gold" not in qs.columns and metas.count() == 1 and units.count() == 3
    with pytest.raises(ValueError, match="Missing"):
        tables.adapted(full, docs.where("doc_id = 'e'"))
    with pytest.raises(ValueError, match="Duplicate"):
        tables.adapted(full.unionByName(full), docs)
    src = spark.createDataFrame([("d", "x", "a/d.txt", "one\n\ntwo"), ("h", "x", "a/h.HTML", "<p>hi</p>"), ("p", "x", "a/p.pdf", "no")], "doc_id string, domain string, source_path string, content string")
    assert sorted(r.text for r in tables.raw_candidates(src).collect()) == ["hi", "one\n\ntwo"]
    fin = spark.createDataFrame([("r1", ["s0"], ["s1"], [["", "2007"], ["income", "5"]], ("why", {"text_0": "s0"}, "5"))], "id string, pre_text array<string>, post_text array<string>, table array<array<string>>, qa struct<question:string,gold_inds:map<string,string>,exe_ans:string>")
    _, units, gold = tables.table_questions(fin)
    assert [r.candidate_id for r in units.orderBy("reading_order").collect()] == ["r1::text_0", "r1::text_1", "r1::table_0", "r1::table_1"] and gold.first().facts == ["text_0"]
    assert json.loads(tables.structured_rows(fin).orderBy("candidate_id").first().text)["column_labels"] == []


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("q1", "A", 3, 4, 7), ("q2", None, None, 1, 1)], "qid string, answer string, prompt_tokens int, completion_tokens int, total_tokens int")
    sinks.write_answers(r, f"{tmp_path}/csv")
    lines = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")).splitlines()
    assert lines[0] == "qid,answer,prompt_tokens,completion_tokens,total_tokens" and lines[1].startswith("summary,") and lines[1].endswith("3,5,8") and len(lines) == 4
    with pytest.raises(FileExistsError):
        sinks.fresh_folder(spark, f"{tmp_path}/csv")
    asked = []

    def work(todo):
        asked.append(todo.count())
        return todo.select("qid", F.lit("A").alias("answer"))

    q = spark.createDataFrame([(f"q{i}",) for i in range(5)], "qid string")
    assert sinks.resumable(spark, f"{tmp_path}/run", q, {"k": 1}, work).count() == 5 and sinks.resumable(spark, f"{tmp_path}/run", q, {"k": 1}, work).count() == 5 and asked == [5]
    with pytest.raises(ValueError, match="other data or settings"):
        sinks.resumable(spark, f"{tmp_path}/run", q, {"k": 2}, work)
    assert sinks.write_jsonl(r, f"{tmp_path}/j") == 2 and "| q1 |" in sinks.report("t", {"rows": r})
