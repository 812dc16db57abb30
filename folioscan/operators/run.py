"""Whole runs: questions through routing, scoring, packing, judging, verification and repair, as tables; every step over all questions at once."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers, pack, retrieve
from . import question as Q

PACKED = "array<struct<evidence_id:int,candidate_id:string,doc_id:string,text:string,options:array<string>,quote_sha256:string>>"
Judge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    option_k: int = 6
    question_k: int = 14
    doc_k: int = 16
    most: int = 18
    each: int = 2
    quote_chars: int = 900
    repair_rounds: int = 1
    repair_k: int = 4
    greedy: pack.Budget | None = None  # packs by set cover under a budget instead of in two phases


def no_judge(df: DataFrame) -> DataFrame:
    """df with answer_raw, judgement, judge_warnings, judge_status and judge_mode: nothing is judged."""
    return df.select("*", F.lit("").alias("answer_raw"), answers.no_judge(F.map_keys("options")).alias("judgement"), F.array(F.lit("model_judge_not_run")).alias("judge_warnings"), F.lit("needs_model_judge").alias("judge_status"), F.lit("none").alias("judge_mode"))


def prior_judge(prior: DataFrame) -> Judge:
    """Judges by earlier answers (qid, answer)."""

    def judge(df: DataFrame) -> DataFrame:
        df = df.join(prior.select("qid", F.col("answer").alias("answer_raw")), "qid", "left").withColumn("answer_raw", F.coalesce("answer_raw", F.lit("")))
        evidence = F.transform("evidence", lambda e: F.struct(e.evidence_id.alias("evidence_id"), e.options.alias("retrieval_options")))
        known = F.col("answer_raw") != ""
        return df.select("*", answers.prior_judge(F.map_keys("options"), F.col("answer_raw"), evidence).alias("judgement"), F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("missing_prior_answer"))).alias("judge_warnings"), F.when(known, "prior_answer").otherwise("needs_review").alias("judge_status"), F.lit("prior").alias("judge_mode"))

    return judge


def model_judge(complete: Callable[[str], str]) -> Judge:
    """Judges by complete(prompt) -> text with a JSON object; equal prompts are asked once. complete is a client or, in tests, a fake."""

    def judge(df: DataFrame) -> DataFrame:
        ev = F.transform("evidence", lambda e: F.struct(e.evidence_id.alias("evidence_id"), e.doc_id.alias("doc_id"), e.options.alias("support_options"), e.text.alias("text")))
        prompts = df.select("qid", F.to_json(F.struct("qid", "answer_format", "question", "options", ev.alias("evidence"))).alias("prompt"))
        said = answers.judged(df.sparkSession, prompts, complete).select("qid", answers.json_object(F.col("response")).alias("r"))
        df = df.join(said, "qid")
        return df.select("*", F.coalesce(F.get_json_object("r.json", "$.answer"), F.lit("")).alias("answer_raw"), answers.judgements(F.col("r.json"), F.map_keys("options")).alias("judgement"), F.col("r.warnings").alias("judge_warnings"), F.when(F.col("r.json").isNull(), "needs_review").otherwise("model_judged").alias("judge_status"), F.lit("model").alias("judge_mode")).drop("r")

    return judge


def evidence_of(questions: DataFrame, rows: DataFrame, config: Config) -> DataFrame:
    """qid, evidence: the packed rows of each question in order."""
    one = rows.groupBy("qid", "candidate_id").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    if config.greedy:
        chosen = pack.greedy(questions, rows, config.greedy).select("qid", "evidence_id", "candidate_id", F.col("retrieval_options").alias("options"))
    else:
        chosen = pack.two_phase(rows, config.most, config.each).select("qid", "evidence_id", "candidate_id", F.col("retrieval_options").alias("options"))
    text: Column = F.left(F.trim("text"), F.lit(config.quote_chars))
    full = chosen.join(one, ["qid", "candidate_id"]).select("qid", F.struct(F.col("evidence_id").cast("int").alias("evidence_id"), "candidate_id", "doc_id", text.alias("text"), "options", F.sha2(text, 256).alias("quote_sha256")).alias("e"))
    return full.groupBy("qid").agg(F.array_sort(F.collect_list("e")).alias("evidence"))


def judged(features: DataFrame, routed: DataFrame, rows: DataFrame, judge: Judge, config: Config) -> DataFrame:
    """One round: packed, judged, verified and validated; a row for each question."""
    docs = routed.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_pos", "doc_id"))), lambda x: x.doc_id).alias("candidate_docs"))
    df = features.withColumnRenamed("warnings", "feature_warnings").join(evidence_of(features, rows, config), "qid", "left").join(docs, "qid", "left")
    df = df.withColumn("evidence", F.coalesce("evidence", F.array().cast(PACKED))).withColumn("candidate_docs", F.coalesce("candidate_docs", F.array().cast("array<string>")))
    df = judge(df)
    df = df.withColumn("answer_norm", answers.normalize_answer(F.col("answer_raw"), F.col("answer_format")).answer)
    return answers.validated(answers.verified(df))


RESULT = ("qid", "domain", "answer_norm", "status", "all_warnings", "needs_review", "valid_status", "problems", "judgement", "evidence", "candidate_docs", "round")


def answered(questions: DataFrame, docs: DataFrame, candidates: DataFrame, lexicon: DataFrame, judge: Judge = no_judge, config: Config = Config(), keep: Callable[[DataFrame], DataFrame] = lambda df: df.persist()) -> DataFrame:  # noqa: B008
    """The result of every question. After the first round those that more evidence may mend are searched again with wider queries, up to repair_rounds times.

    keep holds a round's rows for the next: by default they are persisted; a long run passes a function that writes and reads a table."""
    features = keep(Q.with_features(questions, lexicon))
    own = keep(Q.option_queries(features))
    queries = keep(Q.with_query_features(Q.question_queries(features).unionByName(own)))
    routed = keep(retrieve.route(questions, docs, retrieve.with_candidate_features(candidates), config.doc_k))
    candidates = keep(retrieve.featured(candidates, routed))
    rows = keep(retrieve.best(retrieve.scored(routed, features, queries, candidates), config.option_k, config.question_k))
    now = keep(judged(features, routed, rows, judge, config).withColumn("round", F.lit(0)))
    out = now.select(*RESULT)
    by_label = own.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("label", "query"))).alias("option_queries"))
    for n in range(1, config.repair_rounds + 1):
        todo = now.where(answers.repairable(F.col("needs_review"), F.col("all_warnings")) & (F.col("judge_mode") != "none"))
        if not todo.limit(1).count():
            break
        todo = todo.join(by_label, "qid").withColumn("targets", answers.repair_targets(F.col("options"), F.col("answer_norm"), F.col("needs_review"), F.col("judgement")))
        again = answers.repair_queries(todo).join(own.select("qid", "label", "option_text"), ["qid", "label"])
        more = retrieve.scored(routed, features, Q.with_query_features(again), candidates)
        wide = config.option_k + n * config.repair_k
        ids = todo.select("qid")
        before = rows.join(ids, "qid", "left_semi")
        rows = keep(retrieve.merged(before.where("label IS NOT NULL"), retrieve.best(more, wide, config.question_k), wide).unionByName(before.where("label IS NULL"), allowMissingColumns=True))
        now = keep(judged(features.join(ids, "qid", "left_semi"), routed, rows, judge, replace(config, option_k=wide)).withColumn("round", F.lit(n)))
        out = out.join(ids, "qid", "left_anti").unionByName(now.select(*RESULT))
    return out


def summary(results: DataFrame) -> DataFrame:
    """field, value, n: results by status, domain and round."""
    from .metrics import counters

    return counters(results, "status", "domain", "round")
