"""Answers: legal forms, matching, judgements in JSON, verification against evidence, citation audits, and what to repair."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T

NONE = "array<string>"
JUDGEMENT = "map<string,struct<verdict:string,evidence_ids:array<string>,reason:string>>"


def letters(answer: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("[ABCD]"), F.lit(0))


def normalize_answer(answer: Column, fmt: Column) -> Column:
    """struct(answer, warnings): sorted distinct letters; for mcq and tf the first, with a warning if others are named."""
    sorted_ = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), "")
    single = fmt.isin("mcq", "tf")

    def of(x: Column) -> Column:
        warnings = F.array_compact(F.array(
            F.when(F.size(x) == 0, "answer_empty"),
            F.when((F.size(x) > 0) & single & (F.size(F.array_distinct(x)) > 1), "format_conflict_multiple_letters_for_single_answer"),
            F.when((F.size(x) > 0) & ~F.coalesce(single | (fmt == "multi"), F.lit(False)), "unknown_answer_format"),
        ))
        return F.struct(F.when(F.size(x) == 0, "").when(single, F.get(x, F.lit(0))).otherwise(sorted_(x)).alias("answer"), warnings.alias("warnings"))

    return T.let(letters(answer), of)


def legal_answer(answer: Column, fmt: Column) -> Column:
    """The reason why an answer isn't legal; empty if it is."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    tidy = F.array_join(F.array_sort(F.array_distinct(F.split(a, ""))), "")
    return (
        F.when(a == "", "empty_answer").when(~a.rlike("^[A-D]+$"), "invalid_characters")
        .when(fmt.isin("mcq", "tf"), F.when(F.length(a) != 1, "single_answer_has_multiple_letters").otherwise(""))
        .when(fmt == "multi", F.when(tidy != a, "multi_answer_not_sorted_unique").otherwise("")).otherwise("unknown_answer_format")
    )


def answer_value(value: Column) -> Column:
    """'yes', 'no' or a number as text rounded to five places, percent as a share; null for what is none of these."""
    v = F.lower(F.trim(value.cast("string")))
    number = F.trim(F.replace(F.regexp_replace(v, "%$", ""), F.lit(","), F.lit(""))).try_cast("double") / F.when(v.endswith("%"), 100.0).otherwise(1.0)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(v.isin("yes", "no"), v).when(finite & v.rlike(r"[0-9]"), F.round(number, 5).cast("string"))


def answer_match(predicted: Column, expected: Column) -> Column:
    return F.coalesce(answer_value(predicted) == answer_value(expected), F.lit(False))


def answer_text(items: Column) -> Column:
    """A list of letters as one string."""
    return F.translate(F.upper(F.array_join(items, "")), " ,;", "")


def json_object(text: Column) -> Column:
    """struct(json, warnings): the text if it is a JSON object, else what stands from the first { to the last }, else null."""
    raw = F.trim(F.coalesce(text, F.lit("")))

    def of(x: Column) -> Column:
        is_object = lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))
        parses = F.try_parse_json(x).isNotNull()
        inner = F.regexp_extract(x, r"(?s)\{.*\}", 0)
        found = F.when(parses, F.when(is_object(x), x)).when(is_object(inner), inner)
        return F.struct(found.alias("json"), F.array_compact(F.array(F.when(x == "", "judge_response_empty"), F.when((x != "") & ~parses, "judge_response_required_json_extraction"))).alias("warnings"))

    return T.let(raw, of)


def judgements(json: Column, labels: Column) -> Column:
    """map label -> struct(verdict, evidence_ids, reason) for every label: unknown verdicts made UNKNOWN, ids that are no integers dropped, reasons cut at 500 characters."""
    raw = F.from_json(F.get_json_object(json, "$.option_judgement"), "map<string,string>")

    def one(label: Column) -> Column:
        item = F.element_at(raw, label)
        is_object = F.coalesce(item.startswith("{"), F.lit(False))
        verdict = F.upper(F.coalesce(F.get_json_object(item, "$.verdict"), F.lit("UNKNOWN")))
        ids = F.coalesce(F.from_json(F.get_json_object(item, "$.evidence_ids"), "array<string>"), F.array().cast(NONE))
        clean = F.filter(F.transform(ids, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
        none = F.struct(F.lit("UNKNOWN").alias("verdict"), F.array().cast("array<int>").alias("evidence_ids"), F.when(raw.isNull(), "Missing option_judgement object.").otherwise("Missing judgement for option.").alias("reason"))
        good = F.struct(F.when(verdict.isin("TRUE", "FALSE", "UNKNOWN"), verdict).otherwise("UNKNOWN").alias("verdict"), clean.alias("evidence_ids"), F.left(F.coalesce(F.get_json_object(item, "$.reason"), F.lit("")), F.lit(500)).alias("reason"))
        return F.when(is_object, good).otherwise(none)

    return F.map_from_arrays(F.array_sort(labels), F.transform(F.array_sort(labels), one))


def no_judge(labels: Column) -> Column:
    """UNKNOWN for every label, without evidence."""
    item = F.struct(F.lit("UNKNOWN").alias("verdict"), F.array().cast("array<int>").alias("evidence_ids"), F.lit("model_judge_not_run").alias("reason"))
    return F.map_from_arrays(F.array_sort(labels), F.transform(F.array_sort(labels), lambda _: item))


def prior_judge(labels: Column, prior: Column, evidence: Column) -> Column:
    """TRUE for the letters of a prior answer, FALSE for others, each with the first three evidence ids that its option found.

    evidence: array<struct(evidence_id, retrieval_options)>."""
    ids = lambda x: F.slice(F.transform(F.filter(evidence, lambda e: F.array_contains(e.retrieval_options, x)), lambda e: e.evidence_id), 1, 3)
    one = lambda x: F.struct(F.when(F.array_contains(letters(prior), x), "TRUE").otherwise("FALSE").alias("verdict"), ids(x).alias("evidence_ids"), F.lit("prior answer").alias("reason"))
    return F.map_from_arrays(F.array_sort(labels), F.transform(F.array_sort(labels), one))


def verified(df: DataFrame) -> DataFrame:
    """df with status, all_warnings and needs_review.

    df: question, options, answer_format, task_flags, feature_warnings, judge_warnings, judge_status, answer_raw, answer_norm, judgement (of judgements()), evidence
    (array<struct(doc_id, text, options)>) and candidate_docs. A year or number of the question and the chosen options must be in the evidence, any one of them."""
    fmt, norm = F.col("answer_format"), F.coalesce("answer_norm", F.lit(""))
    df = df.withColumn("_sel", F.array_sort(F.array_distinct(letters(norm))))
    routed = F.flatten(F.transform("evidence", lambda e: F.coalesce(e.options, F.array().cast(NONE))))
    bare = F.transform(F.filter("_sel", lambda x: ~F.array_contains(routed, x)), lambda x: F.concat(F.lit("selected_option_without_retrieved_evidence:"), x))
    unknown = F.size(F.filter(F.map_values("judgement"), lambda x: x.verdict == "UNKNOWN")) >= 2
    all_ = (fmt == "multi") & (norm == "ABCD")
    few = F.array_contains("task_flags", "cross_document") & (F.size("candidate_docs") >= 2) & (F.size(F.array_distinct(F.filter(F.transform("evidence", lambda e: e.doc_id), lambda d: d.isNotNull() & (d != "")))) < 2)
    shown = F.array_join(F.transform("evidence", lambda e: F.coalesce(e.text, F.lit(""))), "\n")
    picked = F.when(F.size("_sel") > 0, F.col("_sel")).otherwise(F.array_sort(F.map_keys("options")))
    needed = F.array_join(F.concat(F.array("question"), F.transform(picked, lambda x: F.coalesce(F.element_at("options", x), F.lit("")))), "\n")
    lacks = lambda want, have: (F.size(want) > 0) & ~F.arrays_overlap(want, have)
    year, number = lacks(T.years(needed), T.years(shown)), lacks(T.required_numbers(needed), T.numbers(shown))
    flags = [F.when(unknown, "unknown_heavy"), F.when(all_, "answer_suspicious_all_options"), F.when(few, "doc_imbalance_for_cross_document_question"), F.when(year, "missing_year_in_packed_evidence"), F.when(number, "missing_number_in_packed_evidence")]
    both = F.concat(bare, F.array_compact(F.array(*flags)))
    own = normalize_answer(F.col("answer_raw"), fmt).warnings
    warnings = F.array_sort(F.array_distinct(F.concat("feature_warnings", "judge_warnings", own, both)))
    conflict = F.lit("format_conflict_multiple_letters_for_single_answer")
    df = df.withColumn("all_warnings", warnings)
    review = F.concat(both, F.array_compact(F.array(F.when(norm == "", "answer_empty"), F.when(F.array_contains("all_warnings", conflict), conflict))))
    df = df.withColumn("needs_review", F.array_sort(F.array_distinct(review)))
    status = F.when(F.array_contains("all_warnings", "model_judge_not_run"), "needs_model_judge").when(F.size("needs_review") > 0, "needs_review").otherwise(F.col("judge_status"))
    return df.withColumn("status", status).drop("_sel")


def validated(df: DataFrame) -> DataFrame:
    """df with valid_answer, valid_status and problems: quotes' hashes, ids that are unique and cited, verdicts that agree with the answer.

    df: options, answer_format, answer_raw, judge_mode, judge_status, judgement and evidence (array<struct(evidence_id, text, quote_sha256)>)."""
    norm = normalize_answer(F.col("answer_raw"), F.col("answer_format"))
    ids = F.transform("evidence", lambda e: e.evidence_id)
    tampered = F.exists("evidence", lambda e: F.sha2(e.text, 256) != e.quote_sha256)
    base = F.array_compact(F.array(F.when(tampered, "quote_hash_mismatch"), F.when(F.size(F.array_distinct(ids)) != F.size("evidence"), "duplicate_evidence_ids")))
    labels = F.array_sort(F.map_keys("options"))

    def of(x: Column) -> Column:
        j = F.element_at("judgement", x)
        wrong = F.exists(F.coalesce(j.evidence_ids, F.array().cast("array<int>")), lambda i: ~F.array_contains(ids, i))
        none = wrong | (F.coalesce(F.size(j.evidence_ids), F.lit(0)) <= 0)
        say = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.concat(F.lit(f"{name}:"), x))
        known = F.coalesce(j.verdict.isin("TRUE", "FALSE", "UNKNOWN"), F.lit(False))
        return F.array_compact(F.array(say(wrong, "invalid_citation"), say(~known, "invalid_verdict"), say(j.verdict.isin("TRUE", "FALSE") & none, "uncited_verdict"), say(j.verdict == "UNKNOWN", "insufficient_evidence")))

    true = F.array_join(F.filter(labels, lambda x: F.coalesce(F.element_at("judgement", x).verdict == "TRUE", F.lit(False))), "")
    rest = F.array_compact(F.array(F.when(true != norm.answer, "answer_verdict_mismatch"), F.when(norm.answer == "", "empty_answer"), F.when(F.col("judge_status") != "model_judged", F.concat(F.lit("judge_status:"), "judge_status"))))
    problems = F.when(F.col("judge_mode") == "none", base).otherwise(F.concat(base, norm.warnings, F.flatten(F.transform(labels, of)), rest))
    df = df.withColumn("problems", F.array_sort(F.array_distinct(problems)))
    status = F.when(F.col("judge_mode") == "none", "needs_model_judge").when(F.size("problems") > 0, "needs_review").otherwise("validated_structure")
    return df.withColumn("valid_answer", F.when(F.col("judge_mode") == "none", "").otherwise(norm.answer)).withColumn("valid_status", status)


# The warnings that a further search may mend, by their beginnings.
REPAIRABLE = ("selected_option_without_retrieved_evidence", "missing_number_in_packed_evidence", "missing_year_in_packed_evidence", "doc_imbalance_for_cross_document_question", "unknown_heavy", "answer_empty")


def repairable(needs_review: Column, warnings: Column) -> Column:
    return F.exists(F.concat(needs_review, warnings), lambda x: F.greatest(*[x.startswith(p) for p in REPAIRABLE]))


def repair_targets(options: Column, answer_norm: Column, needs_review: Column, judgement: Column) -> Column:
    """The labels to search for again: those named without evidence, else those chosen, else the unknown ones, else all."""
    own = F.array_sort(F.map_keys(options))
    prefix = "selected_option_without_retrieved_evidence:"
    named = F.array_intersect(own, F.transform(F.filter(needs_review, lambda x: x.startswith(prefix)), lambda x: F.upper(F.trim(F.substr(x, F.lit(len(prefix) + 1))))))
    chosen = F.array_intersect(own, letters(answer_norm))
    unknown = F.filter(own, lambda x: F.coalesce(F.element_at(judgement, x).verdict == "UNKNOWN", F.lit(False)))
    return F.when(F.size(named) > 0, named).when(F.size(chosen) > 0, chosen).when(F.size(unknown) > 0, unknown).otherwise(own)


# Words added to a repair query, general and by what is missing.
MORE, MORE_BY = ("evidence", "original figures", "unit", "formula", "clause"), {"missing_number_in_packed_evidence": ("amount", "share", "threshold"), "missing_year_in_packed_evidence": ("year", "date", "period"), "doc_imbalance_for_cross_document_question": ("first", "second", "both", "compared")}


def repair_queries(df: DataFrame) -> DataFrame:
    """qid, label, query for each target: the option's query and text, words for what is missing, and the question's numbers, years and clauses twice, which raises their weight.

    df: qid, options, option_queries (map), numbers, years, clauses, domain_terms, needs_review, all_warnings, targets."""
    reasons = F.concat("needs_review", "all_warnings")
    twice = lambda c: F.concat(F.col(c), F.col(c))
    lits = lambda xs: F.array(*map(F.lit, xs))
    none = F.array().cast(NONE)
    more = lambda name, *extra: F.when(F.array_contains(reasons, name), F.concat(lits(MORE_BY[name]), *extra)).otherwise(none)
    terms = F.concat(
        lits(MORE), more("missing_number_in_packed_evidence", twice("numbers")), more("missing_year_in_packed_evidence", twice("years")), more("doc_imbalance_for_cross_document_question"),
        F.when(F.size("clauses") > 0, twice("clauses")).otherwise(none), F.col("domain_terms"),
    )
    q = df.select("qid", "options", "option_queries", F.array_join(terms, "\n").alias("suffix"), F.explode("targets").alias("label"))
    own = F.concat(F.col("label"), F.lit(". "), F.coalesce(F.element_at("options", F.col("label")), F.lit("")))
    parts = F.filter(F.array(F.coalesce(F.element_at("option_queries", F.col("label")), F.lit("")), own, F.col("suffix")), lambda x: x != "")
    return q.select("qid", "label", F.array_join(parts, "\n").alias("query"))


def judged(spark: SparkSession, prompts: DataFrame, complete) -> DataFrame:
    """prompts (qid, prompt) with the response of complete(prompt), asked once for equal prompts; complete is any picklable function, a client or a fake."""
    once = prompts.select(F.sha2("prompt", 256).alias("request"), "prompt").dropDuplicates(["request"])

    def run(batches):
        for b in batches:
            yield b[["request"]].assign(response=[complete(p) for p in b["prompt"]])

    answered = once.mapInPandas(run, "request string, response string")
    return prompts.withColumn("request", F.sha2("prompt", 256)).join(answered, "request").select("qid", "request", "response")
