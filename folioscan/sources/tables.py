"""Sources: JSON lines with an explicit schema and coercion on read, answers in CSV, question files, adapters of benchmark data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import chunk, html
from folioscan.functions import text as T

RAW = {"qid": "string", "domain": "string", "split": "string", "question": "string", "options": "map<string,string>", "answer_format": "string", "type": "string", "doc_ids": "array<string>", "context_fact_ids": "array<string>"}
UNIT = {
    "candidate_id": "string", "unit_id": "string", "doc_id": "string", "text": "string", "page_id": "string", "section_title": "string", "unit_type": "string", "modality": "string", "evidence_role": "string",
    "quality_tier": "string", "quality_flags": "array<string>", "evidence_weight": "string", "numbers": "array<string>", "source_name": "string", "reading_order": "string", "locator": "string",
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and lines that hold no object are left out, a malformed line fails the job with its text and place."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    bad = F.concat(F.lit("malformed JSON line in "), F.input_file_name(), F.lit(": "), F.left("value", F.lit(200)))
    ok = F.when(parsed.isNull(), F.raise_error(bad).cast("boolean")).otherwise(F.schema_of_variant(parsed).startswith("OBJECT"))
    return lines.where(ok).select(F.from_json("value", ddl(fields)).alias("r")).select("r.*")


def jsonl_or_empty(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """As jsonl(), but a missing file is an empty table."""
    return jsonl(spark, path, fields) if exists(spark, path) else spark.createDataFrame([], ddl(fields))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)


def as_questions(rows: DataFrame) -> DataFrame:
    """Rows of RAW's fields coerced: missing texts are empty, missing lists and options are empty too."""
    options = F.coalesce("options", F.create_map().cast("map<string,string>")).alias("options")
    return rows.select(*[_text(c) for c in ("qid", "domain", "split", "question")], options, _text("answer_format"), _text("type"), _list("doc_ids"), _list("context_fact_ids"))


def as_candidates(rows: DataFrame) -> DataFrame:
    """Rows of UNIT's fields coerced: each id stands in for the other, what is no integer is null, what is no weight is 1."""
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("")).alias(a)
    whole = lambda c: F.trim(c).try_cast("int").alias(c)
    texts = ("doc_id", "text", "section_title", "unit_type", "modality", "evidence_role", "quality_tier", "source_name")
    weight = F.coalesce(F.trim("evidence_weight").try_cast("double"), F.lit(1.0)).alias("evidence_weight")
    return rows.select(either("candidate_id", "unit_id"), either("unit_id", "candidate_id"), *[_text(c) for c in texts], whole("page_id"), whole("reading_order"), weight, _list("quality_flags"), _list("numbers"), "locator")


def question_filter(questions: DataFrame, split: str | None = None, qids: list[str] | None = None, limit: int | None = None, order: str = "qid") -> DataFrame:
    """By split, then ids, then the first `limit` in order."""
    out = questions if split is None else questions.where(F.col("split") == split)
    out = out.where(F.col("qid").isin(qids)) if qids else out
    return out if limit is None else out.orderBy(order).limit(limit)


def prior_answers(spark: SparkSession, path: str) -> DataFrame:
    """qid, answer of a CSV of answers: no summary row, the first answer column that isn't empty, in upper case; of repeated ids the last row counts."""
    rows = spark.read.option("header", True).csv(path)
    for c in ("answer", "answer_draft_second_pass", "answer_draft"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.select(F.trim("qid").alias("qid"), F.upper(F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in ("answer", "answer_draft_second_pass", "answer_draft")], F.lit("")))).alias("answer"), F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("at"))
    return rows.where("qid IS NOT NULL AND qid != '' AND qid != 'summary'").groupBy("qid").agg(F.max_by("answer", "at").alias("answer"))


def question_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Every question of *_questions.json files (arrays), with the file it stands in and its place there."""
    rows = spark.read.schema(ddl(RAW)).option("multiLine", True).json(f"{folder}/*_questions.json")
    return as_questions(rows).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("at", F.monotonically_increasing_id())


def first_of_each_file(refs: DataFrame, n: int) -> DataFrame:
    return refs.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("_r") <= n).drop("_r")


def doc_manifest(refs: DataFrame) -> DataFrame:
    """domain, doc_id with the sorted sets of what asks for a document, and how many questions do."""
    one = refs.select("domain", "qid", "type", "answer_format", "file", F.explode("doc_ids").alias("doc_id"))
    of = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return one.groupBy("domain", "doc_id").agg(of("qid").alias("question_ids"), of("type").alias("types"), of("answer_format").alias("formats"), of("file").alias("files"), F.countDistinct("qid").alias("question_count"))


def resolved(manifest: DataFrame, listing: DataFrame, routes: dict[str, tuple[str, ...]], other: tuple[str, ...] = (".pdf", ".txt", ".md", ".html")) -> DataFrame:
    """manifest with the path of each document's source: of a domain's suffixes the first for which the listing (domain, path) has its stem, whatever the case."""
    files = listing.select(F.col("domain").alias("_d"), "path", F.lower(F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)).alias("_stem"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))
    order = F.create_map(*[x for d, s in routes.items() for x in (F.lit(d), F.array(*map(F.lit, s)))]) if routes else F.create_map().cast("map<string,array<string>>")
    met = manifest.join(files, (F.col("domain") == F.col("_d")) & (F.lower("doc_id") == F.col("_stem")), "left")
    rank = F.array_position(F.coalesce(F.element_at(order, F.col("domain")), F.array(*map(F.lit, other))), F.col("suffix"))
    best = Window.partitionBy("domain", "doc_id").orderBy(F.when(rank > 0, rank).asc_nulls_last(), "path")
    out = met.withColumn("_p", F.when(rank > 0, F.col("path"))).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return out.select(*manifest.columns, F.col("_p").alias("path"), F.when(F.col("_p").isNotNull(), F.col("suffix")).alias("suffix"), F.col("_p").isNotNull().alias("source_exists"))


def raw_candidates(sources: DataFrame, size: int = 1400, overlap: int = 180) -> DataFrame:
    """Candidates made from whole sources (doc_id, domain, source_path, content): text of pages and plain files, cut by paragraphs; other kinds give none."""
    suffix = F.lower(F.regexp_extract("source_path", r"(\.[^./]+)$", 1))
    text = F.when(suffix.isin(".html", ".htm"), html.parsed(F.col("content"))).when(suffix.isin(".txt", ".md"), T.clean(F.col("content")))
    own = sources.where("doc_id != ''").select("doc_id", "domain", "source_path", text.alias("text")).where("text IS NOT NULL")
    rows = own.select("doc_id", "domain", "source_path", F.posexplode(chunk.split_text(F.col("text"), size, overlap)).alias("i", "s"))
    unit = F.concat(F.col("doc_id"), F.lit("::raw::"), F.lpad((F.col("i") + 1).cast("string"), 6, "0"))
    digest = F.left(F.sha1(F.concat_ws(":", "doc_id", "s.start", "s.end", F.left("s.text", F.lit(200)))), F.lit(12))
    return rows.select(F.concat_ws(":", unit, digest).alias("candidate_id"), unit.alias("unit_id"), "doc_id", F.col("s.text").alias("text"), F.lit("").alias("section_title"), F.lit("raw_text").alias("unit_type"), F.lit("text").alias("modality"), F.lit("primary").alias("evidence_role"), F.lit(1.0).alias("evidence_weight"), T.numbers(F.col("s.text")).alias("numbers"), F.lit(None).cast("int").alias("page_id"), (F.col("i") + 1).alias("reading_order"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


def with_fallback(candidates: DataFrame, sources: DataFrame, size: int = 1400, overlap: int = 180) -> DataFrame:
    """candidates, and for documents that have none those made from their source."""
    bare = sources.join(candidates.select("doc_id").distinct(), "doc_id", "left_anti")
    return candidates.unionByName(raw_candidates(bare, size, overlap), allowMissingColumns=True)


def adapted(questions: DataFrame, documents: DataFrame, size: int = 900, overlap: int = 120) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions by a whitelist of columns, documents that they name, and page chunks of these; repeated ids and missing documents are refused.

    The whitelist keeps labels of a source away from whatever answers."""
    q = as_questions(questions.select([c for c in RAW if c in questions.columns]) if set(RAW) <= set(questions.columns) else questions)
    if q.groupBy("qid").count().where("count > 1").limit(1).count():
        raise ValueError("Duplicate question ids")
    wanted = q.select(F.explode("doc_ids").alias("doc_id")).distinct()
    if wanted.join(documents, "doc_id", "left_anti").limit(1).count():
        raise ValueError("Missing referenced documents")
    docs = documents.join(wanted, "doc_id", "left_semi")
    return q, docs.select("doc_id", "domain", F.col("title").alias("source_title")), chunk.page_chunks(docs.select("doc_id", "text"), size, overlap)


def table_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, candidates, gold) of rows id, pre_text, post_text, table and qa(question, gold_inds, exe_ans): a unit for each sentence and table row; gold stays apart."""
    q = rows.select(F.col("id").alias("qid"), F.col("qa.question").alias("question"), F.lit("financial_reports").alias("domain"), F.create_map().cast("map<string,string>").alias("options"), F.lit("numeric").alias("answer_format"), F.array("id").alias("doc_ids"))
    texts = F.transform(F.concat("pre_text", "post_text"), lambda t, i: F.struct(F.concat(F.lit("text_"), i.cast("string")).alias("fact"), t.alias("text"), F.lit("text").alias("kind")))
    cells = F.transform("table", lambda r, i: F.struct(F.concat(F.lit("table_"), i.cast("string")).alias("fact"), T.table_row_text(F.get("table", F.lit(0)), r).alias("text"), F.lit("table").alias("kind")))
    units = rows.select(F.col("id").alias("doc_id"), F.posexplode(F.concat(texts, cells)).alias("reading_order", "u"))
    units = units.select(F.concat_ws("::", "doc_id", "u.fact").alias("candidate_id"), "doc_id", F.col("u.text").alias("text"), F.col("u.kind").alias("unit_type"), F.col("u.kind").alias("modality"), "reading_order", F.lit(1.0).alias("evidence_weight"), F.col("u.fact").alias("fact_id"), F.sha2("u.text", 256).alias("quote_sha256"))
    return q, units, rows.select(F.col("id").alias("qid"), F.map_keys("qa.gold_inds").alias("facts"), F.col("qa.exe_ans").alias("answer"))


def structured_rows(rows: DataFrame) -> DataFrame:
    """candidate_id, text: table rows as JSON of cells and column labels; the first row is a header only if no cell after its first is a number."""
    header = F.get("table", F.lit(0))
    named = (F.size(header) > 1) & F.forall(F.slice(header, 2, F.greatest(F.size(header) - 1, F.lit(1))), lambda x: ~x.rlike(r"^[($-]*\d")) & F.exists(F.slice(header, 2, F.greatest(F.size(header) - 1, F.lit(1))), lambda x: x != "")
    body = rows.select("id", F.when(named, header).otherwise(F.array().cast("array<string>")).alias("labels"), F.posexplode("table").alias("i", "cells"))
    return body.select(F.concat(F.col("id"), F.lit("::table_"), F.col("i").cast("string")).alias("candidate_id"), F.to_json(F.struct("cells", F.col("labels").alias("column_labels"))).alias("text"))
