"""The driver's tables as documents, candidates, questions and a lexicon, and the same as SQL."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import retrieve

LANGS = ("en", "de", "fr", "es")
FORMATS = ("mcq", "multi", "tf", "numeric")
LEXICON = (("en", ["the", "tion", "and the", "ing"]), ("de", ["der", "keit", "und die"]), ("fr", ["de la", "tion", "eaux"]), ("es", ["mente", "con la", "ción"]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    return read(spark, sf_dir, "documents").select(i.alias("doc_id"), F.col("lang").alias("domain"), F.col("source").alias("source_title"), F.lit("text").alias("source_kind"), F.concat(F.lit("docs/"), i, F.lit(".txt")).alias("source_path"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"^\S+ \S+", 0).alias("section_title"))
    out = retrieve.chunked(spark, own)
    i = F.col("doc_id").cast("string")
    kind = F.when(F.contains("text", F.lit("|")), "table").when(F.length("text") < 80, "heading").otherwise("text")
    return out.select(
        F.concat(i, F.lit("::"), F.lpad(F.col("chunk_no").cast("string"), 6, "0")).alias("candidate_id"), i.alias("doc_id"), "text", "section_title", kind.alias("unit_type"), F.lit("text").alias("modality"),
        F.when(F.col("chunk_no") == 0, "primary").otherwise("").alias("evidence_role"), (F.col("doc_id") % 5 / 4.0 - 0.125).alias("evidence_weight"), F.array().cast("array<string>").alias("numbers"), F.lit(None).cast("int").alias("page_id"),
        F.col("chunk_no").alias("reading_order"), "char_start", "char_end",
    )


def questions(spark: SparkSession, sf_dir: str, given: bool) -> DataFrame:
    """Benchmark items with their text in four options; with three documents each if `given`."""
    i, part = F.col("item_id"), F.ceil(F.length("text") / 4).cast("int")
    option = lambda k: F.concat(F.substr("text", 1 + k * part, part), F.when((i % 2 == 0) & F.lit(k < 2), ("第一份", "第二份")[min(k, 1)]).otherwise(""))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (i % 4).cast("int"))
    ids = F.array(*[x.cast("long").cast("string") for x in (i * 13 % 200, (i * 29 + 1) % 200, (i * 7 + 50) % 200)]) if given else F.array().cast("array<string>")
    return read(spark, sf_dir, "benchmark").select(i.cast("string").alias("qid"), F.col("text").alias("question"), F.create_map(*[x for k in range(4) for x in (F.lit("ABCD"[k]), option(k))]).alias("options"), pick(LANGS).alias("domain"), pick(FORMATS).alias("answer_format"), F.array_distinct(ids).alias("doc_ids"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "domain string, terms array<string>")


# --- the same as SQL ---
WORD = "[A-Za-z0-9][A-Za-z0-9._%/-]*|[一-鿿]{2,}"
PUNCT = r"[\s，。、“”‘’：:；;（）()【】\[\]《》<>？?！!,.·/\\|+\-=*_#`~^$@]+"


def norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '{PUNCT}', '', 'g')"


def nums(x: str) -> str:
    return rf"regexp_extract_all({x}, '(?:^|[^0-9A-Za-z])([-+]?\d+(?:,\d{{3}})*(?:\.\d+)?%?)', 1)[1:120]"


def years(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '(?:19|20)[0-9]{{2}}')))"


def toks(x: str) -> str:
    return f"list_filter(list_transform(list_concat(regexp_extract_all({x}, '{WORD}'), {nums(x)}), lambda w: lower(w)), lambda w: length(w) >= 2)"


def bigrams(x: str) -> str:
    """x: a normalized text."""
    return f"CASE WHEN length({x}) >= 2 THEN list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))) WHEN length({x}) = 1 THEN [{x}] ELSE [] END"


def phrases(x: str, limit: int) -> str:
    items = f"list_concat(list_filter(regexp_extract_all({x}, '{WORD}'), lambda w: length(w) >= 3), {nums(x)})"
    keys = f"list_transform({items}, lambda w: {norm('w')})"
    return f"list_filter({items}, lambda w, i: ({keys})[i] <> '' AND list_position({keys}, ({keys})[i]) = i)[1:{limit}]"


SPLIT = r"""span AS (SELECT doc_id, substr(text, 780 * k + 1, 900) AS raw, 780 * k AS s, text AS whole, k FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 900) / 780.0)) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)),
chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_no, s + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS char_start, s + length(regexp_replace(raw, '\s+$', '')) AS char_end,
  regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, whole FROM span WHERE regexp_matches(raw, '\S'))"""
CAND = (
    SPLIT
    + r""", cand AS (SELECT CAST(doc_id AS VARCHAR) || '::' || lpad(CAST(chunk_no AS VARCHAR), 6, '0') AS candidate_id, CAST(doc_id AS VARCHAR) AS doc_id, text, regexp_extract(whole, '^\S+ \S+') AS section_title,
  CASE WHEN contains(text, '|') THEN 'table' WHEN length(text) < 80 THEN 'heading' ELSE 'text' END AS unit_type, CASE WHEN chunk_no = 0 THEN 'primary' ELSE '' END AS evidence_role, doc_id % 5 / 4.0 - 0.125 AS evidence_weight, chunk_no AS reading_order FROM chunk)"""
)
LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join("('{}', [{}])".format(d, ", ".join("'" + t + "'" for t in ts)) for d, ts in LEXICON) + ") v(domain, terms))"
_PICK = lambda xs: "([" + ", ".join(f"'{x}'" for x in xs) + "])[item_id % 4 + 1]"


def ques(given: bool) -> str:
    ids = "list_distinct([CAST(item_id * 13 % 200 AS VARCHAR), CAST((item_id * 29 + 1) % 200 AS VARCHAR), CAST((item_id * 7 + 50) % 200 AS VARCHAR)])" if given else "CAST([] AS VARCHAR[])"
    if given:  # keep the order of first occurrence
        raw = "[CAST(item_id * 13 % 200 AS VARCHAR), CAST((item_id * 29 + 1) % 200 AS VARCHAR), CAST((item_id * 7 + 50) % 200 AS VARCHAR)]"
        ids = f"list_filter({raw}, lambda x, i: list_position({raw}, x) = i)"
    opt = ", ".join(f"substr(text, 1 + {k} * part, part) || CASE WHEN item_id % 2 = 0 THEN '{('第一份', '第二份', '', '')[k]}' ELSE '' END AS o{k}" for k in range(4))
    return f"""qs0 AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS part FROM benchmark), qs AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS question, {_PICK(LANGS)} AS domain, {_PICK(FORMATS)} AS answer_format, {ids} AS doc_ids, {opt} FROM qs0),
{LEX}, qf AS (SELECT qs.*, terms, concat_ws(chr(10), question, o0, o1, o2, o3) AS joined, {phrases('question', 60)} AS keyphrases, list_filter(terms, lambda t: contains({norm("concat_ws(chr(10), question, o0, o1, o2, o3)")}, {norm('t')})) AS domain_terms FROM qs LEFT JOIN lex USING (domain)),
opts AS (SELECT qid, 'A' AS label, o0 AS option_text FROM qs UNION ALL SELECT qid, 'B', o1 FROM qs UNION ALL SELECT qid, 'C', o2 FROM qs UNION ALL SELECT qid, 'D', o3 FROM qs),
oq AS (SELECT qid, label, option_text, regexp_replace(concat_ws(chr(10), regexp_replace(concat_ws(chr(10), question, array_to_string(keyphrases[1:20], ' '), array_to_string(domain_terms[1:12], ' ')), '^\\s+|\\s+$', '', 'g'), label || '. ' || option_text, array_to_string({phrases('option_text', 60)}[1:20], ' ')), '^\\s+|\\s+$', '', 'g') AS query FROM qf JOIN opts USING (qid)),
sq AS (SELECT qid, '' AS label, '' AS option_text, array_to_string(list_concat([question], keyphrases, domain_terms), chr(10)) AS query FROM qf)"""
