"""Joins, aggregates, audits, samples and run state over the driver's tables."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import metrics
from folioscan.sources import sinks, tables

from . import adapters as A

C = F.col


def domain_join(spark, sf_dir):
    """Questions with the documents that their domain allows, by source: an empty domain on either side allows all, joined by branches instead of a nested loop."""
    q = A.questions(spark, sf_dir, False).select("qid", F.when(C("qid").cast("long") % 5 == 0, "").otherwise(C("domain")).alias("domain"))
    d = A.docs(spark, sf_dir).select("doc_id", "source_title", F.when(C("doc_id").cast("long") % 7 == 0, "").otherwise(C("domain")).alias("doc_domain"))
    by = d.groupBy("doc_domain", "source_title").agg(F.count("*").alias("n"))
    q = F.broadcast(q)  # one batch of questions
    equal = by.where("doc_domain != ''").join(q.where("domain != ''"), C("domain") == C("doc_domain"))
    open_docs = by.where("doc_domain = ''").join(q, F.lit(True))
    open_questions = by.where("doc_domain != ''").join(q.where("domain = ''"), F.lit(True))
    return equal.unionByName(open_docs).unionByName(open_questions).groupBy("qid", "source_title").agg(F.sum("n").alias("docs"))


def unlabelled(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", "source").join(A.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def labelled_chunks(spark, sf_dir):
    """Chunks of documents that are labelled good, by a left semi join."""
    good = A.read(spark, sf_dir, "labels").where("quality = 1").select(C("doc_id").cast("string"))
    return A.candidates(spark, sf_dir).join(good, "doc_id", "left_semi").select("candidate_id", "doc_id")


def chunk_meta(spark, sf_dir):
    """Chunks by document with metadata; those of unknown documents are dropped and counted."""
    known = A.docs(spark, sf_dir).where("CAST(doc_id AS BIGINT) % 4 != 1")
    c = A.candidates(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    met = c.join(known, "doc_id").select("doc_id", "chunks", "source_title")
    gone = c.join(known, "doc_id", "left_anti").agg(F.lit("dropped").alias("doc_id"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.lit("").alias("source_title"))
    return met.unionByName(gone)


def quality_defaults(spark, sf_dir):
    lab = A.read(spark, sf_dir, "labels")
    return A.read(spark, sf_dir, "documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.coalesce(C("quality").cast("string"), F.lit("unlabeled")).alias("quality"), F.coalesce(C("quality").cast("double"), F.lit(0.5)).alias("score"))


def parser_kinds(spark, sf_dir):
    """Documents with what parsed them: labelled ones, long ones, or none."""
    d = A.read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(A.read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("ir")), "doc_id", "left")
    return d.select("doc_id", F.when(C("ir").isNotNull(), "ir").when(C("n_chars") > 2000, "text").otherwise("missing").alias("parser"))


def draft_accounting(spark, sf_dir):
    """Annotations and drafts by a full outer join: which side each id is on."""
    a = A.read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l"))
    d = A.read(spark, sf_dir, "documents").where("doc_id % 3 != 0").select("doc_id", F.lit(True).alias("r"))
    side = F.when(C("l") & C("r"), "both").when(C("l"), "left_only").otherwise("right_only")
    return a.join(d, "doc_id", "full_outer").select(side.alias("side")).groupBy("side").agg(F.count("*").alias("n"))


def draft_bank(spark, sf_dir):
    """Missing and extra ids of drafts against the bank of questions."""
    bank = A.read(spark, sf_dir, "benchmark").select("item_id")
    drafts = A.read(spark, sf_dir, "benchmark").select((C("item_id") * 2).alias("item_id"))
    return bank.join(drafts, "item_id", "left_anti").withColumn("kind", F.lit("missing")).unionByName(drafts.join(bank, "item_id", "left_anti").withColumn("kind", F.lit("extra")))


def second_pass(spark, sf_dir):
    """Answers after a second review, and whether it changed them."""
    own = A.read(spark, sf_dir, "labels").select("doc_id", F.when(C("quality") == 1, "A").otherwise("B").alias("answer"))
    review = A.read(spark, sf_dir, "labels").where("doc_id % 2 = 0").select("doc_id", F.when(C("toxic") == 1, "B").otherwise("A").alias("reviewed"))
    return own.join(review, "doc_id", "left").select("doc_id", F.coalesce("reviewed", "answer").alias("final"), F.coalesce(C("reviewed") != C("answer"), F.lit(False)).alias("changed"))


def page_range_jobs(spark, sf_dir):
    """Documents of up to 3 pages of 1,000 characters go whole, longer ones in ranges of 3 pages, those without text are missing."""
    d = A.read(spark, sf_dir, "documents").select("doc_id", F.ceil(F.coalesce("n_chars", F.lit(0)) / 1000).cast("int").alias("pages"))
    direct = d.where("pages BETWEEN 1 AND 3").select("doc_id", F.lit("direct").alias("route"), F.lit(1).alias("first"), C("pages").alias("last"))
    missing = d.where("pages = 0").select("doc_id", F.lit("missing").alias("route"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    many = d.where("pages > 3").select("doc_id", "pages", F.explode(F.sequence(F.lit(1), C("pages"), F.lit(3))).alias("first"))
    return direct.unionByName(missing).unionByName(many.select("doc_id", F.lit("range").alias("route"), "first", F.least(C("first") + 2, C("pages")).alias("last")))


def id_remap(spark, sf_dir):
    """References prefixed by their part through a map; those that it doesn't know stay."""
    refs = A.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("b"), C("turn").cast("string")).alias("ref"))
    m = refs.where("turn % 2 = 0").select("conv_id", "ref", F.concat(F.lit("p"), (C("turn") / 2).cast("int").cast("string"), F.lit("_"), "ref").alias("new")).distinct()
    return refs.join(m, ["conv_id", "ref"], "left").select("conv_id", "turn", F.coalesce("new", "ref").alias("ref"))


def reference_coverage(spark, sf_dir):
    """Questions any of whose documents has a chunk."""
    q = A.questions(spark, sf_dir, True).select("qid", F.explode("doc_ids").alias("doc_id"))
    has = A.candidates(spark, sf_dir).where("evidence_weight > 0.5").select("doc_id").distinct()
    met = q.join(has, "doc_id", "left_semi").select("qid").distinct().withColumn("covered", F.lit(True))
    return q.select("qid").distinct().join(met, "qid", "left").select("qid", F.coalesce("covered", F.lit(False)).alias("covered"))


def doc_manifest(spark, sf_dir):
    refs = A.questions(spark, sf_dir, True).select("qid", "domain", F.lit("").alias("type"), "answer_format", "doc_ids", F.concat("domain", F.lit("_questions.json")).alias("file"))
    m = tables.doc_manifest(refs)
    return m.select("domain", "doc_id", *[F.array_join(c, ",").alias(c) for c in ("question_ids", "types", "formats", "files")], "question_count")


def source_manifest(spark, sf_dir):
    """Counts of documents by source: total, missing, long and short ones."""
    n = F.coalesce("n_chars", F.lit(0))
    return A.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(n == 0).alias("missing"), F.count_if(n > 2000).alias("pdf"), F.count_if((n > 0) & (n <= 2000)).alias("non_pdf"))


def corpus_audit(spark, sf_dir):
    """Counters of chunks by kind and role, orphans and suspicious negatives, in one table."""
    c = A.candidates(spark, sf_dir)
    counts = metrics.counters(c, "unit_type", "evidence_role")
    orphans = c.join(A.docs(spark, sf_dir).where("CAST(doc_id AS BIGINT) % 10 != 0"), "doc_id", "left_anti").agg(F.lit("orphans").alias("field"), F.lit("").alias("value"), F.count("*").alias("n"))
    negative = c.select(F.explode(F.filter(T.numbers(C("text")), lambda x: x.startswith("-"))).alias("t"), "text").agg(F.lit("negatives").alias("field"), F.lit("").alias("value"), F.count("*").alias("n"))
    return counts.unionByName(orphans).unionByName(negative)


def field_counters(spark, sf_dir):
    return metrics.counters(A.read(spark, sf_dir, "labels"), "quality", "toxic")


def run_summary(spark, sf_dir):
    """Status counts and token sums of the request log, by kind and in all."""
    e = A.read(spark, sf_dir, "events")
    return e.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("tokens"), F.countDistinct("user_id").alias("users"))


def top_warnings(spark, sf_dir):
    """The 5 most frequent words of conversations' first turns, the first seen on a tie."""
    first = A.read(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.split("text", " ").alias("words"))
    return metrics.top_warnings(first, "words", [C("conv_id")], 5)


def duplicate_orders(spark, sf_dir):
    return metrics.duplicated(A.read(spark, sf_dir, "orders"), "o_custkey")


def order_reconciliation(spark, sf_dir):
    """Orders whose lines are missing or don't reach the given total."""
    lines = A.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(C("l_extendedprice")), 2).alias("lines"), F.count("*").alias("n"))
    o = A.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.join(lines, C("o_orderkey") == C("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.abs(C("lines") - C("o_totalprice")) > 0.01, F.lit(True)).alias("mismatch"))


def answer_table(spark, sf_dir):
    """Answers with their summary row."""
    r = A.read(spark, sf_dir, "labels").select(C("doc_id").cast("string").alias("qid"), F.when(C("quality") == 1, "A").alias("answer"), (C("doc_id") % 100).alias("prompt_tokens"), C("toxic").cast("long").alias("completion_tokens"))
    return sinks.answer_rows(r.withColumn("total_tokens", C("prompt_tokens") + C("completion_tokens")))


def label_totals(spark, sf_dir):
    j = A.read(spark, sf_dir, "labels").join(A.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


def _variants(spark, sf_dir):
    j = A.read(spark, sf_dir, "labels").join(A.read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    v = F.explode(F.array(F.struct(F.lit("full").alias("variant"), C("quality").cast("int").alias("hit")), F.struct(F.lit("toxic").alias("variant"), C("toxic").cast("int").alias("hit")), F.struct(F.lit("odd").alias("variant"), (C("doc_id") % 2).cast("int").alias("hit"))))
    return j.select("doc_id", "lang", "source", v.alias("v")).select("doc_id", "lang", "source", "v.variant", "v.hit")


def metric_sets(spark, sf_dir):
    """Means by variant, and by variant and kind."""
    return metrics.by_sets(_variants(spark, sf_dir), "variant", "lang", ["hit"]).withColumn("mean_hit", F.round("mean_hit", 6))


def paired_differences(spark, sf_dir):
    """Wins and losses of each variant against the full one."""
    return metrics.wins(metrics.paired(_variants(spark, sf_dir), "doc_id", "variant", "full", "hit"), "variant").withColumn("mean_difference", F.round("mean_difference", 6))


def cluster_bootstrap(spark, sf_dir):
    """Differences with their intervals over sources drawn with return; the draws are ours, so SQL can't tell them."""
    return metrics.cluster_interval(metrics.paired(_variants(spark, sf_dir), "doc_id", "variant", "full", "hit"), "source", ["variant"], 500)


def cluster_points(spark, sf_dir):
    return cluster_bootstrap(spark, sf_dir).select("variant", "clusters", F.round("difference", 6).alias("difference"))


def population_estimate(spark, sf_dir):
    """The share of good documents, estimated by language and weighted by how many documents each has."""
    sizes = A.read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("size"))
    full = _variants(spark, sf_dir).where("variant = 'full'")
    return metrics.weighted(full, sizes, "lang", "hit").withColumn("estimate", F.round("estimate", 6))


def percentile_nearest_rank(spark, sf_dir):
    out = metrics.nearest_rank(A.read(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95])
    mid = A.read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))
    return out.join(mid, "event_type")


def hash_stratified_sample(spark, sf_dir):
    d = A.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return metrics.stratified(d, "lang", "doc_id", "salt:", 20).select("doc_id", "lang", "h", C("rank").cast("long"), C("place").cast("long"))


def ordered_concat(spark, sf_dir):
    """Each conversation as one Markdown text in turn order, and the state of its parts."""
    c = A.read(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    out = c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: F.concat(F.lit("**"), x.role, F.lit("** "), x.text)), "\n\n").alias("markdown"), F.count("*").alias("parts"), F.count_if(C("role") == "assistant").alias("done"))
    state = F.when(C("done") == 0, "failed").when(C("done") * 2 >= C("parts"), "done").otherwise("partial")
    return out.select("conv_id", F.sha2("markdown", 256).alias("markdown"), "parts", state.alias("state"))


def grouped_jobs(spark, sf_dir):
    """Each source's documents in order of length, then id."""
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    return A.read(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("place"))


def chunk_order(spark, sf_dir):
    """The first 50 chunks by domain, document and chunk as text: the order of an export."""
    c = A.candidates(spark, sf_dir).join(A.docs(spark, sf_dir), "doc_id")
    return c.orderBy("domain", "doc_id", "candidate_id").limit(50).select("domain", "doc_id", "candidate_id")


def prompt_char_budget(spark, sf_dir):
    """Turns of each conversation that fit in 2,000 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = A.read(spark, sf_dir, "conversations").withColumn("used", F.sum(F.length("text")).over(w))
    return c.where("used <= 2000").select("conv_id", "turn", "used")


def resume_anti_join(spark, sf_dir):
    """Users without a checkpoint of this run, for which every twentieth purchase stands."""
    users = A.read(spark, sf_dir, "events").select(C("user_id").alias("qid")).distinct()
    done = A.read(spark, sf_dir, "events").where("event_type = 'purchase' AND event_id % 20 = 0").select(F.lit("k").alias("run_key"), C("user_id").alias("qid"))
    return sinks.pending(users, done, "k")


def latest_checkpoint(spark, sf_dir):
    e = A.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return sinks.latest(e, ("user_id", "event_type"), ("event_id",))


def request_dedupe(spark, sf_dir):
    """Equal payloads once, without those that the log knows."""
    e = A.read(spark, sf_dir, "events").select(F.concat_ws("|", "event_type", "props").alias("payload"))
    log = A.read(spark, sf_dir, "events").where("event_type = 'error'").select(F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("request")).distinct()
    return sinks.distinct_requests(e, "payload", log)


def prediction_gold(spark, sf_dir):
    """Predictions joined with gold, by cohort and arm."""
    lab = A.read(spark, sf_dir, "labels")
    p = lab.select("doc_id", F.explode(F.array(F.lit("calc"), F.lit("plain"))).alias("arm")).withColumn("predicted", F.when(C("arm") == "calc", C("doc_id") % 2).otherwise(F.lit(1)))
    j = p.join(lab.select("doc_id", C("quality").alias("gold")), "doc_id").withColumn("cohort", F.when(C("doc_id") % 3 == 0, "regression").otherwise("held_out"))
    return j.groupBy("cohort", "arm").agg(F.count("*").alias("n"), F.count_if(C("predicted") == C("gold")).alias("correct"), F.round(F.avg((C("predicted") == C("gold")).cast("double")), 6).alias("coverage"))


def set_operations(spark, sf_dir):
    """Ids in both of two sets, in one alone, and in either."""
    a = A.read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id")
    b = A.read(spark, sf_dir, "labels").select("doc_id")
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one(a.intersect(b), "both").unionByName(one(a.subtract(b), "left")).unionByName(one(b.subtract(a), "right")).unionByName(one(a.union(b).distinct(), "either"))


def citations_known(spark, sf_dir):
    """Whether every document that a question names is one of those it was given."""
    q = A.questions(spark, sf_dir, True).select("qid", "doc_ids", F.transform("doc_ids", lambda x, i: F.when((i == 1) & (C("qid").cast("long") % 3 == 0), "none").otherwise(x)).alias("refs"))
    return q.select("qid", F.forall("refs", lambda x: F.array_contains("doc_ids", x)).alias("known"))


QUERIES = {f.__name__: f for f in (domain_join, unlabelled, labelled_chunks, chunk_meta, quality_defaults, parser_kinds, draft_accounting, draft_bank, second_pass, page_range_jobs, id_remap, reference_coverage, doc_manifest, source_manifest, corpus_audit, field_counters, run_summary, top_warnings, duplicate_orders, order_reconciliation, answer_table, label_totals, metric_sets, paired_differences, cluster_bootstrap, cluster_points, population_estimate, percentile_nearest_rank, hash_stratified_sample, ordered_concat, grouped_jobs, chunk_order, prompt_char_budget, resume_anti_join, latest_checkpoint, request_dedupe, prediction_gold, set_operations, citations_known)}

_V = """v AS (SELECT l.doc_id, lang, source, variant, CASE variant WHEN 'full' THEN quality WHEN 'toxic' THEN toxic ELSE l.doc_id % 2 END AS hit FROM labels l JOIN documents d USING (doc_id) CROSS JOIN (SELECT unnest(['full', 'toxic', 'odd']) AS variant)),
p AS (SELECT v.*, v.hit - r.hit AS difference FROM v JOIN v r ON r.doc_id = v.doc_id AND r.variant = 'full' WHERE v.variant <> 'full')"""
_Q = f"WITH {A.ques(True)}"
ORACLE_SQL = {
    "domain_join": "SELECT CAST(item_id AS VARCHAR) AS qid, source AS source_title, count(*) AS docs FROM benchmark, documents WHERE item_id % 5 = 0 OR doc_id % 7 = 0 OR (['en', 'de', 'fr', 'es'])[item_id % 4 + 1] = lang GROUP BY ALL",
    "unlabelled": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "labelled_chunks": f"WITH {A.CAND} SELECT candidate_id, doc_id FROM cand SEMI JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE quality = 1) USING (doc_id)",
    "chunk_meta": f"WITH {A.CAND}, c AS (SELECT CAST(doc_id AS BIGINT) AS d, count(*) AS chunks FROM cand GROUP BY ALL) SELECT CAST(d AS VARCHAR) AS doc_id, chunks, source AS source_title FROM c JOIN documents ON d = doc_id WHERE d % 4 <> 1 UNION ALL SELECT 'dropped', CAST(coalesce(sum(chunks), 0) AS BIGINT), '' FROM c WHERE d % 4 = 1",
    "quality_defaults": "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'unlabeled') AS quality, coalesce(CAST(quality AS DOUBLE), 0.5) AS score FROM documents LEFT JOIN labels USING (doc_id)",
    "parser_kinds": "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'ir' WHEN n_chars > 2000 THEN 'text' ELSE 'missing' END AS parser FROM documents LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)",
    "draft_accounting": "SELECT CASE WHEN l AND r THEN 'both' WHEN l THEN 'left_only' ELSE 'right_only' END AS side, count(*) AS n FROM (SELECT doc_id, true AS l FROM labels) a FULL JOIN (SELECT doc_id, true AS r FROM documents WHERE doc_id % 3 <> 0) b USING (doc_id) GROUP BY ALL",
    "draft_bank": "SELECT item_id, 'missing' AS kind FROM benchmark WHERE item_id NOT IN (SELECT item_id * 2 FROM benchmark) UNION ALL SELECT item_id * 2, 'extra' FROM benchmark WHERE item_id * 2 NOT IN (SELECT item_id FROM benchmark)",
    "second_pass": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN r ELSE a END AS final, doc_id % 2 = 0 AND r <> a AS changed FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS a, CASE WHEN toxic = 1 THEN 'B' ELSE 'A' END AS r FROM labels)",
    "page_range_jobs": """WITH d AS (SELECT doc_id, CAST(ceil(coalesce(n_chars, 0) / 1000.0) AS INTEGER) AS pages FROM documents) SELECT doc_id, 'direct' AS route, 1 AS first, pages AS last FROM d WHERE pages BETWEEN 1 AND 3 UNION ALL SELECT doc_id, 'missing', 0, 0 FROM d WHERE pages = 0
UNION ALL SELECT doc_id, 'range', CAST(f AS INTEGER), CAST(least(f + 2, pages) AS INTEGER) FROM (SELECT doc_id, pages, unnest(generate_series(1, pages, 3)) AS f FROM d WHERE pages > 3)""",
    "id_remap": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'p' || turn // 2 || '_b' || turn ELSE 'b' || turn END AS ref FROM conversations",
    "reference_coverage": f"{_Q}, {A.CAND}, h AS (SELECT DISTINCT doc_id FROM cand WHERE evidence_weight > 0.5) SELECT qid, bool_or(doc_id IN (SELECT doc_id FROM h)) AS covered FROM (SELECT qid, unnest(doc_ids) AS doc_id FROM qs) GROUP BY qid",
    "doc_manifest": f"{_Q} SELECT domain, doc_id, string_agg(DISTINCT qid, ',' ORDER BY qid) AS question_ids, '' AS types, string_agg(DISTINCT answer_format, ',' ORDER BY answer_format) AS formats, string_agg(DISTINCT domain || '_questions.json', ',') AS files, count(DISTINCT qid) AS question_count FROM (SELECT qid, domain, answer_format, unnest(doc_ids) AS doc_id FROM qs) GROUP BY domain, doc_id",
    "source_manifest": "SELECT source, count(*) AS total, count(*) FILTER (coalesce(n_chars, 0) = 0) AS missing, count(*) FILTER (n_chars > 2000) AS pdf, count(*) FILTER (n_chars > 0 AND n_chars <= 2000) AS non_pdf FROM documents GROUP BY source",
    "corpus_audit": f"""WITH {A.CAND} SELECT 'unit_type' AS field, unit_type AS value, count(*) AS n FROM cand GROUP BY ALL UNION ALL SELECT 'evidence_role', evidence_role, count(*) FROM cand GROUP BY ALL UNION ALL SELECT 'orphans', '', count(*) FROM cand WHERE CAST(doc_id AS BIGINT) % 10 = 0
UNION ALL SELECT 'negatives', '', coalesce(CAST(sum(len(list_filter({A.nums('text')}, lambda x: starts_with(x, '-')))) AS BIGINT), 0) FROM cand""",
    "field_counters": "SELECT 'quality' AS field, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY ALL",
    "run_summary": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS tokens, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)",
    "top_warnings": "SELECT w AS warning, count(*) AS n FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE turn = 0) GROUP BY w ORDER BY n DESC, min((conv_id, i)) LIMIT 5",
    "duplicate_orders": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 1",
    "order_reconciliation": "SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(abs(s - o_totalprice) > 0.01, true) AS mismatch FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey",
    "answer_table": "WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS qid, CASE WHEN quality = 1 THEN 'A' ELSE '' END AS answer, doc_id % 100 AS p, CAST(toxic AS BIGINT) AS c FROM labels) SELECT 1 AS place, qid, answer, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens FROM r UNION ALL SELECT 0, 'summary', '', CAST(sum(p) AS BIGINT), CAST(sum(c) AS BIGINT), CAST(sum(p + c) AS BIGINT) FROM r",
    "label_totals": "SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)",
    "metric_sets": f"WITH {_V} SELECT variant, lang, count(*) AS n, round(avg(hit), 6) AS mean_hit FROM v GROUP BY GROUPING SETS ((variant), (variant, lang))",
    "paired_differences": f"WITH {_V} SELECT variant, count(*) FILTER (difference > 0) AS wins, count(*) FILTER (difference < 0) AS losses, count(*) FILTER (difference = 0) AS ties, round(avg(difference), 6) AS mean_difference FROM p GROUP BY variant",
    "cluster_points": f"WITH {_V} SELECT variant, count(DISTINCT source) AS clusters, round(avg(difference), 6) AS difference FROM p GROUP BY variant",
    "population_estimate": f"WITH {_V}, m AS (SELECT lang, avg(hit) AS m, count(*) AS k FROM v WHERE variant = 'full' GROUP BY lang), s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang) SELECT round(sum(m * size) / sum(size), 6) AS estimate, CAST(sum(k) AS BIGINT) AS sampled FROM m JOIN s USING (lang)",
    "percentile_nearest_rank": "SELECT event_type, list_sort(list(value))[CAST(floor((count(value) - 1) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor((count(value) - 1) * 0.95) AS BIGINT) + 1] AS p95, round(median(value), 6) AS median FROM events GROUP BY event_type",
    "hash_stratified_sample": "SELECT *, row_number() OVER (ORDER BY h) AS place FROM (SELECT doc_id, lang, sha256('salt:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt:' || doc_id)) AS rank FROM documents) WHERE rank <= 20",
    "ordered_concat": "SELECT conv_id, sha256(string_agg('**' || role || '** ' || text, chr(10) || chr(10) ORDER BY turn)) AS markdown, count(*) AS parts, CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'failed' WHEN count(*) FILTER (role = 'assistant') * 2 >= count(*) THEN 'done' ELSE 'partial' END AS state FROM conversations GROUP BY conv_id",
    "grouped_jobs": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars NULLS FIRST, doc_id) AS place FROM documents",
    "chunk_order": f"WITH {A.CAND} SELECT lang AS domain, cand.doc_id, candidate_id FROM cand JOIN documents d ON CAST(d.doc_id AS VARCHAR) = cand.doc_id ORDER BY lang, cand.doc_id, candidate_id LIMIT 50",
    "prompt_char_budget": "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 2000",
    "resume_anti_join": "SELECT DISTINCT user_id AS qid FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 20 = 0)",
    "latest_checkpoint": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "request_dedupe": "SELECT sha256(event_type || '|' || props) AS request, event_type || '|' || props AS payload, count(*) AS wanted FROM events WHERE event_type <> 'error' GROUP BY ALL",
    "prediction_gold": """SELECT CASE WHEN doc_id % 3 = 0 THEN 'regression' ELSE 'held_out' END AS cohort, arm, count(*) AS n, count(*) FILTER (p = quality) AS correct, round(avg(CAST(p = quality AS INTEGER)), 6) AS coverage
FROM (SELECT doc_id, quality, arm, CASE WHEN arm = 'calc' THEN doc_id % 2 ELSE 1 END AS p FROM labels CROSS JOIN (SELECT unnest(['calc', 'plain']) AS arm)) GROUP BY ALL""",
    "set_operations": """WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id FROM labels) SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "citations_known": f"{_Q} SELECT qid, NOT (CAST(qid AS BIGINT) % 3 = 0 AND len(doc_ids) >= 2) AS known FROM qs",
}
