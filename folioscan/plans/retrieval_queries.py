"""Question analysis, routing, scoring, ranking and packing over the driver's tables."""
from pyspark.sql import functions as F

from folioscan.operators import metrics, pack, retrieve
from folioscan.operators import question as Q

from . import adapters as A

C = F.col


def _key():
    return ["qid", F.coalesce("label", F.lit("")).alias("label"), "candidate_id"]


def _features(spark, sf_dir, given):
    """The features of one batch of questions, kept: much is derived from them."""
    return Q.with_features(A.questions(spark, sf_dir, given), A.lexicon(spark)).persist()


def _units(spark, sf_dir):
    return retrieve.with_candidate_features(A.candidates(spark, sf_dir))


def question_features(spark, sf_dir):
    f = _features(spark, sf_dir, True)
    lists = ("keyphrases", "numbers", "years", "clauses", "domain_terms", "task_flags", "warnings")
    return f.select("qid", *[F.array_join(c, "|").alias(c) for c in lists])


def search_plans(spark, sf_dir):
    f = _features(spark, sf_dir, True)
    return f.select("qid", F.explode(Q.search_plan(C("task_flags"))).alias("advice"))


def option_queries(spark, sf_dir):
    return Q.option_queries(_features(spark, sf_dir, True)).select("qid", "label", "query")


def question_queries(spark, sf_dir):
    return Q.question_queries(_features(spark, sf_dir, True)).select("qid", "query")


def get_candidates(spark, sf_dir):
    return retrieve.get_candidates(A.questions(spark, sf_dir, True), A.candidates(spark, sf_dir)).select("qid", C("doc_pos").cast("long"), "candidate_id")


def missing_documents(spark, sf_dir):
    few = A.candidates(spark, sf_dir).where("reading_order = 0 AND evidence_weight > 0.5")
    return retrieve.missing_documents(A.questions(spark, sf_dir, True), few).select("qid", F.array_join("missing", ",").alias("missing"))


def doc_token_counts(spark, sf_dir):
    return retrieve.doc_token_counts(A.docs(spark, sf_dir), _units(spark, sf_dir))


def doc_reprs(spark, sf_dir):
    return retrieve.doc_repr(A.docs(spark, sf_dir), retrieve.with_corpus_order(A.candidates(spark, sf_dir))).select("doc_id", "repr")


def local_idf(spark, sf_dir):
    """IDF over the candidates of each question's own documents."""
    pairs = retrieve.get_candidates(A.questions(spark, sf_dir, True), _units(spark, sf_dir).select("doc_id", "candidate_id", "c_tokens"))
    n = pairs.groupBy("qid").agg(F.count("*").alias("n"))
    one = pairs.select("qid", F.explode(F.array_distinct("c_tokens")).alias("token")).join(F.broadcast(n), "qid")
    return retrieve.local_idf(one).select("qid", "token", F.round("idf", 6).alias("idf"))


def route_docs(spark, sf_dir):
    """The 16 best documents of each question that names none, the greater id first on a tie."""
    q, d, u = A.questions(spark, sf_dir, False), A.docs(spark, sf_dir), _units(spark, sf_dir)
    return retrieve.route(q, d, u).select("qid", "doc_id", C("doc_pos").cast("long"))


def routing_scores(spark, sf_dir):
    q, d, u = A.questions(spark, sf_dir, False), A.docs(spark, sf_dir), _units(spark, sf_dir)
    return retrieve.routing_scores(q, d, u).select("qid", "doc_id", "score")


def _scored(spark, sf_dir, given=True):
    f = _features(spark, sf_dir, given)
    queries = Q.with_query_features(Q.question_queries(f).unionByName(Q.option_queries(f))).persist()
    routed = retrieve.route(A.questions(spark, sf_dir, given), A.docs(spark, sf_dir), _units(spark, sf_dir)).persist()
    own = retrieve.featured(A.candidates(spark, sf_dir), routed)
    # of the few documents that questions name; scoring looks at them several times and would read all texts each time
    return retrieve.scored(routed, f, queries, own.persist() if given else own)


def _component(name):
    def query(spark, sf_dir):
        return _scored(spark, sf_dir).select(*_key(), f"{name}_score")

    query.__name__ = f"score_{name}"
    query.__doc__ = f"The {name} component of every query's candidates."
    return query


def score_full(spark, sf_dir):
    return _scored(spark, sf_dir).select(*_key(), "score")


def score_matches(spark, sf_dir):
    """What each score rests on."""
    cols = ("matched_tokens", "matched_numbers", "matched_years", "matched_clauses", "matched_option_phrases", "matched_domain_terms")
    return _scored(spark, sf_dir).select(*_key(), *[F.array_join(c, "|").alias(c) for c in cols])


def score_ablation(spark, sf_dir):
    out = retrieve.variants(_scored(spark, sf_dir))
    return out.groupBy("variant", "qid").agg(F.round(F.sum("score"), 2).alias("total"), F.count("*").alias("n"))


def score_seed(spark, sf_dir):
    f = _features(spark, sf_dir, True)
    own = A.candidates(spark, sf_dir).withColumn("section_title", F.lit("")).withColumn("source", F.when(C("reading_order") % 2 == 0, "selector").otherwise("raw"))
    routed = retrieve.route(A.questions(spark, sf_dir, True), A.docs(spark, sf_dir), retrieve.with_candidate_features(own)).persist()
    return retrieve.seed_scored(routed, Q.with_query_features(Q.option_queries(f)).persist(), retrieve.featured(own, routed)).select(*_key(), "score")


def _top(spark, sf_dir, given):
    """A few dozen rows for each question, kept: packing and measures look at them several times."""
    return retrieve.best(_scored(spark, sf_dir, given)).persist()


def retrieve_option_topk(spark, sf_dir):
    """The 6 best candidates of each option among the documents that its question names."""
    return _top(spark, sf_dir, True).where("label IS NOT NULL").select("qid", "label", "candidate_id", "score", C("rank").cast("long"))


def retrieve_question_topk(spark, sf_dir):
    """The 14 best candidates of each question: routed to 16 documents, scored by all twelve components, ties in corpus order."""
    f = _features(spark, sf_dir, False)
    queries = Q.with_query_features(Q.question_queries(f)).persist()
    routed = retrieve.route(A.questions(spark, sf_dir, False), A.docs(spark, sf_dir), _units(spark, sf_dir)).persist()
    rows = retrieve.best(retrieve.scored(routed, f, queries, retrieve.featured(A.candidates(spark, sf_dir), routed)))
    return rows.select("qid", "doc_id", "candidate_id", "score", C("rank").cast("long"))


def retrieve_all(spark, sf_dir):
    """Routing, scoring and ranking of questions and their options, in one call."""
    rows = retrieve.retrieve(A.questions(spark, sf_dir, False), A.docs(spark, sf_dir), A.candidates(spark, sf_dir), A.lexicon(spark), doc_k=4)
    return rows.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("rank").cast("long").alias("last"))


def merge_evidence(spark, sf_dir):
    """Option evidence of even and odd ranks merged again, the best of each candidate kept, five for each option."""
    rows = _top(spark, sf_dir, True).where("label IS NOT NULL").select("qid", "label", "candidate_id", "score", "rank")
    more = rows.where("rank >= 3").withColumn("score", F.round(C("score") + 1, 6))
    return retrieve.merged(rows, more, 5).select("qid", "label", "candidate_id", "score", C("rank").cast("long"))


def provenance(spark, sf_dir):
    return retrieve.provenance(_top(spark, sf_dir, True)).select("qid", "candidate_id", "score", F.array_join("retrieval_options", "").alias("options"))


def pack_two_phase(spark, sf_dir):
    """Two rows of each option first, then the best of all up to 18, with the labels that found them."""
    out = pack.two_phase(_top(spark, sf_dir, True))
    return out.select("qid", C("evidence_id").cast("long"), "candidate_id", F.array_join("support_options", "").alias("support"), F.array_join("retrieval_options", "").alias("routes"))


def pack_greedy_budget(spark, sf_dir):
    """Set cover of documents and options under a budget of prompt characters; tested against brute force."""
    return pack.greedy(A.questions(spark, sf_dir, True), _top(spark, sf_dir, True), pack.Budget(6000, 12, 900)).select("qid", "evidence_id", "candidate_id", "prompt_chars")


def pack_first_fit(spark, sf_dir):
    """Whole units in rank order, those that don't fit left out; tested against brute force."""
    rows = _top(spark, sf_dir, True).where("label IS NULL")
    return pack.first_fit(A.questions(spark, sf_dir, True), rows, pack.Budget(6000, 12, 900)).select("qid", "evidence_id", "candidate_id", "prompt_chars")


def pack_trimmed(spark, sf_dir):
    """Rows from the top as long as their texts stay within 4,000 characters: what is over goes from the tail."""
    rows = _top(spark, sf_dir, True).where("label IS NULL")
    return pack.trimmed(rows, 4000).select("qid", "candidate_id", C("used").cast("long"))


def retrieval_metrics(spark, sf_dir):
    """Recall and full recall at 3 and 5 of the question's evidence against what its options found first."""
    rows = _top(spark, sf_dir, True)
    found = rows.where("label IS NULL").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))), lambda x: x.candidate_id).alias("found"))
    gold = rows.where("label IS NOT NULL AND rank = 1").groupBy("qid").agg(F.array_sort(F.collect_set("candidate_id")).alias("gold"))
    return metrics.recalls(found.join(gold, "qid")).select("qid", *[F.round(c, 6).alias(c) for c in ("recall_at_3", "recall_at_5")], "all_at_3", "all_at_5")


def routing_recall(spark, sf_dir):
    """Whether blind routing finds the documents named, at several depths, for all and by domain."""
    named = A.questions(spark, sf_dir, True).select("qid", "domain", "doc_ids")
    routed = route_docs(spark, sf_dir).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_pos", "doc_id"))), lambda x: x.doc_id).alias("routed"))
    return metrics.routing(named.join(routed, "qid", "left"), (3, 8, 16))


QUERIES = {f.__name__: f for f in (question_features, search_plans, option_queries, question_queries, get_candidates, missing_documents, doc_token_counts, doc_reprs, local_idf, routing_scores, route_docs, *[_component(n) for n in retrieve.COMPONENTS], score_full, score_matches, score_ablation, score_seed, retrieve_option_topk, retrieve_question_topk, retrieve_all, merge_evidence, provenance, pack_two_phase, pack_greedy_budget, pack_first_fit, pack_trimmed, retrieval_metrics, routing_recall)}

_G, _B = f"WITH {A.CAND}, {A.ques(True)}", f"WITH {A.CAND}, {A.ques(False)}"
_ALIAS = "list_sort(list_distinct([d, d, lpad(d, CAST(greatest(2, length(d)) AS INTEGER), '0'), lpad(d, CAST(greatest(3, length(d)) AS INTEGER), '0')]))"
_META = f"d || chr(10) || array_to_string({_ALIAS}, ' ') || chr(10) || lang || chr(10) || source || chr(10) || 'text'"
_DOCTOK = f"""dm AS (SELECT CAST(doc_id AS VARCHAR) AS d, lang, source FROM documents), dt0 AS (SELECT doc_id, unnest({A.toks("section_title || chr(10) || text")}) AS token FROM cand UNION ALL SELECT d, unnest({A.toks(_META + " || chr(10) || 'docs/' || d || '.txt'")}) FROM dm),
dt AS (SELECT doc_id, token, count(*) AS tf FROM dt0 GROUP BY ALL)"""
_CLEAN = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '[ \t\r\x0B]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
_REPR = f"""dm AS (SELECT CAST(doc_id AS VARCHAR) AS d, lang, source FROM documents), ru AS (SELECT cand.doc_id, reading_order, section_title, left(text, 300) AS t, row_number() OVER (PARTITION BY cand.doc_id ORDER BY reading_order) AS r FROM cand),
rm AS (SELECT d AS doc_id, {_META} AS meta FROM dm), rl AS (SELECT ru.*, meta, length(meta) + CASE WHEN section_title <> '' THEN length(section_title) + 1 ELSE 0 END + coalesce(sum(length(t) + 1) OVER (PARTITION BY ru.doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ru JOIN rm USING (doc_id) WHERE r <= 200),
rp AS (SELECT doc_id, {_CLEAN("any_value(meta) || CASE WHEN any_value(section_title) <> '' THEN chr(10) || any_value(section_title) ELSE '' END || coalesce(chr(10) || string_agg(t, chr(10) ORDER BY r) FILTER (before < 6000), '')")} AS repr FROM rl GROUP BY doc_id)"""
_ROUTE = f"""{_DOCTOK}, {_REPR[_REPR.index('ru AS'):]}, dd AS (SELECT d AS doc_id, lang FROM dm),
rq AS (SELECT qid, domain, joined FROM qf), rt AS (SELECT qid, domain, token, least(count(*), 3) AS qf FROM (SELECT qid, domain, unnest({A.toks('joined')}) AS token FROM rq) GROUP BY ALL),
rs1 AS (SELECT qid, dt.doc_id, sum(qf * (1 + ln(1 + tf))) AS s FROM rt JOIN dt USING (token) JOIN dd ON dd.doc_id = dt.doc_id AND (domain = '' OR lang = '' OR domain = lang) GROUP BY ALL),
rf AS (SELECT qid, domain, unnest(list_transform({A.phrases('joined', 30)}, lambda w: {A.norm('w')})) AS n FROM rq), rn AS (SELECT doc_id, {A.norm('repr')} AS n, lang FROM rp JOIN dd USING (doc_id)),
rs2 AS (SELECT qid, doc_id, 2.0 * count(*) AS s FROM rf JOIN rn ON contains(rn.n, rf.n) AND (domain = '' OR lang = '' OR domain = lang) GROUP BY ALL),
rs AS (SELECT qid, doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM rs1 UNION ALL SELECT * FROM rs2) GROUP BY ALL), rr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) - 1 AS doc_pos FROM rs QUALIFY doc_pos < 16)"""
_GIVEN = "rr AS (SELECT qid, unnest(doc_ids) AS doc_id, generate_subscripts(doc_ids, 1) - 1 AS doc_pos FROM qs)"


def _score(queries: str) -> str:
    """After cand, questions and rr: the components of every query's candidates as sc."""
    return f"""qall AS ({queries}), fx AS (SELECT *, {A.bigrams('qn')} AS qb FROM (SELECT *, {A.norm('query')} AS qn, list_distinct({A.nums('query')}) AS qnum, {A.years('query')} AS qy, {A.norm('option_text')} AS onorm,
  list_filter({A.phrases('option_text', 30)}, lambda w: length({A.norm('w')}) >= 3) AS oph FROM qall)),
cu AS (SELECT *, {A.bigrams('cn')} AS cb FROM (SELECT *, {A.norm('text')} AS cn, {A.nums('text')} AS cnum, {A.years('text')} AS cy, {A.norm('section_title')} AS sn FROM cand)),
pr AS (SELECT qid, doc_pos, cu.* FROM rr JOIN cu USING (doc_id)), pt AS (SELECT qid, candidate_id, token, count(*) AS tf FROM (SELECT qid, candidate_id, unnest({A.toks("section_title || chr(10) || text")}) AS token FROM pr) GROUP BY ALL),
nn AS (SELECT qid, count(*) AS n FROM pr GROUP BY qid), id AS (SELECT qid, token, ln((any_value(n) + 1) / (count(*) + 0.5)) + 1 AS idf FROM pt JOIN nn USING (qid) GROUP BY ALL),
qt AS (SELECT qid, label, token, least(count(*), 3) AS qf, min(pos) AS pos FROM (SELECT qid, label, unnest({A.toks('query')}) AS token, generate_subscripts({A.toks('query')}, 1) AS pos FROM qall) GROUP BY ALL),
ts AS (SELECT qid, label, candidate_id, sum((1 + ln(1 + tf)) * idf * qf) AS token_raw, array_to_string(list(token ORDER BY pos)[1:35], '|') AS mt FROM qt JOIN pt USING (qid, token) JOIN id USING (qid, token) GROUP BY ALL),
sc0 AS (SELECT fx.qid, fx.label, pr.candidate_id, pr.doc_id, pr.doc_pos, pr.text, reading_order, coalesce(token_raw, 0.0) AS token_raw, coalesce(mt, '') AS matched_tokens, len(list_intersect(qb, cb)) / greatest(8e0, len(qb)) * 8e0 AS bigram_raw,
  list_sort(list_intersect(qnum, cnum)) AS mn, list_sort(list_intersect(qy, cy)) AS my, CASE WHEN length(onorm) >= 8 AND contains(cn, onorm) THEN 16e0 ELSE 0e0 END AS literal_score, list_filter(oph, lambda w: contains(cn, {A.norm('w')})) AS mp,
  1.2e0 * len(list_filter(qf.domain_terms, lambda w: {A.norm('w')} <> '' AND contains(sn, {A.norm('w')}))) AS section_score, list_filter(coalesce(qf.terms, []), lambda w: {A.norm('w')} <> '' AND contains(cn, {A.norm('w')})) AS md,
  CASE unit_type WHEN 'heading' THEN 0.5e0 WHEN 'table' THEN 1.2e0 ELSE 0e0 END + CASE evidence_role WHEN 'primary' THEN 0.5e0 ELSE 0e0 END AS unit_score, round(greatest(0e0, least(evidence_weight, 1e0)) * 0.8e0, 4) AS quality_score,
  CASE WHEN len(qf.doc_ids) = 0 THEN 0e0 WHEN contains(fx.option_text, '第一份') THEN CASE WHEN pr.doc_id = qf.doc_ids[1] THEN 6e0 ELSE -1.5e0 END WHEN contains(fx.option_text, '第二份') AND len(qf.doc_ids) >= 2 THEN CASE WHEN pr.doc_id = qf.doc_ids[2] THEN 6e0 ELSE -1.5e0 END ELSE 0e0 END AS position_score
  FROM fx JOIN pr USING (qid) JOIN qf ON qf.qid = fx.qid LEFT JOIN ts ON ts.qid = fx.qid AND ts.label = fx.label AND ts.candidate_id = pr.candidate_id),
sc AS (SELECT *, round(token_raw, 4) AS token_score, round(bigram_raw, 4) AS bigram_score, 2.5e0 * len(mn) AS number_score, 1.5e0 * len(my) AS year_score, 0e0 AS clause_score, 1.5e0 * len(mp) AS phrase_score, round(0.35e0 * len(md), 4) AS domain_score,
  round(token_raw + bigram_raw + 2.5e0 * len(mn) + 1.5e0 * len(my) + literal_score + 1.5e0 * len(mp) + section_score + 0.35e0 * len(md) + unit_score + quality_score + position_score, 6) AS score FROM sc0),
tk AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, doc_pos, reading_order, candidate_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= CASE WHEN label = '' THEN 14 ELSE 6 END)"""


_BOTH = "SELECT * FROM sq UNION ALL SELECT * FROM oq"
_SC = f"{_G}, {_GIVEN}, {_score(_BOTH)}"

ORACLE_SQL = {
    "question_features": f"""{_G} SELECT qid, array_to_string(keyphrases, '|') AS keyphrases, array_to_string(list_sort(list_distinct({A.nums('joined')})), '|') AS numbers, array_to_string({A.years('joined')}, '|') AS years, '' AS clauses, array_to_string(domain_terms, '|') AS domain_terms,
array_to_string(list_filter([CASE WHEN contains(joined, '第一份') THEN 'cross_document' END, CASE answer_format WHEN 'tf' THEN 'true_false' WHEN 'multi' THEN 'multi_select' WHEN 'mcq' THEN 'single_select' END], lambda x: x IS NOT NULL), '|') AS task_flags, CASE WHEN answer_format = 'numeric' THEN 'unknown_answer_format' ELSE '' END AS warnings FROM qf""",
    "search_plans": f"""{_G} SELECT qid, unnest(list_concat(['{"', '".join(Q.GENERAL)}'], CASE WHEN contains(joined, '第一份') THEN ['{Q.BY_FLAG[0][1]}'] ELSE [] END)) AS advice FROM qf""",
    "option_queries": f"{_G} SELECT qid, label, query FROM oq",
    "question_queries": f"{_G} SELECT qid, query FROM sq",
    "get_candidates": f"{_G}, {_GIVEN} SELECT qid, doc_pos, candidate_id FROM rr JOIN cand USING (doc_id)",
    "missing_documents": f"{_G}, {_GIVEN} SELECT qid, string_agg(doc_id, ',' ORDER BY doc_pos) AS missing FROM rr WHERE doc_id NOT IN (SELECT doc_id FROM cand WHERE reading_order = 0 AND evidence_weight > 0.5) GROUP BY qid",
    "doc_token_counts": f"WITH {A.CAND}, {_DOCTOK} SELECT doc_id, token, tf FROM dt",
    "doc_reprs": f"WITH {A.CAND}, {_REPR} SELECT doc_id, repr FROM rp",
    "local_idf": f"""{_G}, {_GIVEN}, pr AS (SELECT qid, candidate_id, section_title, text FROM rr JOIN cand USING (doc_id)), pt AS (SELECT DISTINCT qid, candidate_id, unnest({A.toks("section_title || chr(10) || text")}) AS token FROM pr),
nn AS (SELECT qid, count(*) AS n FROM pr GROUP BY qid) SELECT qid, token, round(ln((any_value(n) + 1) / (count(*) + 0.5)) + 1, 6) AS idf FROM pt JOIN nn USING (qid) GROUP BY ALL""",
    "routing_scores": f"{_B}, {_ROUTE} SELECT qid, doc_id, score FROM rs",
    "route_docs": f"{_B}, {_ROUTE} SELECT qid, doc_id, doc_pos FROM rr",
    **{f"score_{n}": f"{_SC} SELECT qid, label, candidate_id, {n}_score FROM sc" for n in ("token", "bigram", "number", "year", "clause", "literal", "phrase", "section", "domain", "unit", "quality", "position")},
    "score_full": f"{_SC} SELECT qid, label, candidate_id, score FROM sc",
    "score_matches": f"{_SC} SELECT qid, label, candidate_id, matched_tokens, array_to_string(mn, '|') AS matched_numbers, array_to_string(my, '|') AS matched_years, '' AS matched_clauses, array_to_string(mp[1:25], '|') AS matched_option_phrases, array_to_string(md[1:25], '|') AS matched_domain_terms FROM sc",
    "score_ablation": f"""{_SC}, v AS (SELECT qid, 'full' AS variant, round(score, 4) AS s FROM sc UNION ALL SELECT qid, 'no_numeric_bonus', round(score - number_score - year_score, 4) FROM sc UNION ALL SELECT qid, 'token_only', token_score FROM sc)
SELECT variant, qid, round(sum(s), 2) AS total, count(*) AS n FROM v GROUP BY ALL""",
    "score_seed": (f"{_G}, {_GIVEN}, " + _score("SELECT * FROM oq").replace("section_title || chr(10) || text", "text")) + """ SELECT qid, label, candidate_id, round(token_raw + bigram_raw + 2.5e0 * len(mn) + CASE WHEN literal_score > 0 THEN 12e0 ELSE 0e0 END + 1.5e0 * len(mp) + CASE WHEN reading_order % 2 = 0 THEN 0.5e0 ELSE 0e0 END, 6) AS score FROM sc""",
    "retrieve_option_topk": f"{_SC} SELECT qid, label, candidate_id, score, rank FROM tk WHERE label <> ''",
    "retrieve_question_topk": f"{_B}, {_ROUTE}, {_score('SELECT * FROM sq')} SELECT qid, doc_id, candidate_id, score, rank FROM tk",
    "retrieve_all": f"{_B}, {_ROUTE.replace('doc_pos < 16', 'doc_pos < 4')}, {_score(_BOTH)} SELECT qid, count(*) AS n, count(DISTINCT doc_id) AS docs, max(rank) AS last FROM tk GROUP BY qid",
    "merge_evidence": f"""{_SC}, b AS (SELECT qid, label, candidate_id, score, rank, 0 AS turn FROM tk WHERE label <> '' UNION ALL SELECT qid, label, candidate_id, round(score + 1, 6), rank, 1 FROM tk WHERE label <> '' AND rank >= 3),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, label, candidate_id ORDER BY score DESC, turn, rank) = 1) SELECT * FROM (SELECT qid, label, candidate_id, score, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, turn, rank, candidate_id) AS rank FROM o) WHERE rank <= 5""",
    "provenance": f"{_SC} SELECT qid, candidate_id, max(score) AS score, coalesce(string_agg(DISTINCT label, '' ORDER BY label) FILTER (label <> ''), '') AS options FROM tk GROUP BY qid, candidate_id",
    "pack_trimmed": f"{_SC}, u AS (SELECT qid, candidate_id, sum(length(text)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM tk WHERE label = '') SELECT qid, candidate_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 4000",
    "retrieval_metrics": f"""{_SC}, f AS (SELECT qid, list(candidate_id ORDER BY rank) AS f FROM tk WHERE label = '' GROUP BY qid), g AS (SELECT qid, list_distinct(list(candidate_id)) AS g FROM tk WHERE label <> '' AND rank = 1 GROUP BY qid)
SELECT qid, round(len(list_intersect(f[1:3], g)) / len(g), 6) AS recall_at_3, round(len(list_intersect(f[1:5], g)) / len(g), 6) AS recall_at_5, CAST(len(list_intersect(f[1:3], g)) = len(g) AS INTEGER) AS all_at_3, CAST(len(list_intersect(f[1:5], g)) = len(g) AS INTEGER) AS all_at_5 FROM f JOIN g USING (qid)""",
    "routing_recall": f"""{_B}, {_ROUTE}, nm AS (SELECT CAST(item_id AS VARCHAR) AS qid, [CAST(item_id * 13 % 200 AS VARCHAR), CAST((item_id * 29 + 1) % 200 AS VARCHAR), CAST((item_id * 7 + 50) % 200 AS VARCHAR)] AS named FROM benchmark), rd AS (SELECT qid, list(doc_id ORDER BY doc_pos) AS routed FROM rr GROUP BY qid),
k AS (SELECT unnest([3, 8, 16]) AS k), h AS (SELECT k, domain, len(list_intersect(coalesce(routed, [])[1:k], list_distinct(named))) AS hits, len(list_distinct(named)) AS n FROM nm JOIN qs USING (qid) LEFT JOIN rd USING (qid) CROSS JOIN k)
SELECT k, domain, count(*) AS total, count(*) FILTER (hits > 0) AS any_hit, count(*) FILTER (hits = n) AS all_hit, round(count(*) FILTER (hits > 0) / count(*), 6) AS any_recall, round(count(*) FILTER (hits = n) / count(*), 6) AS all_recall FROM h GROUP BY GROUPING SETS ((k, domain), (k))""",
}
ORACLE_SQL["pack_two_phase"] = f"""{_SC},
p1 AS (SELECT qid, candidate_id, label, 1 AS phase, row_number() OVER (PARTITION BY qid ORDER BY label, rank) AS spot FROM tk WHERE label <> '' AND rank <= 2),
p2 AS (SELECT qid, candidate_id, label, 2 AS phase, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label = '', label, rank) AS spot FROM tk),
al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), fs AS (SELECT qid, candidate_id, min(phase * 100000 + spot) AS first FROM al GROUP BY ALL),
od AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS evidence_id FROM fs), ct AS (SELECT qid, first AS cut FROM od WHERE evidence_id = 18),
us AS (SELECT al.*, phase * 100000 + spot AS pos, coalesce(cut, 999999999) AS cut FROM al LEFT JOIN ct USING (qid))
SELECT od.qid, evidence_id, od.candidate_id, coalesce(string_agg(DISTINCT label, '' ORDER BY label) FILTER (label <> '' AND (phase = 1 OR pos <= cut)), '') AS support, coalesce(string_agg(DISTINCT label, '' ORDER BY label) FILTER (label <> '' AND (phase = 1 OR pos <= cut)), '') AS routes
FROM od JOIN us USING (qid, candidate_id) WHERE evidence_id <= 18 GROUP BY ALL"""
