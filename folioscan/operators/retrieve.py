"""Candidates, routing of questions to documents, lexical scoring and the best evidence of each question and option.

Candidates: candidate_id, doc_id, text, section_title, unit_type, modality, evidence_role, evidence_weight, numbers, page_id, reading_order.
Documents: doc_id, domain, source_title, source_kind, source_path. Everything is joined on ids and tokens; what is broadcast is checked for its size first."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T

from . import lexicon as L
from .question import option_queries, question_queries, with_features, with_query_features

FEW = 2_000_000  # rows that may be broadcast; more are joined by a shuffle
FEW_IDS = 10_000  # documents that may be named in a filter
FEW_WORDS = 200_000  # words that each Python worker may hold
LAST = 10**9  # stands for a missing page or order in the corpus's order
COMPONENTS = ("token", "bigram", "number", "year", "clause", "literal", "phrase", "section", "domain", "unit", "quality", "position")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def usable(candidates: DataFrame, include_tables: bool = True) -> DataFrame:
    """Candidates with an id of a document and a text; without tables if asked."""
    out = candidates.where("doc_id != '' AND text != ''")
    return out if include_tables else out.where("unit_type IS NULL OR unit_type != 'table'")


def with_corpus_order(candidates: DataFrame) -> DataFrame:
    """candidates with `place`: their order in a document."""
    return candidates.withColumn("place", F.struct(F.coalesce("page_id", F.lit(LAST)).alias("page"), F.coalesce("reading_order", F.lit(LAST)).alias("at"), F.col("candidate_id").alias("id")))


def _with_title() -> Column:
    return F.concat_ws("\n", F.coalesce("section_title", F.lit("")), "text")


def with_candidate_features(candidates: DataFrame) -> DataFrame:
    """What scoring looks at, once for each candidate; meant to be written when many questions are asked."""
    return with_corpus_order(candidates).select(
        "*", T.tokens(_with_title()).alias("c_tokens"), T.normalized(F.col("text")).alias("c_norm"), T.char_ngrams(F.col("text"), 2).alias("c_bigrams"),
        F.array_union(F.coalesce("numbers", F.array().cast("array<string>")), T.numbers(F.col("text"))).alias("c_numbers"), T.years(F.col("text")).alias("c_years"), T.clauses(F.col("text")).alias("c_clauses"), T.normalized(F.col("section_title")).alias("section_norm"),
    )


def featured(candidates: DataFrame, routed: DataFrame) -> DataFrame:
    """with_candidate_features() of the routed documents' candidates alone.

    A filter on a few ids goes below the splitting of texts, down to the reader; a join would have all texts split first."""
    ids = routed.select("doc_id").distinct()
    few = [r.doc_id for r in ids.limit(FEW_IDS + 1).collect()]
    own = candidates.where(F.col("doc_id").isin(few)) if len(few) <= FEW_IDS else candidates.join(small(ids), "doc_id", "left_semi")
    return with_candidate_features(own)


def get_candidates(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, doc_pos and the candidates of each question's documents; a document named twice comes twice."""
    asked = questions.select("qid", F.posexplode("doc_ids").alias("doc_pos", "doc_id"))
    return small(asked).join(candidates, "doc_id")


def missing_documents(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, missing: the given documents that have no candidates, in their order."""
    asked = questions.select("qid", F.posexplode("doc_ids").alias("doc_pos", "doc_id"))
    gone = asked.join(candidates.select("doc_id").distinct(), "doc_id", "left_anti")
    return gone.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_pos", "doc_id"))), lambda x: x.doc_id).alias("missing"))


def meta_text(*more: str) -> Column:
    doc, domain = F.col("doc_id"), F.coalesce("domain", F.lit(""))
    parts = [doc, F.array_join(T.doc_aliases(doc, domain), " "), domain, F.coalesce("source_title", F.lit("")), F.coalesce("source_kind", F.lit("")), *[F.coalesce(c, F.lit("")) for c in more]]
    return F.array_join(F.array(*parts), "\n")


def doc_token_counts(docs: DataFrame, candidates: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """doc_id, token, tf: counts of all candidates and of the document's metadata; of a vocabulary alone if given.

    The words of a batch of questions are counted in Arrow batches, without a row for each word of the corpus."""
    meta = docs.select("doc_id", meta_text("source_path").alias("text"))
    words = [] if vocabulary is None else [r.token for r in vocabulary.select("token").distinct().limit(FEW_WORDS + 1).collect()]
    if vocabulary is not None and len(words) <= FEW_WORDS:
        texts = candidates.select("doc_id", _with_title().alias("text")).unionByName(meta)
        return _counts_of(texts, words).repartition("doc_id").groupBy("doc_id", "token").agg(F.sum("tf").alias("tf"))
    both = candidates.select("doc_id", F.explode("c_tokens").alias("token")).unionByName(meta.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")))
    if vocabulary is not None:
        both = both.join(small(vocabulary), "token", "left_semi")
    return both.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def _counts_of(texts: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, token, tf of the words that T.tokens() finds in texts (doc_id, text), a row for each document and batch."""
    held = texts.sparkSession.sparkContext.broadcast(frozenset(words))
    patterns, longest, most = (T.WORD, T.NUMBER.removeprefix("(?U)(?<![\\dA-Za-z])[-+]?"), T.CJK), T.LONGEST_RUN, T.NUMBERS

    def run(batches):
        import re

        import pyarrow as pa

        word, number, cjk = map(re.compile, patterns)
        run_, known = re.compile(r"\d+"), held.value
        joined = lambda c: c.isdecimal() or "A" <= c <= "Z" or "a" <= c <= "z"

        def numbers(t):
            """T.NUMBER by its digits, which a search goes to at once; what it says of characters before them is looked at there."""
            at, out = 0, []
            while len(out) < most and (m := number.search(t, at)):
                i = m.start()
                if i and joined(t[i - 1]):
                    at = run_.match(t, i).end()
                    continue
                signed = i > at and t[i - 1] in "+-" and not (i > 1 and joined(t[i - 2]))
                out.append(t[i - 1] + m[0] if signed else m[0])
                at = m.end()
            return out

        for b in batches:
            counts = {}
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = counts.setdefault(doc, {})
                found = "\n".join(word.findall(t)).lower().split("\n")
                if cjk.search(t):
                    runs = [x for x in found if cjk.match(x)]
                    found = [x for x in found if not cjk.match(x) or len(x) <= longest] + [x[i : i + n] for x in runs for n in (2, 3, 4) for i in range(len(x) - n + 1)]
                found += numbers(t)
                for x in filter(known.__contains__, found):
                    own[x] = own.get(x, 0) + 1
            rows = [(d, x, n) for d, own in counts.items() for x, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["doc_id", "token", "tf"])

    return texts.mapInArrow(run, "doc_id string, token string, tf long")


def doc_repr(docs: DataFrame, candidates: DataFrame, first: int = 200, each: int = 300, most: int = 6000) -> DataFrame:
    """doc_id, domain, repr: metadata, then new section titles and the beginnings of the first candidates as long as all of it is below `most` characters."""
    w = Window.partitionBy("doc_id").orderBy("place")
    units = candidates.select("doc_id", "place", F.coalesce("section_title", F.lit("")).alias("section"), F.left("text", F.lit(each)).alias("text")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= first)
    units = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", "section", "text"))).alias("units"))
    d = docs.select("doc_id", F.coalesce("domain", F.lit("")).alias("domain"), meta_text().alias("meta")).join(units, "doc_id")

    def step(a: Column, u: Column) -> Column:
        fresh = (u.section != "") & ~F.array_contains(a.seen, u.section)
        seen = F.when(fresh, F.array_append(a.seen, u.section)).otherwise(a.seen)
        out = F.when(fresh, F.array_append(a.out, u.section)).otherwise(a.out)
        n = a.n + F.when(fresh, F.length(u.section) + 1).otherwise(0)
        return F.struct(seen.alias("seen"), F.when(n < most, F.array_append(out, u.text)).otherwise(out).alias("out"), (n + F.when(n < most, F.length(u.text) + 1).otherwise(0)).alias("n"))

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array("meta").alias("out"), F.length("meta").alias("n"))
    return d.select("doc_id", "domain", T.let(F.array_join(F.aggregate("units", start, step, lambda a: a.out), "\n"), lambda x: T.clean(x)).alias("repr"))


def phrases_met(reprs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, norm: the phrases that a document's normalized text contains, each once.

    All phrases are looked for at once by an automaton that each task builds from the questions' phrases: `phrases` (norm) is a batch of questions, not the corpus."""
    words = sorted(r.norm for r in phrases.select("norm").distinct().collect())
    held = reprs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        a = ahocorasick.Automaton()
        for i, x in enumerate(held.value):
            a.add_word(x, i)
        if held.value:
            a.make_automaton()
        for b in batches:
            hits = [sorted({i for _, i in a.iter(x or "")}) if held.value else [] for x in b.column("norm").to_pylist()]
            docs = b.column("doc_id").take(pa.array([k for k, h in enumerate(hits) for _ in h], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array([held.value[i] for h in hits for i in h], pa.string())], ["doc_id", "norm"])

    return reprs.select("doc_id", T.let(F.col("repr"), T.normalized).alias("norm")).mapInArrow(run, "doc_id string, norm string")


def routing_scores(questions: DataFrame, docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, doc_id, score over 0 of the documents that a question's domain allows: an empty domain on either side allows all.

    Tokens and phrases met are dealt out by document once; scores are added up where they are. The sum is exact, in two whole numbers (units of 2**-26, and of 2**-52
    below that), so it is the same in any order and is rounded once."""
    query = F.array_join(F.concat(F.array(F.coalesce("question", F.lit(""))), F.transform(F.array_sort(F.map_keys("options")), lambda k: F.element_at("options", k))), "\n")
    q = questions.select("qid", F.coalesce("domain", F.lit("")).alias("q_domain"), query.alias("query"))
    tokens = q.select("qid", "q_domain", F.explode(T.token_counts(F.col("query"))).alias("t")).select("qid", "q_domain", F.lit(0).alias("kind"), F.col("t.token").alias("term"), F.least("t.n", F.lit(3)).alias("qf"))
    phrases = q.select("qid", "q_domain", F.lit(1).alias("kind"), F.explode(F.transform(T.keyphrases(F.col("query"), 30), T.normalized)).alias("term"), F.lit(2).alias("qf"))
    wanted = tokens.unionByName(phrases).persist()
    counts = doc_token_counts(docs, candidates, wanted.where("kind = 0").select(F.col("term").alias("token")))
    met = phrases_met(doc_repr(docs, candidates), wanted.where("kind = 1").select(F.col("term").alias("norm")))
    terms = counts.select("doc_id", F.lit(0).alias("kind"), F.col("token").alias("term"), "tf").unionByName(met.select("doc_id", F.lit(1).alias("kind"), F.col("norm").alias("term"), F.lit(0).cast("long").alias("tf")))
    part = 1 + F.log1p(F.col("tf").cast("double"))  # 1 for a phrase
    high = F.floor(part * 2**26)
    low = ((part - high / F.lit(2.0**26)) * 2.0**52).cast("long")
    own = docs.select("doc_id", F.coalesce("domain", F.lit("")).alias("domain")).repartition("doc_id")
    parts = terms.select("doc_id", "kind", "term", high.alias("high"), low.alias("low")).repartition("doc_id").join(own, "doc_id")
    met = parts.join(small(wanted), ["kind", "term"]).where((F.col("q_domain") == "") | (F.col("domain") == "") | (F.col("q_domain") == F.col("domain")))
    score = F.sum(F.col("high") * F.col("qf")) / F.lit(2.0**26) + F.sum(F.col("low") * F.col("qf")) / F.lit(2.0**52)
    return met.groupBy("doc_id", "qid").agg(F.round(score, 6).alias("score")).where("score > 0").select("qid", "doc_id", "score")


def route(questions: DataFrame, docs: DataFrame, candidates: DataFrame, top_k: int = 16) -> DataFrame:
    """qid, doc_id, doc_pos: given documents as they are; else the best by score, equal ones with the greater id first. The corpus is read only if a question names none."""
    given = questions.where("size(doc_ids) > 0").select("qid", F.posexplode("doc_ids").alias("doc_pos", "doc_id")).select("qid", "doc_id", "doc_pos")
    asked = questions.where("doc_ids IS NULL OR size(doc_ids) = 0")
    if asked.isEmpty():
        return given
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))
    blind = routing_scores(asked, docs, candidates)
    blind = blind.withColumn("doc_pos", F.row_number().over(w) - 1).where(F.col("doc_pos") < top_k)
    return given.unionByName(blind.select("qid", "doc_id", "doc_pos"))


def local_idf(pairs: DataFrame) -> DataFrame:
    """qid, token, idf over the candidates of each question's own documents. pairs: qid, candidate_id, doc_pos, token, tf and n (candidates of the question)."""
    return pairs.groupBy("qid", "token").agg((F.log((F.first("n") + 1) / (F.count("*") + 0.5)) + 1).alias("idf"))


def token_scores(routed: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, label, doc_pos, candidate_id, token_score and matched_tokens of the pairs that share a token. A candidate's tokens are counted once, for all its questions."""
    q = queries.select("qid", "label", F.posexplode("q_counts").alias("at", "t")).select("qid", "label", "at", "t.token", F.least("t.n", F.lit(3)).alias("qf"))
    n = routed.join(candidates.groupBy("doc_id").agg(F.count("*").alias("units")), "doc_id").groupBy("qid").agg(F.sum("units").alias("n"))
    words = candidates.select("doc_id", "candidate_id", F.explode("c_tokens").alias("token")).join(small(q.select("token").distinct()), "token", "left_semi")
    counts = words.groupBy("doc_id", "candidate_id", "token").agg(F.count("*").alias("tf"))
    asked = routed.select("qid", "doc_id", "doc_pos").join(q.select("qid", "token").distinct(), "qid")
    tf = counts.join(small(asked), ["doc_id", "token"]).drop("doc_id").join(small(n), "qid")
    idf = local_idf(tf)
    part = (1 + F.log1p(F.col("tf").cast("double"))) * F.col("idf") * F.col("qf")
    met = tf.join(idf, ["qid", "token"]).join(q, ["qid", "token"]).groupBy("qid", "label", "doc_pos", "candidate_id")
    return met.agg(F.sum(part).alias("token_score"), F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x.token).alias("matched_tokens"))


def scored(routed: DataFrame, features: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every (query, candidate of the routed documents) with its twelve components, matches and score.

    queries: with_query_features() of option and question queries, whose label is null for a question's own; candidates: with_candidate_features()."""
    key = queries.withColumn("label", F.coalesce("label", F.lit("")))
    tokens = token_scores(routed, key, candidates)
    asked = key.join(features.select("qid", "doc_ids", "terms", "domain_terms"), "qid")
    cols = ["doc_id", "candidate_id", "place", "text", "section_title", "unit_type", "modality", "evidence_role", "evidence_weight", "c_norm", "c_bigrams", "c_numbers", "c_years", "c_clauses", "section_norm"]
    p = small(routed).join(candidates.select(*cols), "doc_id").join(small(asked.drop("query", "q_counts")), "qid")
    p = p.join(tokens, ["qid", "label", "doc_pos", "candidate_id"], "left").withColumn("token_score", F.coalesce("token_score", F.lit(0.0)))
    both = lambda a, b: F.array_sort(F.array_intersect(a, b))
    held = lambda terms, norm: F.filter(terms, lambda t: (T.normalized(t) != "") & F.contains(norm, T.normalized(t)))
    hits = F.transform(F.filter("option_phrases", lambda x: F.contains(F.col("c_norm"), x.norm)), lambda x: x.phrase)
    p = p.select(
        "*", both("q_numbers", "c_numbers").alias("matched_numbers"), both("q_years", "c_years").alias("matched_years"), both("q_clauses", "c_clauses").alias("matched_clauses"),
        hits.alias("hits"), F.size(held("domain_terms", F.col("section_norm"))).alias("n_section"), held("terms", F.col("c_norm")).alias("domain_hits"),
    )
    eq = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    has = lambda pattern: F.coalesce(F.col("option_text").rlike(pattern), F.lit(False))
    at = lambda i: F.when(F.col("doc_id") == F.get("doc_ids", F.lit(i)), 6.0).otherwise(-1.5)
    position = F.when(F.coalesce(F.size("doc_ids"), F.lit(0)) <= 0, 0.0).when(has(L.FIRST_DOC), at(0)).when(has(L.SECOND_DOC) & (F.size("doc_ids") >= 2), at(1)).otherwise(0.0)
    parts = {
        "bigram": F.size(F.array_intersect("q_bigrams", "c_bigrams")) / F.greatest(F.lit(8), F.size("q_bigrams")) * 8.0,
        "number": 2.5 * F.size("matched_numbers"),
        "year": 1.5 * F.size("matched_years"),
        "clause": 3.0 * F.size("matched_clauses"),
        "literal": F.when((F.length("option_norm") >= 8) & F.contains("c_norm", F.col("option_norm")), 16.0).otherwise(0.0),
        "phrase": 1.5 * F.size("hits"),
        "section": 1.2 * F.col("n_section"),
        "domain": 0.35 * F.size("domain_hits"),
        "unit": F.when(eq("unit_type", "heading"), 0.5).otherwise(0.0) + F.when(eq("unit_type", "table") | eq("modality", "table"), 1.2).otherwise(0.0) + F.when(eq("evidence_role", "primary"), 0.5).otherwise(0.0),
        "quality": F.greatest(F.lit(0.0), F.least(F.coalesce("evidence_weight", F.lit(1.0)), F.lit(1.0))) * 0.8,
        "position": position,
    }
    p = p.select("*", *[c.cast("double").alias(f"{n}_score") for n, c in parts.items()])
    total = sum((F.col(f"{n}_score") for n in COMPONENTS[1:]), F.col("token_score"))
    keep = ["qid", F.nullif("label", F.lit("")).alias("label"), "doc_id", "doc_pos", "candidate_id", "place", "text", F.round(total, 6).alias("score")]
    matches = [F.slice(F.coalesce("matched_tokens", F.array().cast("array<string>")), 1, 35).alias("matched_tokens"), "matched_numbers", "matched_years", "matched_clauses", F.slice("hits", 1, 25).alias("matched_option_phrases"), F.slice("domain_hits", 1, 25).alias("matched_domain_terms")]
    return p.select(*keep, *[F.round(f"{n}_score", 4).alias(f"{n}_score") for n in COMPONENTS], *matches)


def variants(rows: DataFrame) -> DataFrame:
    """rows three times over by `variant`: full, no_numeric_bonus (without numbers and years), token_only."""
    v = F.explode(F.array(F.lit("full"), F.lit("no_numeric_bonus"), F.lit("token_only"))).alias("variant")
    out = rows.select("*", v)
    less = F.col("score") - F.col("number_score") - F.col("year_score")
    return out.withColumn("score", F.round(F.when(F.col("variant") == "full", F.col("score")).when(F.col("variant") == "no_numeric_bonus", less).otherwise(F.col("token_score")), 4))


def seed_scored(routed: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The seed path's score: tokens, bigrams, numbers, a literal option of six characters (12), phrases and half a point for selected units.

    candidates: with_candidate_features() of units without section titles, with `source`."""
    key = queries.withColumn("label", F.coalesce("label", F.lit("")))
    p = small(routed).join(candidates.select("doc_id", "candidate_id", "place", "c_norm", "c_bigrams", "c_numbers", "source"), "doc_id").join(small(key.drop("query", "q_counts")), "qid")
    p = p.join(token_scores(routed, key, candidates).drop("matched_tokens"), ["qid", "label", "doc_pos", "candidate_id"], "left")
    score = F.coalesce("token_score", F.lit(0.0)) + F.size(F.array_intersect("q_bigrams", "c_bigrams")) / F.greatest(F.lit(8), F.size("q_bigrams")) * 8.0 + 2.5 * F.size(F.array_intersect("q_numbers", "c_numbers"))
    score = score + F.when((F.length("option_norm") >= 6) & F.contains("c_norm", F.col("option_norm")), 12.0).otherwise(0.0) + 1.5 * F.size(F.filter("option_phrases", lambda x: F.contains(F.col("c_norm"), x.norm)))
    score = score + F.when(F.col("source") == "selector", 0.5).otherwise(0.0)
    return p.select("qid", F.nullif("label", F.lit("")).alias("label"), "doc_id", "doc_pos", "candidate_id", "place", F.round(score, 6).alias("score"))


def best(rows: DataFrame, option_k: int = 6, question_k: int = 14, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with rank: of each question and label (and `by`) the best with a score over 0; ties in the order of documents and corpus. A candidate found twice counts once."""
    keys = ["qid", *by, "label"]
    one = Window.partitionBy(*keys, "candidate_id").orderBy("doc_pos")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_pos", "place")
    rows = rows.where("score > 0").withColumn("rank", F.row_number().over(one)).where("rank = 1")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.when(F.col("label").isNull(), question_k).otherwise(option_k))


def retrieve(questions: DataFrame, docs: DataFrame, candidates: DataFrame, lexicon: DataFrame, option_k: int = 6, question_k: int = 14, doc_k: int = 16, include_options: bool = True) -> DataFrame:
    """The best evidence of each question (label null) and option: route, score, rank.

    What is kept meanwhile is of the size of the batch of questions: their features, and a row for each question and routed document."""
    features = with_features(questions, lexicon).persist()
    queries = question_queries(features)
    if include_options:
        queries = queries.unionByName(option_queries(features))
    routed = route(questions, docs, with_candidate_features(candidates), doc_k).persist()
    return best(scored(routed, features, with_query_features(queries).persist(), featured(candidates, routed)), option_k, question_k)


def merged(first: DataFrame, more: DataFrame, limit: int, by: tuple[str, ...] = ("qid", "label")) -> DataFrame:
    """Both results with each candidate's best row (the first's on a tie), the best `limit` of each question and label."""
    both = first.withColumn("turn", F.lit(0)).unionByName(more.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    one = Window.partitionBy(*by, "candidate_id").orderBy(F.desc("score"), "turn", "rank")
    kept = both.withColumn("keep", F.row_number().over(one)).where("keep = 1").drop("keep")
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "turn", "rank", "candidate_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("turn")


def provenance(rows: DataFrame) -> DataFrame:
    """qid, candidate_id, score (its best) and the sorted labels of the options that found it."""
    return rows.groupBy("qid", "candidate_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("label")).alias("retrieval_options"))


def chunked(spark: SparkSession, docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """Candidates of whole texts: trimmed windows, with char_start and char_end. docs: doc_id, text and what else is to be carried."""
    from folioscan.functions.chunk import sliding

    rest = [c for c in docs.columns if c != "text"]
    # posexplode would have the windows made again for a filter on their number
    spans = docs.where("text IS NOT NULL").select(*rest, F.posexplode_outer(sliding(F.col("text"), F.lit(0), F.length("text"), size, overlap)).alias("chunk_no", "s")).where("s IS NOT NULL")
    return spans.select(*rest, "chunk_no", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.col("s.text").alias("text"))
