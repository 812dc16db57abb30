"""What a question asks: its features, advice for the search, and the query texts of the question and of each option.

Questions: qid, question, options map<string,string>, domain, answer_format, doc_ids array<string>. A lexicon has domain and terms, a row for each
domain; it is a list written by hand, so its broadcast is bounded by that."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T

from .lexicon import FORMATS, TASKS

NONE = "array<string>"


def option_texts(options: Column) -> Column:
    """The options' texts in the order of their labels."""
    return F.transform(F.array_sort(F.map_keys(options)), lambda k: F.element_at(options, k))


def with_features(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """questions with terms (of their domain), joined, keyphrases, option_keyphrases, numbers, years, clauses, domain_terms, task_flags and warnings."""
    q = questions.join(F.broadcast(lexicon), "domain", "left").withColumn("terms", F.coalesce("terms", F.array().cast(NONE)))
    q = q.withColumn("joined", F.array_join(F.concat(F.array(F.coalesce("question", F.lit(""))), option_texts(F.col("options"))), "\n"))
    norm = T.normalized(F.col("joined"))
    terms = T.let(norm, lambda n: F.filter("terms", lambda t: F.contains(n, T.normalized(t))))
    fmt = F.col("answer_format")
    seen = F.array_compact(F.array(*[F.when(F.col("joined").rlike(p), name) for name, p in TASKS]))
    extra = F.coalesce(*[F.when((fmt == f) & ~F.array_contains(seen, flag), F.array(F.lit(flag))) for f, flag in FORMATS], F.array().cast(NONE))
    warnings = F.array_compact(F.array(F.when(~F.coalesce(fmt, F.lit("")).isin("mcq", "multi", "tf"), "unknown_answer_format"), F.when(F.coalesce(F.size("options"), F.lit(0)) <= 0, "missing_options")))
    return q.select(
        "*", T.keyphrases(F.col("question")).alias("keyphrases"), F.transform_values("options", lambda _, v: T.keyphrases(v)).alias("option_keyphrases"),
        F.array_sort(F.array_distinct(T.numbers(F.col("joined")))).alias("numbers"), T.years(F.col("joined")).alias("years"), T.clauses(F.col("joined")).alias("clauses"),
        terms.alias("domain_terms"), F.concat(seen, extra).alias("task_flags"), warnings.alias("warnings"),
    )


# Advice for a search, general, by flag; domains can add theirs.
GENERAL = ("Settle the kind of question and of answer first; an answer rests on options that evidence supports.", "Search the given documents first, and those of the domain where none is given.", "Search for each option by its names, figures, conditions and clauses.")
BY_FLAG = (
    ("cross_document", "Cover every document in question; one alone decides nothing."),
    ("calculation", "Keep formulas and original figures, with their units."),
    ("clause_applicability", "Keep clause numbers, what they oblige to, and when they apply."),
)


def search_plan(flags: Column, domain_advice: Column | None = None) -> Column:
    """Advice in order: general, of the domain, by flag."""
    own = domain_advice if domain_advice is not None else F.array().cast(NONE)
    return F.concat(F.array(*map(F.lit, GENERAL)), own, F.array_compact(F.array(*[F.when(F.array_contains(flags, f), a) for f, a in BY_FLAG])))


def option_queries(features: DataFrame) -> DataFrame:
    """qid, label, option_text, query: the question with its phrases and domain terms, then the option with its phrases."""
    few = lambda c, n: F.array_join(F.slice(c, 1, n), " ")
    base = T.strip(F.concat_ws("\n", F.coalesce("question", F.lit("")), few("keyphrases", 20), few("domain_terms", 12)))
    q = features.select("qid", base.alias("base"), "option_keyphrases", F.explode("options").alias("label", "option_text"))
    own = F.concat(F.col("label"), F.lit(". "), F.col("option_text"))
    return q.select("qid", "label", "option_text", T.strip(F.concat_ws("\n", "base", own, few(F.element_at("option_keyphrases", F.col("label")), 20))).alias("query"))


def question_queries(features: DataFrame) -> DataFrame:
    """qid, label (null), option_text (empty), query: the question with all phrases and domain terms."""
    query = F.array_join(F.concat(F.array(F.coalesce("question", F.lit(""))), F.col("keyphrases"), F.col("domain_terms")), "\n")
    return features.select("qid", F.lit(None).cast("string").alias("label"), F.lit("").alias("option_text"), query.alias("query"))


def with_query_features(queries: DataFrame) -> DataFrame:
    """queries with q_counts, q_bigrams, q_numbers, q_years, q_clauses, option_norm and option_phrases (normalized, at least three characters)."""
    phrases = F.transform(T.keyphrases(F.col("option_text"), 30), lambda p: F.struct(p.alias("phrase"), T.normalized(p).alias("norm")))
    return queries.select(
        "*", T.token_counts(F.col("query")).alias("q_counts"), T.char_ngrams(F.col("query"), 2).alias("q_bigrams"), F.array_distinct(T.numbers(F.col("query"))).alias("q_numbers"),
        T.years(F.col("query")).alias("q_years"), T.clauses(F.col("query")).alias("q_clauses"), T.normalized(F.col("option_text")).alias("option_norm"), F.filter(phrases, lambda p: F.length(p.norm) >= 3).alias("option_phrases"),
    )
