"""Whole runs over the driver's tables."""
from pyspark.sql import functions as F

from folioscan.operators import run

from . import adapters as A
from . import retrieval_queries as R

C = F.col


def _parts(spark, sf_dir):
    return A.questions(spark, sf_dir, True), A.docs(spark, sf_dir), A.candidates(spark, sf_dir), A.lexicon(spark)


def _prior(spark, sf_dir):
    i = C("item_id")
    return A.read(spark, sf_dir, "benchmark").select(i.cast("string").alias("qid"), F.get(F.array(*map(F.lit, ("A", "BD", "B", ""))), (i % 4).cast("int")).alias("answer"))


def _flat(df):
    return df.select("qid", C("answer_norm").alias("answer"), "status", "valid_status", F.size("evidence").alias("evidence"), "round")


def run_without_judge(spark, sf_dir):
    """Every question routed, scored, packed and verified without a judgement."""
    return _flat(run.answered(*_parts(spark, sf_dir)))


def run_prior_answers(spark, sf_dir):
    """The same by earlier answers; the rounds of repair are in operators.run."""
    return _flat(run.answered(*_parts(spark, sf_dir), run.prior_judge(_prior(spark, sf_dir)), run.Config(repair_rounds=0)))


QUERIES = {f.__name__: f for f in (run_without_judge, run_prior_answers)}
_PACKED = R.ORACLE_SQL["pack_two_phase"]
# nothing is judged, so no answer, and the evidence is what packing keeps
ORACLE_SQL = {"run_without_judge": f"SELECT CAST(item_id AS VARCHAR) AS qid, '' AS answer, 'needs_model_judge' AS status, 'needs_model_judge' AS valid_status, CAST(coalesce(n, 0) AS INTEGER) AS evidence, 0 AS round FROM benchmark LEFT JOIN (SELECT qid, count(*) AS n FROM ({_PACKED}) GROUP BY qid) p ON p.qid = CAST(item_id AS VARCHAR)"}
