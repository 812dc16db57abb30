"""Sinks and what makes a run repeatable: JSON lines, answers in CSV with their total, guarded folders, manifests, checkpoints."""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators.metrics import with_total

from .tables import exists

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


def fresh_folder(spark: SparkSession, path: str) -> str:
    if exists(spark, path):
        raise FileExistsError(f"Choose a new folder: {path}")
    return path


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """df as JSON lines; the number of rows."""
    df.write.mode(mode).json(path)
    return df.sparkSession.read.text(path).count()


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def answer_rows(results: DataFrame) -> DataFrame:
    """qid, answer, tokens: the summary row first, then all rows by qid."""
    rows = results.select("qid", F.coalesce("answer", F.lit("")).alias("answer"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in TOKENS])
    total = with_total(rows.drop("answer"), "qid", "summary", *TOKENS)
    return total.join(rows.select("qid", "answer"), "qid", "left").select("place", "qid", F.coalesce("answer", F.lit("")).alias("answer"), *TOKENS)


def write_answers(results: DataFrame, path: str) -> None:
    """One CSV file with a header, the summary row and a row for each question: as long as the questions, so one partition is right for it."""
    answer_rows(results).orderBy("place", "qid").drop("place").coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def fingerprint(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def data_digest(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order: counts and sums of row hashes."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return fingerprint({"columns": df.columns, "n": r.n, "sum": str(r.s), "xor": r.x})


def run_key(config: dict, **tables: DataFrame) -> str:
    return fingerprint({"config": config, "data": {k: data_digest(v) for k, v in tables.items()}})


def claim(spark: SparkSession, path: str, key: str) -> bool:
    """Whether the folder is new. A folder of another run key is refused."""
    if exists(spark, f"{path}/manifest"):
        if spark.read.text(f"{path}/manifest").first().value != key:
            raise ValueError("The folder belongs to a run with other data or settings")
        return False
    spark.createDataFrame([(key,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return True


def pending(questions: DataFrame, done: DataFrame, run: str) -> DataFrame:
    """Questions without a checkpoint of this run."""
    return questions.join(done.where(F.col("run_key") == run).select("qid"), "qid", "left_anti")


def latest(checkpoints: DataFrame, keys: tuple[str, ...] = ("run_key", "qid"), order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return checkpoints.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distinct_requests(requests: DataFrame, payload: str, log: DataFrame | None = None) -> DataFrame:
    """request, payload, wanted: each payload once, with how many rows want it; those that the log (request, status) knows, also as failed or under way, are not asked again."""
    one = requests.groupBy(F.sha2(payload, 256).alias("request")).agg(F.first(payload).alias(payload), F.count("*").alias("wanted"))
    return one if log is None else one.join(log.select("request"), "request", "left_anti")


def resumable(spark: SparkSession, path: str, questions: DataFrame, config: dict, work, **tables: DataFrame) -> DataFrame:
    """Results of work(pending questions) -> DataFrame with qid, kept under path by run key: a rerun does only what is missing; other data or settings are refused."""
    key = run_key(config, questions=questions, **tables)
    claim(spark, path, key)
    store = f"{path}/results"
    done = spark.read.parquet(store) if exists(spark, store) else None
    todo = questions if done is None else pending(questions, done, key)
    if todo.limit(1).count():
        work(todo).withColumn("run_key", F.lit(key)).write.mode("append").parquet(store)
    return spark.read.parquet(store).where(F.col("run_key") == key) if exists(spark, store) else work(questions.limit(0)).withColumn("run_key", F.lit(key))


def report(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """Small tables as Markdown, `most` rows each."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(str(x) for x in r) + " |" for r in df.limit(most).collect())]
    return "\n".join(out) + "\n"
