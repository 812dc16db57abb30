"""Cleans documents for training: toxic documents go, repeated lines go, one of each group of near duplicates stays, sources are mixed, texts are encoded.

Every stage takes documents with doc_id, text, lang, source and n_chars, any other columns besides, and keeps all columns but for the last, which
gives ids. Null and empty texts are kept by the first three stages and have no words to mix; rows may share a doc_id or have none and
are decided one by one; an empty table goes through all stages as an empty table. Each docstring says what becomes of equal rows."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from folioscan.llm.common import delete, fresh, shared_folder, table

REJECTED = 0.3  # score from which a document is toxic


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score REJECTED or more; all others stay, null texts included; equal texts score alike."""
    score = fresh(docs, "toxicity_score")[0]
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), score).where(F.col(score) < REJECTED).drop(score)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its repeated runs of lines deleted and n_chars counted anew; rows of equal doc_id and text count as one place and keep their lines."""
    return line_dedup.dedup(docs).select(*docs.columns)


def clean_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of least doc_id, of equal rows one; texts without words link with nothing and stay."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document whole, as often as comes nearest to the words the mix takes of it, halves up; those nearest to 0 times go. Equal rows are mixed one by one."""
    own = mixing.mix(docs, F.struct(*docs.columns).alias("row")).where("taken > 0")
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    return own.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids as little-endian 32-bit integers, their number and digests: a row for each row."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("toxicity", clean_toxicity), ("line dedup", clean_lines), ("n-gram Jaccard join", clean_near), ("mixing", mix_sources), ("byte-level BPE", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes when the next is written, the last stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        to = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if before:
            delete(spark, before)
        before = to
    return docs
