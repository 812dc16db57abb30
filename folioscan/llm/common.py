"""What several operators share: words, table reads, statistics of texts, samples of labels, checkpoints."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is named and Spark runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        import tempfile

        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir() and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which packs many rows better than a checkpoint, and its path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, "") if len(chars) > 1 else F.replace(text, F.lit(chars), F.lit("")))


def repeated_words(w: Column, width: int = 8) -> Column:
    """Of words, those that lie in a window of `width` words found twice or more: O(n log n) for each text, and sorted only where a window repeats."""

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a.sum + p + width - F.greatest(p, a.end)).alias("sum"), (p + width).alias("end"))
        return F.aggregate(at, start, step, lambda a: a.sum)

    def twice(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a.h == b.h, F.array(a.p, b.p)))
        return covered(F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))

    def paired(hs: Column, by: int) -> Column:
        return F.zip_with(F.slice(hs, 1, F.size(hs) - by), F.slice(hs, by + 1, F.size(hs) - by), lambda a, b: F.xxhash64(a, b))

    def repeats(hs: Column, size: int) -> Column:
        """hs: the hash of each window of `size` words; a longer window's is that of two that cover it. Where no half repeats, no whole does."""
        if size < width:
            by = min(size, width - size)
            out = let(paired(hs, by), lambda x: repeats(x, size + by))
        else:
            out = let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p")))), twice)
        return out if 2 * size < width else F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(out)

    return F.when(F.size(w) < width, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), lambda hs: repeats(hs, 1)))


COUNTED = {"n_symbols": "#*$%&|<>", "n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": "0123456789", "n_ends": ".!?", "n_bangs": "!", "n_commas": ",;", "n_breaks": "\n", "n_bars": "|"}


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text (null: empty); only built-in expressions."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", t.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # an array, for Spark would make a struct anew for each of its fields
    of_words = let(words(F.col("text")), lambda w: F.array(F.size(w), F.length(F.array_join(w, "")), repeated_words(w)))
    base = base.select(
        "doc_id",
        of_words.alias("of_words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        *[count_of(F.col("text"), chars).cast("long").alias(name) for name, chars in COUNTED.items()],
        F.length("text").cast("long").alias("length"),
    )
    out = base.select(
        "doc_id",
        F.col("of_words")[0].cast("long").alias("n_words"),
        F.col("of_words")[1].cast("long").alias("word_chars"),
        "n_dup_lines",
        F.col("of_words")[2].cast("long").alias("n_repeat_words"),
        *COUNTED,
        "length",
    )
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    c = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return out.select(
        "*",
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
        (F.col("word_chars") / n).alias("word_length"),
        (F.col("n_symbols") / n).alias("symbol_rate"),
        (F.col("n_dup_lines") / (F.col("n_breaks") + 1.0)).alias("dup_line_rate"),
        (F.col("n_repeat_words") / n).alias("repeat_rate"),
        (F.col("n_upper") / c).alias("upper_rate"),
        (F.col("n_digits") / c).alias("digit_rate"),
        (F.col("n_ends") / n).alias("end_rate"),
        (F.col("n_bangs") / n).alias("bang_rate"),
        (F.col("n_commas") / n).alias("comma_rate"),
        (F.col("n_breaks") / n).alias("break_rate"),
        (F.col("n_bars") / n).alias("bar_rate"),
    )


RATES = ["log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "end_rate", "bang_rate", "comma_rate", "break_rate", "bar_rate"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns, made unlike every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, where: Column | None = None, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text and label of at most `bound` labelled rows, those of the least hash: a documented bound for fitting only.

    A doc_id whose labels clash is left out; of repeated rows of documents all count. With `most_bytes`, rows come in the order of the hash until
    their texts reach it, whole rows only, and `bound` holds for them even where a doc_id has many rows."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        own = own.where(where)
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most").orderBy(*order).limit(bound)
    out = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    if most_bytes is None:
        return out
    order.append(F.xxhash64("text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    out = out.orderBy(*order).limit(bound).withColumn("total", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("total") <= most_bytes).drop("total")
