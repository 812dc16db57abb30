"""Repeated runs of lines: winnowed fingerprints over line hashes, joined on their positions and extended both ways.

Lines are the `\\n`-separated lines with a word; blank lines are no part of a run and stay. A window goes on from a line, or back
from one, until it has LEAST words. Winnowing selects each window's least line hash, at its first place in the window: any run of LEAST words that
two places share holds a window, so both select the same line of it as a fingerprint. The fingerprints' positions are joined, and
only those that two positions share go on: what each selecting window has on both sides of its fingerprint is compared (by the hash of the
whole window), and every window that has an earlier place is deleted. Windows on from a run's first lines and back from its last
ones cover the longest match whole, so matches are extended both ways without pairing the places.
Only first places are gathered for a fingerprint, so a line that all documents share stays cheap.

Null texts stay null and empty ones empty. Rows of equal doc_id and text count as one place; null ids come first, told apart by their texts. Other
columns stay as they are, whatever their names; an empty table gives an empty one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, WORD, delete, fresh, let, table, written

LEAST = 50  # words in a run
FEW = 6  # lines in which most windows end; longer ones are looked for apart


def lines_of(text: Column) -> Column:
    def one(x: Column) -> Column:
        return F.struct(F.xxhash64(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one), lambda x: x.n > 0)


def spans(lines: Column, least: int) -> Column:
    """array of (start, size): the window of each line on from it, 0-based; those that end before `least` words are left out."""

    def at(all_: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"))
        step = lambda a, x: F.when(a.n < least, F.struct((a.n + x.n).alias("n"), (a.size + 1).alias("size"))).otherwise(a)
        within = lambda k: F.aggregate(F.slice(all_, i, F.lit(k)), start, step, lambda a: F.when(a.n >= least, a.size))
        # a line has a word at least, so `least` lines are enough; most windows end within the first few
        size = F.coalesce(within(min(FEW, least)), within(least))
        return F.struct((i - 1).alias("start"), size.alias("size"))

    return F.filter(F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: at(lines, i)), lambda y: y["size"].isNotNull())


def both_ways(text: Column, least: int) -> Column:
    """array of (m, p, h, start, size): each window on from a line or back from one, once, with the fingerprint m at line p that it selects."""

    def hashed(x: Column, s: Column) -> Column:
        least_of = lambda hs, m: F.struct(m.alias("m"), (s.start + F.array_position(hs, m).cast("int") - 1).alias("p"), F.xxhash64(hs).alias("h"), s.start.alias("start"), s["size"].alias("size"))
        made = lambda hs: let(F.array_min(hs), lambda m: least_of(hs, m))
        return let(F.transform(F.slice(x, s.start + 1, s["size"]), lambda y: y.h), made)

    def build(x: Column) -> Column:
        back = F.transform(spans(F.reverse(x), least), lambda s: F.struct((F.size(x) - s.start - s["size"]).alias("start"), s["size"].alias("size")))
        return F.transform(F.array_distinct(F.concat(spans(x, least), back)), lambda s: hashed(x, s))

    return let(lines_of(text), lambda x: F.when(F.size(x) > 0, build(x)))


def repeated(docs: DataFrame, id_: str, tie: str, least: int) -> tuple[DataFrame, str]:
    """id_, tie and gone: the numbers, 0-based and sorted, of the lines of later repeated runs; and the path of that table."""
    spark = docs.sparkSession
    # explode would have the windows made again for filters on their number; explode_outer doesn't
    spots = docs.select(F.col(id_).alias("i"), F.col(tie).alias("t"), F.explode_outer(both_ways(F.col("text"), least)).alias("w")).where("w IS NOT NULL")
    spots, path = written(spots.select("i", "t", "w.*"))
    # fingerprints that are selected at two positions
    at = spots.select("m", F.xxhash64("i", "t", "p").alias("at")).groupBy("m").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a != b").select("m")
    met = spots.join(at, "m", "left_semi")
    # the windows on both sides of them: the first place of each, and those after it
    place = F.struct("i", "t", "start")
    first = met.groupBy("m", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    later = met.join(first, ["m", "h"]).where(place != F.col("first"))
    gone = later.groupBy("i", "t").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda s: F.sequence(s.start, s.start + s["size"] - 1))))
    out, kept = written(gone.select(F.col("i").alias(id_), F.col("t").alias(tie), F.array_sort(covered).alias("gone")))
    delete(spark, path)
    return out, kept


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with their text after deletion, n_chars anew, and n_lines and n_removed (named with _ before them where docs have such columns)."""
    id_, tie, gone_, new, n_lines, n_removed = fresh(docs, "dedup_id", "dedup_tie", "dedup_gone", "dedup_new", "n_lines", "n_removed")
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(tie, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = repeated(keyed, id_, tie, least)[0].withColumnRenamed("gone", gone_)
    text = F.col("text")
    has = lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0
    numbered = F.split(text, "\n", -1)
    # numbers of the lines with a word, by their place among all lines: both lists are sorted, so a map by place stays linear
    places = let(numbered, lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(has(x), i)), lambda i: i.isNotNull()))
    bad = let(places, lambda p: F.transform(F.col(gone_), lambda g: F.get(p, g)))
    stay = lambda n, b: F.array_except(F.sequence(F.lit(0), n - 1), b)
    without = let(numbered, lambda xs: let(bad, lambda b: F.array_join(F.transform(stay(F.size(xs), b), lambda i: F.get(xs, i)), "\n")))
    # what is deleted grows with the input, so it is never broadcast
    out = keyed.join(gone.hint("merge"), [id_, tie], "left").withColumn(new, F.when(F.col(gone_).isNull(), text).otherwise(without))
    n = F.coalesce(F.size(F.filter(F.split(text, "\n", -1), has)), F.lit(0)).cast("long")
    cols = [c for c in docs.columns if c not in ("text", "n_chars")]
    return out.select(*cols, F.col(new).alias("text"), F.length(new).cast("long").alias("n_chars"), n.alias(n_lines), F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias(n_removed))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
