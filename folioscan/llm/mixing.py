"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at
three times its source's words and the excess is shared anew by weight. Blocks of BLOCK words go to the sources by
the highest quotients target / (2 a + 1), and within a source likewise to its shards, which give integer quotas.
A shard's documents stand in an order seeded by a hash, and its blocks are taken from that order's start, around
again where the quota exceeds the shard. So a document is taken whole a number of times, and once more in part.
No document exceeds three times its size, for a shard's quota stops there. Null or empty texts have size 0 and give 0.
An empty table gives an empty result; equal rows are treated alike but for their place in the order. Shard and place come from a
hash of the whole row, so rows that share a doc_id or have none are spread and decided one by one. Extra columns only enter that hash,
whatever their names; those to be kept are passed as `carried`, packed in a struct where names may clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

BLOCK, CAP, WEIGHTS, SEED = 32, 3, (5, 2, 1), 11
SHARD = 2000  # rows in a shard, about: shards follow from the data alone, so reruns agree under any setting of the session


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_rows, target: a row for each source (a few), by water-filling in closed form."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    w = F.get(F.lit(list(WEIGHTS)), rank).cast("long")
    own = own.select("*", w.alias("weight"), (F.lit(CAP) * F.col("source_size")).alias("cap"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = own.select("*", full.alias("full"), rest.alias("rest"), F.row_number().over(by).alias("at"))
    # a source is at its cap if the level that those from it on would share is above its cap
    own = own.withColumn("capped", F.col("weight") * (F.col("total") - F.col("full")) >= F.col("cap") * F.col("rest"))
    first = Window.partitionBy()
    own = own.withColumn("free_at", F.min(F.when(~F.col("capped"), F.col("at"))).over(first))
    own = own.withColumn("lone_full", F.max(F.when(F.col("at") == F.col("free_at"), F.col("full"))).over(first)).withColumn("lone_rest", F.max(F.when(F.col("at") == F.col("free_at"), F.col("rest"))).over(first))
    level = (F.col("weight") * (F.col("total") - F.col("lone_full"))).cast("double") / F.col("lone_rest")
    capped = F.col("free_at").isNull() | (F.col("at") < F.col("free_at"))
    return own.select("source", "source_size", "n_rows", F.when(capped, F.col("cap").cast("double")).otherwise(level).alias("target"))


def apportion(parts: DataFrame, votes: str, seats: str, within: list[str], keys: list[str]) -> DataFrame:
    """`quota`: the `seats` of each group `within`, by the highest quotients votes / (2 a + 1); ties by keys.

    Nearly all are given at once: floor(votes (seats - n/2) / total + 1/2) are surely among the highest. At most n
    are left for n parts; each part's next quotients as far as they could be needed are ranked."""
    group = Window.partitionBy(*within)
    p = parts.withColumn("_n", F.count("*").over(group)).withColumn("_v", F.sum(votes).over(group))
    sure = F.floor(F.col(votes) * (F.col(seats) - F.col("_n") / 2.0) / F.col("_v") + 0.5 - 1e-9)
    p = p.withColumn("_sure", F.greatest(F.lit(0), F.coalesce(sure, F.lit(0))).cast("long")).withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    # a part's share of what is left can't pass the rounding of its own exact share by more than a few
    ideal = F.ceil(F.coalesce(F.col(votes) * (F.col(seats) + F.col("_n") / 2.0) / F.col("_v"), F.lit(0.0)) + 1).cast("long")
    most = F.least(F.col("_sure") + F.col("_left"), ideal)
    more = p.where((F.col("_left") > 0) & (most > F.col("_sure"))).select("*", F.explode(F.sequence(F.col("_sure"), most - 1)).alias("_a"))
    ranked = more.select(*within, *keys, "_left", F.row_number().over(group.orderBy(F.desc(F.col(votes) / (2 * F.col("_a") + 1)), *keys)).alias("_r"))
    won = ranked.where("_r <= _left").groupBy(*within, *keys).agg(F.count("*").alias("_won"))
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*within, *keys]]
    joined = p.alias("p").join(won.alias("w"), on, "left")
    return joined.select(*[F.col(f"p.{c}") for c in parts.columns], (F.col("p._sure") + F.coalesce("w._won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, source, the `carried` columns, size, source_size, target and taken (words): a row for each of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select("doc_id", "source", *carried, size.alias("size"), F.xxhash64(*docs.columns).alias("_hash"))
    # sizes are counted once, for targets and shards; what is carried, texts say, is read again at the end
    narrow, _ = written(sizes.select("doc_id", "source", "size", "_hash"))
    sizes = sizes if carried else narrow
    by_source = targets(narrow)
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / SHARD).cast("int"))
    few = by_source.withColumn("shards", shards).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")).withColumn("one", F.lit(1))
    few = apportion(few, "target", "blocks", ["one"], ["source"]).withColumnRenamed("quota", "source_quota")
    # as many rows as sources: a handful, whatever the input
    few = few.select(F.col("source").alias("_source"), F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("_no"), "source_size", "target", "shards", "source_quota")
    dealt = lambda rows: rows.join(F.broadcast(few), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.pmod(F.xxhash64("_hash", F.lit(SEED + 1)), F.col("shards")).cast("int"))
    own = dealt(sizes)
    per = dealt(narrow).groupBy("_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = apportion(per.where("shard_size > 0"), "shard_size", "source_quota", ["_no"], ["shard"])
    quotas = quotas.select("_no", "shard", "shard_size", F.least(F.col("quota") * BLOCK, F.col("shard_size") * CAP).alias("words"))
    w = Window.partitionBy("_no", "shard").orderBy(F.xxhash64("_hash", F.lit(SEED)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0)))
    # no source number or shard is null, so the join finds the rows dealt as the window wants them
    own = own.join(quotas, ["_no", "shard"], "left")
    whole = F.coalesce(F.floor(F.col("words") / F.col("shard_size")), F.lit(0)).cast("long")
    left = F.coalesce(F.col("words") % F.col("shard_size"), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("at"))).cast("long")
    kept = sizes.columns[: 2 + len(carried)]
    return own.select(*kept, "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
