"""Measures of retrieval and answers, audits and samples, as aggregates and windows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recalls(df: DataFrame, ks: Sequence[int] = (3, 5)) -> DataFrame:
    """df (found, gold: arrays) with recall_at_k and all_at_k; the denominator is the gold set, which must not be empty."""
    gold = F.array_distinct("gold")
    gold = F.when(F.size(gold) > 0, gold).otherwise(F.raise_error(F.lit("No gold evidence")).cast("array<string>"))
    hits = lambda k: F.size(F.array_intersect(F.slice("found", 1, k), gold))
    return df.select("*", *[c for k in ks for c in ((hits(k) / F.size(gold)).alias(f"recall_at_{k}"), (hits(k) == F.size(gold)).cast("int").alias(f"all_at_{k}"))])


def routing(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, domain (null: all), total, any_hit, all_hit and their shares. df: domain, doc_ids, routed (best first)."""
    routed = F.coalesce("routed", F.array().cast("array<string>"))
    one = df.select("domain", F.array_distinct("doc_ids").alias("named"), routed.alias("routed"), F.explode(F.lit(sorted(set(ks)))).alias("k"))
    one = one.select("k", "domain", F.size("named").alias("n"), F.size(F.array_intersect(F.slice("routed", F.lit(1), F.col("k")), F.col("named"))).alias("hits"))
    # a rollup over (k, domain) less its grand total: k always tells rows apart
    sets = one.rollup("k", "domain").agg(F.grouping_id().alias("g"), F.count("*").alias("total"), F.count_if(F.col("hits") > 0).alias("any_hit"), F.count_if(F.col("hits") == F.col("n")).alias("all_hit")).where("g < 2").drop("g")
    return sets.select("*", F.round(F.col("any_hit") / F.col("total"), 6).alias("any_recall"), F.round(F.col("all_hit") / F.col("total"), 6).alias("all_recall"))


def routing_failures(df: DataFrame, k: int) -> DataFrame:
    """qid, missed: the named documents that are not among the first k."""
    missed = F.array_except("doc_ids", F.slice(F.coalesce("routed", F.array().cast("array<string>")), 1, k))
    return df.select("qid", missed.alias("missed")).where(F.size("missed") > 0)


def by_sets(df: DataFrame, variant: str, kind: str, values: Sequence[str]) -> DataFrame:
    """Means of values by variant, and by variant and kind (null: all kinds), with counts."""
    out = df.groupingSets([[F.col(variant)], [F.col(variant), F.col(kind)]], F.col(variant), F.col(kind))
    return out.agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def paired(df: DataFrame, key: str, variant: str, reference: str, value: str) -> DataFrame:
    """Each row's difference to the reference variant's row of the same key."""
    ref = df.where(F.col(variant) == reference).select(key, F.col(value).alias("ref"))
    return df.where(F.col(variant) != reference).join(ref, key).withColumn("difference", F.col(value) - F.col("ref"))


def wins(pairs: DataFrame, variant: str) -> DataFrame:
    d = F.col("difference")
    return pairs.groupBy(variant).agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_difference"))


def cluster_interval(pairs: DataFrame, cluster: str, by: Sequence[str], repeats: int = 2000, seed: int = 7) -> DataFrame:
    """Mean difference of each group with a 95 % interval: clusters drawn with return `repeats` times, all their rows with them.

    Clusters' sums and counts are aggregated first; the c-th draw of repeat r is a hash of (seed, r, c), so reruns and partitions agree. One row for each
    draw and repeat of a group: clusters times repeats, aggregated by repeat before anything is shuffled to one place."""
    per = pairs.groupBy(*by, cluster).agg(F.sum("difference").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    per = per.withColumn("i", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("m", F.count("*").over(w))
    draws = per.select(*by, "m", F.col("i").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r"))
    draws = draws.select(*by, "r", F.pmod(F.xxhash64(F.lit(seed), "r", "c"), F.col("m")).cast("int").alias("i"))
    sums = draws.join(per.select(*by, "i", "s", "n"), [*by, "i"]).groupBy(*by, "r").agg((F.sum("s") / F.sum("n")).alias("mean"))
    at = lambda q: F.element_at("means", int(q * (repeats - 1)) + 1)
    cis = sums.groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("means")).select(*by, at(0.025).alias("low"), at(0.975).alias("high"))
    point = per.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("difference"), F.count("*").alias("clusters"))
    return point.join(cis, list(by))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """The value at rank floor((n - 1) p) of each group, never between two, by a window: no group is gathered."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * p), F.col(value))).alias(f"p{round(p * 100)}") for p in ps])


def stratified(df: DataFrame, stratum: str, key: str, salt: str, n: int) -> DataFrame:
    """The first n of each stratum by sha256(salt + key), with h; `place` is their order by h over all strata."""
    h = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    few = df.withColumn("h", h).withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("h"))).where(F.col("rank") <= n)
    return few.withColumn("place", F.row_number().over(Window.orderBy("h")))  # n rows for each stratum


def weighted(df: DataFrame, population: DataFrame, stratum: str, value: str) -> DataFrame:
    """The estimate of value over a population from a sample by strata."""
    means = df.groupBy(stratum).agg(F.avg(value).alias("mean"), F.count("*").alias("sampled"))
    return means.join(population, stratum).agg((F.sum(F.col("mean") * F.col("size")) / F.sum("size")).alias("estimate"), F.sum("sampled").alias("sampled"))


def counters(df: DataFrame, *columns: str) -> DataFrame:
    """column, value, n of each column: one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def top_warnings(df: DataFrame, items: str, order: Sequence[Column], limit: int = 30) -> DataFrame:
    """The most frequent items, those seen first on a tie."""
    one = df.select(F.struct(*order).alias("o"), F.posexplode(items).alias("at", "warning"))
    counted = one.groupBy("warning").agg(F.count("*").alias("n"), F.min(F.struct("o", "at")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(limit).select("warning", "n")


def with_total(df: DataFrame, key: str, label: str, *values: str) -> DataFrame:
    """A row `label` with the sums of values, then df; `place` puts it first."""
    total = df.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]).select(F.lit(label).alias(key), *values, F.lit(0).alias("place"))
    return total.unionByName(df.select(F.col(key).cast("string").alias(key), *values, F.lit(1).alias("place")))


def duplicated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
