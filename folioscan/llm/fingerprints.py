"""Homomorphic multiset hash of documents: sums of wide vectors hashed from their paragraphs.

A text is the multiset of its `\\n`-separated paragraphs, blank ones included; null counts as the empty
text. Every paragraph gives two vectors. The strong one is sixteen 32-bit numbers of its SHA-512; sums are
taken modulo 2**32. The soft one counts the set bits of the 64-bit hashes of the paragraph's neighbouring
word pairs, in 60 lanes. Sums commute, so the order of paragraphs does
not matter, and `combine` inserts or deletes paragraphs without the rest of the text. Equal texts have
equal fingerprints; the likeness of two is the cosine of their soft vectors about the mean, not below 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, let, table, words

STRONG, MOD, SHIFTS, FIELD = 16, 1 << 32, 20, 20
MASK = 1 | 1 << FIELD | 1 << 2 * FIELD


def strong(paragraphs: Column) -> Column:
    def lanes(p: Column) -> Column:
        d = F.sha2(p.cast("binary"), 512)
        return F.transform(F.array(d), lambda x: F.transform(F.sequence(F.lit(0), F.lit(STRONG - 1)), lambda i: F.conv(F.substr(x, i * 8 + 1, F.lit(8)), 16, 10).cast("long")))[0]

    zero = F.array_repeat(F.lit(0).cast("long"), STRONG)
    return F.aggregate(paragraphs, zero, lambda a, p: F.zip_with(a, lanes(p), lambda x, y: (x + y) % MOD))


def soft(paragraphs: Column) -> Column:
    """[number of pairs, 60 lanes]: how many pairs' hashes have each of 60 bits.

    Three lanes are summed in one number as long as none can pass FIELD bits; beyond that many pairs each lane is summed by itself."""
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    hashes = F.flatten(F.transform(paragraphs, lambda p: let(words(p), pairs)))
    total = lambda h, k, mask: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftright(x, k).bitwiseAND(F.lit(mask)))
    parts = lambda s: F.array(*[F.shiftright(s, at * FIELD).bitwiseAND(F.lit((1 << FIELD) - 1)) for at in range(3)])
    packed = lambda h: F.flatten(F.array(*[let(total(h, k, MASK), parts) for k in range(SHIFTS)]))
    single = lambda h: F.array(*[total(h, k + at * FIELD, 1) for k in range(SHIFTS) for at in range(3)])
    return let(hashes, lambda h: F.concat(F.array(F.size(h).cast("long")), F.when(F.size(h) < 1 << FIELD, packed(h)).otherwise(single(h))))


def fingerprint(text: Column) -> Column:
    """struct(strong, soft) of a whole text."""
    return F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "\n", -1)), lambda p: F.struct(strong(p).alias("strong"), soft(p).alias("soft")))[0]


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or of a without b's paragraphs (sign -1)."""
    s = F.zip_with(a.strong, b.strong, lambda x, y: F.pmod(x + sign * y, F.lit(MOD)))
    return F.struct(s.alias("strong"), F.zip_with(a.soft, b.soft, lambda x, y: x + sign * y).alias("soft"))


def digest(f: Column) -> Column:
    h = F.transform(f.strong, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.concat(F.array_join(h, ""), F.lit("-"), F.array_join(F.transform(f.soft, lambda x: F.lower(F.hex(x))), "."))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for two without words, 0 where one alone has none."""

    lanes = lambda s: F.transform(F.slice(s, 2, 3 * SHIFTS), lambda x: (2 * x - s[0]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    of = lambda x, y: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))), F.lit(0.0))))
    both = F.transform(F.array(F.struct(lanes(a.soft).alias("x"), lanes(b.soft).alias("y"))), lambda v: of(v.x, v.y))[0]
    return F.when(a.soft == b.soft, F.lit(1.0)).otherwise(both)


def with_next(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Each row with next_<column> of the row before it in `key` (the last gets the first's), without a global sort.

    Rows go to ranges of the key between approximate quantiles, four to each shuffle partition; the highest row
    of each range also goes to the range above it. Only the edges and one key for each range reach the driver.
    Equal keys are ordered by the carried columns' hash. An empty table stays empty."""
    spark = rows.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(rows.select(F.percentile_approx(key, [i / n for i in range(1, n)], 4 * n)).first()[0] or []))
    steps = [1 << i for i in range(len(edges).bit_length() - 1, -1, -1)] if edges else []
    if edges:
        e = F.lit(edges)
        at = F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when((lo + s <= len(edges)) & (F.get(e, lo + s - 1) <= F.col(key)), lo + s).otherwise(lo))
    else:
        at = F.lit(0)
    tops = sorted((r.b, r.top) for r in rows.select(at.alias("b"), key).groupBy("b").agg(F.max(key).alias("top")).collect())
    above = {b: tops[(i + 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}
    rows = rows.withColumn("_b", at)
    if not tops:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried]).drop("_b")
    arr = lambda xs, kind: F.lit(xs).cast(f"array<{kind}>")
    i = F.array_position(arr([b for b, _ in tops], "int"), F.col("_b")).cast("int") - 1
    goes = F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost")))
    also = F.array(F.struct(F.get(arr([above[b] for b, _ in tops], "int"), i).alias("b"), F.lit(1).alias("ghost")))
    dealt = rows.withColumn("_to", F.explode(F.when(F.col(key) == F.get(arr([t for _, t in tops], "bigint"), i), F.concat(goes, also)).otherwise(goes)))
    w = Window.partitionBy("_to.b").orderBy("_to.ghost", F.desc(key), "_tie")
    dealt = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return dealt.where("_to.ghost = 0").drop("_b", "_to")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text. Rows of equal doc_id follow each other by the hash of their text; a null doc_id comes last."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("_k"), t.alias("text"), F.xxhash64(t).alias("_tie"))
    rows = with_next(docs.withColumn("f", fingerprint(F.col("text"))), "_k", ["text", "f"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "f", "next_f", edited.alias("edited"))
    out = rows.withColumn("g", F.transform(F.array("edited"), fingerprint)[0])
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("f")).alias("fingerprint"), digest(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )
