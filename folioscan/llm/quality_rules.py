"""Decision lists for quality, learned by sequential covering and applied as Spark conditional expressions.

Each rule is a conjunction of thresholds on a text's statistics and stands for label 0. It is grown on two thirds of a bounded
sample of labelled rows by the gain in information, pruned on the other third, and kept only if it is precise there;
the rows that it covers go before the next is grown. Rows that no rule takes are kept. Null texts are empty, and fail
the base rules; without labels there are no rules and the base rules decide alone.
"""
from __future__ import annotations

import math
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RATES, labelled, table, with_stats

SAMPLE = 8000  # labelled rows at most that the list is learned from
PRECISION, RULES, CONDITIONS, CUTS = 0.9, 16, 4, 24


def learn(rows: list[tuple], names: list[str]) -> list[list[tuple[str, str, float]]]:
    """rows: (key, label, *statistics). Sets of rows are the bits of integers."""
    rows = sorted(rows)
    grow = sum(1 << i for i, r in enumerate(rows) if crc32(f"{r[0]}g".encode()) % 3)
    bad, every = sum(1 << i for i, r in enumerate(rows) if r[1] == 0), (1 << len(rows)) - 1
    tests = []
    for j, name in enumerate(names):
        values = sorted({r[j + 2] for r in rows})
        cuts = values if len(values) <= CUTS else [values[i * len(values) // CUTS] for i in range(1, CUTS)] + [values[-len(values) // 200 - 1], values[len(values) // 200]]
        for cut in sorted(set(cuts)):
            over = sum(1 << i for i, r in enumerate(rows) if r[j + 2] >= cut)
            tests += [((name, ">=", cut), over), ((name, "<", cut), every & ~over)]
    found, left = [], every
    for _ in range(RULES):
        inside, rule = left & grow, []
        while len(rule) < CONDITIONS and inside & ~bad:
            p0, n0 = (inside & bad).bit_count(), inside.bit_count()
            best = max(tests, key=lambda t: (p := (s := inside & t[1]) & bad).bit_count() * (math.log((p.bit_count() or 1e-9) / max(1, s.bit_count())) - math.log(max(p0, 1e-9) / n0)), default=None)
            if best is None or not inside & best[1] or inside & best[1] == inside:
                break
            rule.append(best)
            inside &= best[1]

        def worth(tests, rows):
            s = rows
            for _, t in tests:
                s &= t
            p = (s & bad).bit_count()
            return (2 * p - s.bit_count()) / max(1, s.bit_count()), p, s

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: worth(r, left & ~grow)[:2], default=[])
        if not rule:
            break
        score, p, s = worth(rule, left)
        _, q, checked = worth(rule, left & ~grow)
        if p < 6 or q < PRECISION * max(1, checked.bit_count()) or p < PRECISION * s.bit_count():
            break
        found.append([t[0] for t in rule])
        left &= ~s
    return found


def rejects(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The number of the first rule that takes the row, from 1 on; 0: none."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, op, cut in rule:
            test &= F.col(name) >= cut if op == ">=" else F.col(name) < cut
        out = F.when(test, i).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> list:
    own = labelled(docs, labels, "quality", SAMPLE)
    stats = with_stats(own.select(F.struct("doc_id", "label").alias("doc_id"), "text"))
    return learn([tuple(r) for r in stats.select("doc_id.doc_id", "doc_id.label", *RATES).collect()], RATES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = with_stats(docs).withColumn("base_failed", failed).withColumn("rule", rejects(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
