"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting fits a shallow tree of a single statistic (at most three leaves over its bins) at a time to the residuals and adds it to that
statistic's table; then the pairs whose quadrant cuts explain most of what is left get tables too. A score is the logistic of
the sum of table entries, found by vectorised additions. Learned from a bounded sample of labelled rows, in numpy on the driver.
Null texts are empty and are scored like any other. With no labels of both kinds every score is 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RATES, labelled, table, with_stats

SAMPLE = 12000  # labelled rows at most that the model is fitted on
BINS, PAIR_BINS, ROUNDS, PAIRS, RATE = 32, 8, 120, 6, 0.1


class Gam:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        rate = y.mean() if n and 0 < y.mean() < 1 else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        if not n or not 0 < y.mean() < 1:
            return
        at = self.bins(x)
        f = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(m):
                step = self.tree(at[j], y, f, len(self.tables[j]))
                self.tables[j] += step
                f += step[at[j]]
        coarse = [a * PAIR_BINS // len(t) for a, t in zip(at, self.tables, strict=True)]
        found = sorted(((self.quadrants(coarse[i], coarse[j], y, f)[0], i, j) for i in range(m) for j in range(i)), reverse=True)[:PAIRS]
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in found]
        for _ in range(ROUNDS // 2):
            for i, j, t in self.pairs:
                step = self.quadrants(coarse[i], coarse[j], y, f)[1]
                t += step
                f += step[coarse[i], coarse[j]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    @staticmethod
    def tree(at, y, f, size):
        p = 1 / (1 + np.exp(-f))
        g, h = np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)
        out, parts = np.zeros(size), [(0, size)]
        for _ in range(2):  # cut the part that gains most, twice
            best = None
            for lo, hi in parts:
                if hi - lo > 1:
                    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                    gain = cg[:-1] ** 2 / (ch[:-1] + 5) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 5) - cg[-1] ** 2 / (ch[-1] + 5)
                    k = int(gain.argmax())
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], lo, lo + k + 1, hi)
            if best is None:
                break
            parts = [q for q in parts if q != (best[1], best[3])] + [(best[1], best[2]), (best[2], best[3])]
        for lo, hi in parts:
            out[lo:hi] = RATE * g[lo:hi].sum() / (h[lo:hi].sum() + 5)
        return out

    @staticmethod
    def quadrants(a, b, y, f):
        p = 1 / (1 + np.exp(-f))
        sums = lambda w: np.bincount(a * PAIR_BINS + b, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        g, h = sums(y - p), sums(p * (1 - p))
        best, out = -1.0, np.zeros_like(g)
        for i in range(1, PAIR_BINS):
            for j in range(1, PAIR_BINS):
                four = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
                gain = sum(g[q].sum() ** 2 / (h[q].sum() + 5) for q in four)
                if gain > best:
                    best, out = gain, np.zeros_like(g)
                    for q in four:
                        out[q] = RATE * g[q].sum() / (h[q].sum() + 5)
        return best, out

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        f = np.full(len(x), self.base)
        for a, t in zip(at, self.tables, strict=True):
            f += t[a]
        for i, j, t in self.pairs:
            f += t[at[i] * PAIR_BINS // len(self.tables[i]), at[j] * PAIR_BINS // len(self.tables[j])]
        return 1 / (1 + np.exp(-f))


def fit(docs: DataFrame, labels: DataFrame, where=None) -> Gam:
    own = labelled(docs, labels, "quality", SAMPLE, where)
    stats = with_stats(own.select(F.struct("doc_id", "label").alias("doc_id"), "text"))
    rows = sorted(tuple(r) for r in stats.select("doc_id.doc_id", "doc_id.label", *RATES).collect())
    return Gam(np.array([r[2:] for r in rows], float).reshape(len(rows), len(RATES)), np.array([r[1] for r in rows], float))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs, table(spark, sf_dir, "labels"), fold != 0)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in b])))

    out = with_stats(docs).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), score(*RATES).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
