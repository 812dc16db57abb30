"""Toxicity: subword-bag embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word's bag is its character n-grams of 3 to 5 between < and >, hashed into BUCKETS rows; a run of more than RUN characters counts as
words of RUN characters that overlap, so that no n-gram is lost. A word's vector is the mean of its bag's, a text's the mean of its words'
(one of fewer than SHORTEST words is filled up with average words, so that a single word of a very short text doesn't decide alone), and a linear softmax of two classes gives the
score. Embeddings and softmax are learned together by gradient steps that are scaled by each parameter's curvature and shrunk by a
ridge, so that n-grams of a few texts stay near nought; the scores are calibrated on what models of two thirds of the rows say of the
other third. Learned from a bounded sample of labelled rows: SAMPLE rows and BYTES bytes, whole rows only. Misspellings that were never
seen share most n-grams with their word.

Null, empty and wordless texts get the score of average words. With no labels of both kinds all score 0. Repeated rows score alike.
Rows keep all their columns, extra ones included; the score's column can be named. Empty tables give no rows.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import labelled, table

SAMPLE, BYTES = 3000, 1 << 24  # labelled rows and bytes of their texts at most that the model is fitted on
BUCKETS, DIM, STEPS, FOLDS = 1 << 16, 8, 60, 3
RATE, MOMENTUM, RIDGE, CAUTION = 0.1, 0.8, 0.01, 12.0
SHORTEST = 64
KEPT, PART = 300_000, 256  # words whose scores a worker remembers; rows whose texts it holds as Python strings at once
RUN, LONGEST = 40, 5  # characters of a word, of an n-gram
_WORD = re.compile(r"\w+")


def runs(text: str) -> list[str]:
    """The words of a text in lower case, long ones cut into overlapping pieces."""
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) <= RUN:
        return found
    least = LONGEST - 1
    return [x for w in found for x in ([w] if len(w) <= RUN else [w[i : i + RUN] for i in range(0, len(w) - least, RUN - least)])]


def grams(word: str) -> list[int]:
    w = f"<{word}>"
    found = {w[i : i + n] for n in (3, 4, LONGEST) for i in range(len(w) - n + 1)} | {w}
    return sorted({xxhash.xxh32_intdigest(x) % BUCKETS for x in found})


class Bags:
    """The sample as sparse arrays: words by their n-grams, texts by their words and how much of the text each is."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        found = [np.unique(np.array([known.setdefault(w, len(known)) for w in runs(t)], np.int64), return_counts=True) for t in texts]
        bags = [np.array(grams(w), np.int64) for w in known]
        self.n_texts, self.n_words = len(texts), len(bags)
        self.size = np.array([len(b) for b in bags], float)
        self.flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
        self.starts = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.int64)[: len(bags)]
        self.word = np.concatenate([f[0] for f in found])
        self.text = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        count = np.concatenate([f[1] for f in found]).astype(float)
        self.share = count / np.maximum(np.bincount(self.text, count, len(texts)), SHORTEST)[self.text]

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Each text's mean of its words' means of n-gram weights."""
        if not self.n_words:
            return np.zeros(self.n_texts)
        words = np.add.reduceat(weights[self.flat], self.starts) / self.size
        return np.bincount(self.text, words[self.word] * self.share, self.n_texts)

    def onto_grams(self, per_text: np.ndarray, power: int) -> np.ndarray:
        """Sums over texts of per_text * share**power, brought down to the n-grams."""
        words = np.bincount(self.word, per_text[self.text] * self.share**power, self.n_words) / self.size
        return np.bincount(self.flat, np.repeat(words, self.size.astype(np.int64)), BUCKETS)


def learned(bags: Bags, y: np.ndarray, use: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights of the n-grams in the logit: embeddings times the softmax's difference, from the texts in `use`."""
    unit = np.sqrt(max(1e-12, float(np.mean(bags.share**2))))  # shares in units of their size, so that RIDGE means the same for all lengths
    rate = float(np.clip((y * use).sum() / use.sum(), 1e-6, 1 - 1e-6))
    v = np.random.default_rng(seed).normal(0, 1, DIM)
    v /= np.linalg.norm(v)
    e, me, mv, b = np.zeros((BUCKETS, DIM)), np.zeros((BUCKETS, DIM)), np.zeros(DIM), np.log(rate / (1 - rate))
    curve = bags.onto_grams(use * rate * (1 - rate), 2) / unit**2 * CAUTION
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(bags.logits(e @ v) / unit + b, -30, 30)))
        d = (p - y) * use
        g = bags.onto_grams(d, 1) / unit
        me = MOMENTUM * me + (g[:, None] * v + RIDGE * e) / (curve + RIDGE)[:, None]
        mv = MOMENTUM * mv + (g @ e) / (curve @ (e * e) + len(y))
        e -= RATE * me
        v -= RATE * mv
        b -= RATE * d.sum() / max(1e-3, float((p * (1 - p) * use).sum()))
    return (e @ v) / unit


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make logits z fit y, by Newton steps with a unit prior on the slope."""
    mu, sd = z.mean(), z.std() + 1e-9
    u, a, c = (z - mu) / sd, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + c, -30, 30)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * u * u).sum() + 1, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-3]])
        a, c = np.array([a, c]) - np.linalg.solve(h, [((p - y) * u).sum() + a - 1, (p - y).sum()])
    a = max(float(a), 0.0)
    return a / sd, float(c) - a * mu / sd


class Model:
    def __init__(self, texts: list[str], y: np.ndarray):
        self.table, self.scale, self.bias, self.known = np.zeros(BUCKETS, np.float32), 0.0, -30.0, {}
        if not len(y) or y.min() == y.max():
            return
        bags, fold = Bags(texts), np.arange(len(y)) % FOLDS
        filled = np.bincount(bags.text, bags.share, len(y))

        def padded(z: np.ndarray) -> tuple[np.ndarray, float]:
            usual = float(z.sum() / max(1e-9, filled.sum()))
            return z + (1 - filled) * usual, usual

        other = np.zeros(len(y))
        for k in range(FOLDS):
            other[fold == k] = padded(bags.logits(learned(bags, y, (fold != k).astype(float))))[0][fold == k]
        self.scale, self.bias = calibrated(other, y)
        self.table = learned(bags, y, np.ones(len(y))).astype(np.float32)
        self.usual = padded(bags.logits(self.table))[1]

    usual = 0.0

    def word(self, w: str) -> float:
        s = float(self.table[grams(w)].mean())
        if len(self.known) >= KEPT:
            self.known.clear()
        self.known[w] = s
        return s

    def score(self, text: str) -> float:
        known, word, found = self.known.get, self.word, runs(text)
        s = sum([word(w) if (x := known(w)) is None else x for w in found])
        n = max(len(found), SHORTEST)
        return float(1 / (1 + np.exp(-np.clip(self.scale * (s + (n - len(found)) * self.usual) / n + self.bias, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = sorted((r.doc_id, r.text or "", r.label) for r in labelled(docs, labels, "toxic", SAMPLE, fold != 2, BYTES).collect())
    return Model([r[1] for r in rows], np.array([r[2] for r in rows], float))


def scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score in the column `name`, which must be new; every column stays."""
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.scale, model.bias, model.usual))  # 256 KB, whatever the input

    def run(batches):
        own = Model([], np.zeros(0))
        own.table, own.scale, own.bias, own.usual = held.value
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                yield part.append_column(name, pa.array([own.score(x or "") for x in part.column("text").to_pylist()], pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scores(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
