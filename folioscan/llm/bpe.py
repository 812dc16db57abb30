"""Byte-level BPE in two tiers: a minimal perfect hash over the vocabulary, and merges by a heap for what it misses.

The hash displaces buckets of keys until each key has a slot of its own; a slot holds the key and id, so a strange pre-token
is told apart by one comparison. A miss becomes a linked list of bytes; the heap yields the pair of the least rank, leftmost first.
In a short one the least rank is looked for in a plain list, which is faster than a heap.
Null counts as the empty text, which has no ids and decodes to no bytes.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import table

KEPT = 200_000  # pre-tokens whose ids a worker remembers, half of them since the last change of generation
SHORT, NONE = 64, 1 << 32  # bytes of a short pre-token; above all ranks
M31, M32, MIX = (1 << 31) - 1, (1 << 32) - 1, 0x9E3779B
_held: dict = {}


class PerfectHash:
    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = n // 4 + 1
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        by: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate(h):
            by[(x >> 96) % self.buckets].append(i)
        self.moved, free = [0] * self.buckets, np.ones(n, bool)
        self.slots = np.zeros(n, np.int64)
        a = [x & M32 for x in h]
        b = [(x >> 33) & M31 | 1 for x in h]
        spare = None  # the slots left for buckets of one key, which name their slot itself
        for k in sorted(range(self.buckets), key=lambda k: -len(by[k])):
            if len(by[k]) == 1:
                if spare is None:
                    spare = iter(np.flatnonzero(free).tolist())
                s = next(spare)
                self.moved[k], self.slots[by[k][0]] = -s - 1, s
                continue
            at, width = 0, 32
            while by[k]:
                tries = np.arange(at, at + width, dtype=np.int64) & M32
                slots = np.stack([(((tries * MIX & M32) ^ a[i]) * b[i] >> 20) % n for i in by[k]])
                s = np.sort(slots, 0)
                good = free[slots].all(0) & (s[1:] != s[:-1]).all(0)
                if good.any():
                    j = int(good.argmax())
                    self.moved[k] = at + j
                    free[slots[:, j]] = False
                    self.slots[by[k]] = slots[:, j]
                    break
                at, width = at + width, min(2 * width, 1 << 14)
                if at > 1 << 26:
                    raise ValueError("no displacement found")

    def slot(self, key: bytes) -> int:
        x = xxhash.xxh3_128_intdigest(key)
        moved = self.moved[(x >> 96) % self.buckets]
        return -moved - 1 if moved < 0 else (((moved * MIX & M32) ^ (x & M32)) * ((x >> 33) & M31 | 1) >> 20) % self.n


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        keys = [base64.b64decode(a) for a, _ in pairs]
        ids = [int(b) for _, b in pairs]
        self.split = regex.compile(pattern).findall
        self.hash = PerfectHash(keys)
        self.at: list = [None] * len(keys)
        for k, i, s in zip(keys, ids, self.hash.slots, strict=True):
            self.at[s] = (k, i)
        self.bytes_of = dict(zip(ids, keys, strict=True))
        self.ranks = dict(zip(keys, ids, strict=True))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def rank(self, key: bytes) -> int | None:
        k, i = self.at[self.hash.slot(key)]
        return i if k == key else None

    def merged(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        end, heap = list(range(1, n + 1)), []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := ranks(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        dead = [False] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            if dead[i] or (j := after[i]) >= n or end[j] != to:
                continue
            dead[j] = True
            end[i], after[i] = to, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks(piece[i : end[i]]))
            i = after[i]
        return out

    def merged_short(self, piece: bytes) -> list[int]:
        rank = self.ranks.get
        ends = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < NONE:
            i = pairs.index(least)
            del ends[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[ends[i] : ends[i + 2]], NONE)
            if i:
                pairs[i - 1] = rank(piece[ends[i - 1] : ends[i + 1]], NONE)
        return [rank(piece[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def found(self, raw: bytes) -> bytes:
        own = self.rank(raw)
        ids = [own] if own is not None else self.merged_short(raw) if len(raw) <= SHORT else self.merged(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, text: str) -> bytes:
        ids = self.older.get(text) or self.found(text.encode())
        if len(text) <= SHORT:
            if len(self.known) >= KEPT // 2:  # what was used since the last change stays within reach
                self.older = self.known.copy()
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, piece = self.known.get, self.piece
        return b"".join([known(x) or piece(x) for x in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _held:
        _held[path, pattern] = Codec(path, pattern)
    return _held[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """docs' doc_id with counts and digests of ids and decoded bytes, and the ids themselves as binary if asked for."""

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [own.encode(x or "") for x in part.column("text").to_pylist()]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                cols = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha([own.decode(x) for x in ids])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
