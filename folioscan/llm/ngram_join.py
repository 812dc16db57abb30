"""Similarity join of documents on five-word shingles, Jaccard 0.75 or more, and the components of its links.

Rows with equal shingle sets form a class, and the classes are linked. Shingles are ordered rare first by document counts in 2**21 hash
classes over all documents (any one order is exact; the counts make prefixes rare: 8 MB, whatever the input), and each class emits its
prefix. Tokens of the prefixes go to buckets by their hash in packed blocks, and what meets there twice or more is kept. Before that, each task
brings the tokens that its own documents share down to one, so a shingle of very many documents reaches a bucket once for each task.

First every member of a shingle's group meets the heart of its band of sizes, the set in which the shingle stands earliest: it has the fewest rare shingles of its own, so
of near copies it is the least edited one. This joins groups of near copies without pairing them: of a set's hearts the one with most shingles in common is verified. Then only members of groups that still hold several components meet. Pairs pass a length and
a positional filter and a suffix filter on counts of the sets' shingles in 256 parts (the sum of the lesser counts bounds what two sets
share) before any text is fetched, in the last step within the join itself; then each is verified once on whole texts. Shingles and sets are compared by 64-bit
hashes of their words' 64-bit hashes.

A text of one to four words is one shingle; an empty or null one has none and links with nothing. Rows of equal doc_id can have other texts; each
links by its own. In op10 a row without doc_id is left out of links, in keep_one it is not. Empty tables give empty results;
other columns, whatever their names, are only used to tell rows apart in keep_one.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpoint, delete, fresh, table, written

WIDTH, NUM, DEN, CLASSES, PARTS, PLANES = 5, 75, 100, 1 << 21, 256, 48
RANGE = 1 << 12  # count classes in a block
TOKENS = 1 << 22  # prefix tokens that a task holds at once
PER_BUCKET = 1 << 20  # prefix tokens of a bucket, as long as 2**16 buckets are enough
FEW = 2_000_000  # keys that may be broadcast; more are joined by a shuffle


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (and the last end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found = lists.flatten().dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    names = found.dictionary.to_pylist()
    code = found.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    real = np.array([w != "" for w in names], bool)[code] if names else np.zeros(0, bool)
    h = (np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)[code] if names else np.zeros(0, np.uint64))[real]
    n_words = np.bincount(owner[real], minlength=len(texts))
    first = np.r_[0, np.cumsum(n_words)]
    size = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(at[-1], np.uint64)
    for k in range(1, WIDTH + 1):  # texts of k words, the last k standing for all longer ones
        of = np.flatnonzero(n_words == k if k < WIDTH else n_words >= k)
        if len(of):
            spot = np.repeat(at[of] - np.r_[0, np.cumsum(size[of])[:-1]], size[of]) + np.arange(size[of].sum())
            start = spot + np.repeat(first[of] - at[of], size[of])
            acc = np.full(len(spot), k, np.uint64)
            for d in range(k):
                acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[start + d])
            out[spot] = acc
    out = out.view(np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][size > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][at]


def shingles(text: str | None) -> np.ndarray:
    return sets_of(pa.array([text], pa.string()))[0]


def slices(batch: pa.RecordBatch, rows: int = 256):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def planes(s: np.ndarray) -> list[int] | None:
    """How many shingles are in each of PARTS parts, as bits: the k-th PARTS bits tell which parts have k or more. None for sets that need more than PLANES."""
    n = np.bincount(s & (PARTS - 1), minlength=PARTS)
    most = int(n.max(initial=0))
    if most > PLANES:
        return None
    return np.packbits(n[None, :] >= np.arange(1, most + 1)[:, None], axis=1).reshape(-1).view("<i8").tolist()


def shared_at_most(x: Column, y: Column) -> Column:
    """What two sets can share at most: the sum over parts of the lesser count, which is what their planes have in common."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(F.bit_count(a.bitwiseAND(b)), F.lit(0))), F.lit(0), lambda t, v: t + v)


def suffix_passes(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """The suffix filter; sets without planes pass."""
    return pa_.isNull() | pb.isNull() | ((DEN + NUM) * shared_at_most(pa_, pb) >= NUM * (na + nb))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, k, n, sig (of the whole set) and planes of each row of keyed docs, and besides, rows with at and counts: each task's counts by range of classes."""

    def run(batches):
        total = np.zeros(CLASSES, np.uint32)
        names = ["doc_id", "k", "n", "sig", "planes", "at", "counts"]
        kind = None
        for whole in batches:
            kind = whole.schema.field("doc_id").type
            for b in slices(whole):
                flat, at = sets_of(b.column("text"))
                np.add.at(total, flat & (CLASSES - 1), np.uint32(1))
                parts = [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                sig = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in parts], np.uint64).view(np.int64)
                cols = [b.column("doc_id"), b.column("k"), pa.array(np.diff(at)), pa.array(sig), pa.array([planes(x) for x in parts], pa.list_(pa.int64())), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
        blocks = [(i, total[i * RANGE : (i + 1) * RANGE]) for i in range(CLASSES // RANGE)]
        blocks = [(i, x.astype(np.uint8) if x.max() < 256 else x) for i, x in blocks if x.any()]
        if blocks:
            m = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.list_(pa.int64())), pa.array([i for i, _ in blocks], pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], names)

    return docs.select("doc_id", "k", "text").mapInArrow(run, "doc_id long, k long, n long, sig long, planes array<long>, at int, counts binary")


def class_counts(base: DataFrame) -> np.ndarray:
    """How many documents' shingles are in each class: CLASSES numbers, added up range by range."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("at").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint8 if len(raw) == RANGE else "<u4")
                sums.setdefault(i, np.zeros(RANGE, np.int64))
                sums[i] += x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()], pa.binary())], ["at", "counts"])

    out = np.zeros(CLASSES, np.uint32)
    for r in base.where("at IS NOT NULL").select("at", "counts").repartition("at").mapInArrow(run, "at int, counts binary").collect():
        out[r["at"] * RANGE : (r["at"] + 1) * RANGE] = np.frombuffer(r["counts"], "<u4")
    return out


FIELDS = [("h", "<i8"), ("id", "<i8"), ("n", "<i4"), ("p", "<i4"), ("heart", "<i8"), ("ok", "i1")]


def packed(cols: list[np.ndarray]) -> bytes:
    """Token columns h, id, n, p (of a bucket: six bytes of h, two of n and p if they fit), or rows with heart and ok."""
    h, id_, n, p, *rest = cols
    short = int(n.max(initial=0) < 1 << 16)
    small = "<u2" if short else "<u4"
    body = [np.array([len(h), short], "<u4").tobytes()]
    body.append(h.astype("<i8").tobytes() if rest else h.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
    body += [id_.astype("<i8").tobytes(), n.astype(small).tobytes(), p.astype(small).tobytes()]
    return b"".join(body + [x.astype(t).tobytes() for x, (_, t) in zip(rest, FIELDS[4:])])


def unpacked(raw: bytes, bucket: int | None) -> list[np.ndarray]:
    m, short = np.frombuffer(raw, "<u4", 2).tolist()
    at, out = 8, []
    if bucket is None:
        kinds = ["<i8", "<i8"]
    else:
        low = np.zeros((m, 8), np.uint8)
        low[:, :6] = np.frombuffer(raw, np.uint8, 6 * m, at).reshape(m, 6)
        out.append(low.view("<i8").reshape(m) | (bucket << 48))
        at, kinds = at + 6 * m, ["<i8"]
    for kind in [*kinds, *["<u2" if short else "<u4"] * 2, *([] if bucket is not None else ["<i8", "i1"])]:
        out.append(np.frombuffer(raw, kind, m, at))
        at += np.dtype(kind).itemsize * m
    return out


def possible(na, pa_, nb, pb):
    """Length and positional filters for tokens of two sets (n: set size, p: 0-based place in the order); numpy or columns."""
    least, most = (F.least, F.greatest) if isinstance(na, Column) else (np.minimum, np.maximum)
    return (NUM * most(na, nb) <= DEN * least(na, nb)) & ((DEN + NUM) * least(na - pa_, nb - pb) >= NUM * (na + nb))


def met(h, id_, n, p) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which tokens go on (those alone and the hearts of each group), and rows h, id, n, p, heart, ok of the groups of two sets or more.

    A group has a heart for each band of sizes that can be alike at all, in two rows of bands that overlap by half."""
    o = np.argsort(h, kind="stable")
    same = h[o][1:] == h[o][:-1]
    many = np.r_[False, same] | np.r_[same, False] if len(o) else np.zeros(0, bool)
    alone, o = o[~many], o[many]
    o = o[np.lexsort((id_[o], n[o], p[o], h[o]))]
    o = o[np.r_[True, (h[o][1:] != h[o][:-1]) | (id_[o][1:] != id_[o][:-1])]] if len(o) else o
    new = np.r_[True, h[o][1:] != h[o][:-1]] if len(o) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    several = (np.bincount(group) > 1)[group] if len(o) else np.zeros(0, bool)
    n64, level, hearts = n.astype(np.int64), np.log(np.maximum(n[o], 1)) / np.log(DEN / NUM), []
    for shift in (0.0, 0.5):
        band = np.floor(level + shift).astype(np.int64)
        q = np.lexsort((np.arange(len(o)), band, group))
        first = np.r_[True, (group[q][1:] != group[q][:-1]) | (band[q][1:] != band[q][:-1])] if len(o) else np.zeros(0, bool)
        heart = np.empty(len(o), np.int64)
        heart[q] = q[first][np.cumsum(first) - 1]
        hearts.append(o[heart])
    alike = [(o != x) & possible(n64[o], p[o], n64[x], p[x]) for x in hearts]
    more = several & alike[1] & (hearts[0] != hearts[1])
    a, b = np.r_[o[several], o[more]], np.r_[hearts[0][several], hearts[1][more]]
    return np.unique(np.r_[alone, *hearts]), [h[a], id_[a], n[a], p[a], id_[b], np.r_[alike[0][several], alike[1][more]]]


def shared_tokens(docs: DataFrame, counts: np.ndarray, tokens: int) -> DataFrame:
    """h, id, n, p, heart, ok: the prefix tokens that two sets or more share. id is a set's sig; a pair of id and heart may be alike only if ok."""
    held = docs.sparkSession.sparkContext.broadcast(counts)
    bits = int(min(16, max(8, np.ceil(np.log2(max(1, tokens // PER_BUCKET))))))

    def deal(batches):
        count, parts, size, seen = held.value, [], 0, set()

        def flush():
            h, id_, n, p = (np.concatenate(c) for c in zip(*parts, strict=True))
            go, rows = met(h, id_, n, p)
            bucket = (h[go].view(np.uint64) >> np.uint64(48)).astype(np.int64)
            order = go[np.argsort(bucket, kind="stable")]
            edge = np.searchsorted(np.sort(bucket), np.arange((1 << bits) + 1))
            made = [(i, packed([x[order[edge[i] : edge[i + 1]]] for x in (h, id_, n, p)])) for i in range(1 << bits) if edge[i] < edge[i + 1]]
            # what is shared within the task needs no bucket: it goes anywhere, in even parts
            made += [(-1 - int(rows[0][i] & 1023), packed([x[i : i + 65536] for x in rows])) for i in range(0, len(rows[0]), 65536)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["bucket", "block"])

        for whole in batches:
            for b in slices(whole):
                flat, at = sets_of(b.column("text"))
                order_by = count[flat & (CLASSES - 1)]
                for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                    s, m = flat[i:j], j - i
                    if not m:
                        continue
                    sig = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))
                    if sig in seen:
                        continue
                    seen.add(sig)
                    keep = m - -(-NUM * m // DEN) + 1
                    key = s[np.argsort(order_by[i:j], kind="stable")[:keep]].view(np.uint64)
                    key = (key >> np.uint64(64 - bits) << np.uint64(48) | key & np.uint64((1 << 48) - 1)).view(np.int64)
                    parts.append((key, np.full(keep, sig, np.int64), np.full(keep, m, np.int32), np.arange(keep, dtype=np.int32)))
                    size += keep
                if size > TOKENS:
                    yield from flush()
                    parts, size, seen = [], 0, set()
        if parts:
            yield from flush()

    def gather(batches):
        at, blocks = None, []

        def rows(cols):
            for i in range(0, len(cols[0]), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + 65536]).astype(t)) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.int32, np.int64, bool), strict=True)], ["h", "id", "n", "p", "heart", "ok"])

        def done():
            if len(blocks) > 1:
                h, id_, n, p = (np.concatenate(c) for c in zip(*blocks, strict=True))
                yield from rows(met(h, id_, n.astype(np.int32), p.astype(np.int32))[1])

        for b in batches:
            for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                if bucket < 0:
                    yield from rows(unpacked(raw, None))
                    continue
                if bucket != at:
                    yield from done()
                    at, blocks = bucket, []
                blocks.append(unpacked(raw, bucket))
        yield from done()

    dealt = docs.select("text").mapInArrow(deal, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "h long, id long, n int, p int, heart long, ok boolean")


def profiles(base: DataFrame) -> DataFrame:
    """sig, n and planes of each set."""
    return base.where("k IS NOT NULL").select("sig", "n", "planes").dropDuplicates(["sig"])


def near(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs (a, b) of sigs that the suffix filter lets through."""
    side = lambda v: profiles(base).select(F.col("sig").alias(v), F.col("n").alias(f"n{v}"), F.col("planes").alias(f"p{v}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return full.where(suffix_passes(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) of sigs whose sets are alike enough, by the whole texts of one row of each."""

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                ends = pa.concat_arrays([b.column("ta"), b.column("tb")]).dictionary_encode()
                flat, at = sets_of(ends.dictionary)
                of = ends.indices.to_numpy(zero_copy_only=False)
                good = []
                for x, y in zip(of[: b.num_rows].tolist(), of[b.num_rows :].tolist(), strict=True):
                    s, t = flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]]
                    good.append((NUM + DEN) * len(np.intersect1d(s, t, assume_unique=True)) >= NUM * (len(s) + len(t)))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = checkpoint(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(heads, "sig").select("sig", F.col("rep").alias("k"))
    wanted = checkpoint(wanted)
    own = docs.select("k", "text")
    texts = own.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "k").groupBy("sig").agg(F.first("text").alias("text"))
    full = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): c the least vertex that v reaches; large and small stars by turns until nothing changes."""
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = checkpoint(e)
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == seen:
            return e.select(F.col("u").alias("v"), F.col("v").alias("c"))
        seen = now


def in_components(rows: DataFrame, part: DataFrame) -> DataFrame:
    """rows with c, the component of their id: itself where it has no link."""
    return rows.join(part.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and k, by which rows are told apart; only rows that are equal in all columns share it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(*docs.columns).alias("k"))


def grouped(docs: DataFrame, unnamed: bool) -> tuple[DataFrame, DataFrame]:
    """Of keyed docs: every row's doc_id, k, n, sig; and sig, best (doc_id and k of its component's first row).

    Rows without doc_id are linked, after all others, if `unnamed`."""
    spark = docs.sparkSession
    base, _ = written(described(docs))
    every = base.where("k IS NOT NULL").select("doc_id", "k", "n", "sig")
    named = every.where("n > 0" if unnamed else "n > 0 AND doc_id IS NOT NULL")
    first_of = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    heads = named.groupBy("sig").agg(F.min(first_of).alias("head")).select("sig", "head", F.col("head.k").alias("rep"))
    tokens = int(every.agg(F.sum("n")).first()[0] or 0) * (DEN - NUM) // DEN
    own = docs if unnamed else docs.where("doc_id IS NOT NULL")
    shared, shared_path = written(shared_tokens(own, class_counts(base), tokens))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    # of each set's hearts the one that it shares most tokens with
    stars = shared.where("ok").groupBy("id", "heart").agg(F.count("*").alias("both"))
    first = stars.groupBy("id").agg(F.max_by("heart", F.struct("both", "heart")).alias("heart")).select(*pair("id", "heart")).distinct()
    first = checkpoint(near(first, base))
    links = checkpoint(verified(first, docs, heads))
    part = components(links)
    rows = shared.select("h", "id", "n", "p").distinct()
    tagged = in_components(rows, part)
    mixed = tagged.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h")
    open_ = tagged.join(mixed, "h")
    open_, open_path = written(open_.join(profiles(base).select(F.col("sig").alias("id"), "planes"), "id"))
    delete(spark, shared_path)
    # the shorter first; those already joined don't meet again
    s, t = F.col("s.n").cast("long"), F.col("t.n").cast("long")
    meet = (F.col("s.h") == F.col("t.h")) & (F.col("s.c") != F.col("t.c")) & (F.struct("s.n", "s.id") < F.struct("t.n", "t.id")) & possible(s, F.col("s.p"), t, F.col("t.p"))
    meet = meet & suffix_passes(s, F.col("s.planes"), t, F.col("t.planes"))
    more = open_.alias("s").join(open_.alias("t"), meet).select(*pair("s.id", "t.id")).distinct()
    second = checkpoint(verified(more.join(first, ["a", "b"], "left_anti"), docs, heads))
    delete(spark, open_path)
    whole = components(links.unionByName(second))
    of = heads.join(whole.withColumnRenamed("v", "sig"), "sig", "left").select("sig", "head", F.coalesce("c", "sig").alias("c"))
    best = of.groupBy("c").agg(F.min("head").alias("best"))
    return every, of.join(best, "c").select("sig", "best")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    every, of = grouped(keyed(docs.select("doc_id", "text")), False)
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return every.join(of, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of least doc_id, one without doc_id only where none has one; rows without words link with nothing and stay."""
    _, of = grouped(keyed(docs), True)
    k = fresh(docs, "row_key")[0]
    own = docs.withColumn(k, F.xxhash64(*docs.columns))
    has = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = own.where(has).dropDuplicates([k]).join(of.select(F.col("best.k").alias(k)).distinct(), k, "left_semi")
    return own.where(~has).unionByName(kept).select(*docs.columns)
