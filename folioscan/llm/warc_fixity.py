"""Merkle fixity audit of WARC replicas: records and their ordered offset ranges hashed into trees, compared from the roots down.

A leaf hashes a record's bytes with its length and number of equal copies; FAN neighbours, in the order of their offsets, make a node that hashes
its children and the length of its range, up to one root for each file. Lengths are those of the range and not offsets from the start, so a
record that grew changes only the nodes above it. The audit compares roots, looks only at the children of nodes that differ, and aligns the
records of differing leaves by their hash, so that a lost or added record doesn't flag those that it moved. Both trees of a file are made
and walked in one row; files are dealt by hash and hold about PER_FILE records each.

Equal records (same page_id, url and html) stand next to each other and make one leaf with their number. Null urls and pages count as empty, null
ids come first and are spread over files like others. A repeated page_id with another page is a record of its own. A file that one replica
lacks has all its records missing or extra. Empty tables give no rows; columns other than page_id, url and html are left alone.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

FAN, PER_FILE = 16, 2048
END = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC record without the separator after it."""
    body, named = F.coalesce(html, F.lit("")), F.translate(F.coalesce(url, F.lit("")), "\r\n", "  ")
    head = ["WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("")), ">\r\nWARC-Target-URI: ", named, "\r\nContent-Length: ", F.octet_length(body).cast("string"), END]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head], body)


def measured(page_id: Column, url: Column, html: Column) -> Column:
    """struct(page_id, length, sha256) of a record with its separator."""
    return let(F.concat(record(page_id, url, html), F.lit(END)).cast("binary"), lambda raw: F.struct(page_id.alias("page_id"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("sha256")))


def laid_out(rows: DataFrame) -> DataFrame:
    """file, page_id, length, sha256, copies and offset of rows that have file, r (a measured record) and place (what orders a file)."""
    one = rows.groupBy("file", "place", "r").agg(F.count("*").alias("copies"))
    w = Window.partitionBy("file").orderBy("place", "r").rowsBetween(Window.unboundedPreceding, -1)
    return one.select("file", "r.*", "copies", F.coalesce(F.sum(F.col("copies") * F.col("r.length")).over(w), F.lit(0)).alias("offset"))


def placed(pages: DataFrame, files: int) -> DataFrame:
    """Every page with its measured record r, its file and its place there."""
    own = pages.select("page_id", "url", "html", measured(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    return own.select("*", F.pmod(F.xxhash64("page_id", "r.sha256"), F.lit(files)).cast("int").alias("file"), F.struct("page_id", "r.sha256").alias("place"))


def records(pages: DataFrame, files: int) -> DataFrame:
    return laid_out(placed(pages, files))


def write(pages: DataFrame, files: int, path: str) -> None:
    """WARC files: one for each file=<n> folder; records in order, each followed by a blank line."""
    own = placed(pages, files).select("file", "place", record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    own.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").option("lineSep", END).text(path)


def parsed(raw: bytes):
    """(page_id, offset, length, sha256) of each record; what can't be read as records is one record without id."""
    at = 0
    while at < len(raw):
        end = raw.find(END.encode(), at)
        size = re.search(rb"Content-Length: (\d+)$", raw[at:end]) if end >= 0 else None
        stop = end + 4 + int(size[1]) + 4 if size else len(raw)
        if stop > len(raw) or raw[stop - 4 : stop] != END.encode():
            stop, size = len(raw), None
        name = re.search(rb"<urn:page:(-?\d+)>", raw[at:end]) if size else None
        yield int(name[1]) if name else None, at, stop - at, hashlib.sha256(raw[at:stop]).hexdigest()
        at = stop


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of written files, as stored: equal ones are told apart by their offset, copies is 1."""

    def run(batches):
        for b in batches:
            for number, raw in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = list(parsed(raw))
                cols = [pa.array([number] * len(found), pa.int32()), *[pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], pa.array([1] * len(found), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["file", "page_id", "offset", "length", "sha256", "copies"])

    raw = spark.read.format("binaryFile").load(f"{path}/file=*/*").select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("int").alias("file"), "content")
    return raw.mapInArrow(run, "file int, page_id long, offset long, length long, sha256 string, copies long")


Leaf = tuple[int, int | None, int, str, int]  # offset, page_id, length, sha256, copies


def tree(leaves: list[Leaf]) -> list[list[tuple[bytes, int]]]:
    """Levels of (hash, length of the range), from the leaves to the root."""
    levels = [[(hashlib.sha256(f"{sha}:{length}:{copies}".encode()).digest(), length * copies) for _, _, length, sha, copies in leaves]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        parts = [below[i : i + FAN] for i in range(0, len(below), FAN)]
        levels.append([(hashlib.sha256(b"".join(h + n.to_bytes(8, "little") for h, n in part)).digest(), sum(n for _, n in part)) for part in parts])
    return levels


def differing(left: list, right: list) -> list[int]:
    """Places of the leaves that differ, looking only below nodes that do. Trees of unlike height are raised to the same."""
    while len(left) < len(right):
        left = [*left, left[-1]]
    while len(right) < len(left):
        right = [*right, right[-1]]
    at = [0]
    for level, (a, b) in enumerate(zip(reversed(left), reversed(right), strict=True)):
        if level:
            at = [j for i in at for j in range(i * FAN, min(i * FAN + FAN, max(len(a), len(b))))]
        at = [i for i in at if (a[i] if i < len(a) else None) != (b[i] if i < len(b) else None)]
    return at


def compared(left: list[Leaf], right: list[Leaf]) -> list[tuple[Leaf | None, Leaf | None]]:
    """The records of one file that differ: by trees, then aligned by their hash, for a lost or added record moves others."""
    at = differing(tree(left), tree(right))
    l, r = [left[i] for i in at if i < len(left)], [right[i] for i in at if i < len(right)]
    key = lambda x: (x[3], x[4])
    more = Counter(map(key, l))
    more.subtract(map(key, r))
    lost, gained = [], []
    for x in l:
        if more[key(x)] > 0:
            more[key(x)] -= 1
            lost.append(x)
    for x in r:
        if more[key(x)] < 0:
            more[key(x)] += 1
            gained.append(x)
    by: dict = {}
    for x in gained:
        by.setdefault(x[1], []).append(x)
    pairs = [(x, by[x[1]].pop(0) if by.get(x[1]) else None) for x in lost]
    return pairs + [(None, x) for xs in by.values() for x in xs]


def kind(a: Leaf | None, b: Leaf | None) -> str:
    if a is None or b is None:
        return "extra" if a is None else "missing"
    return "changed" if a[2] * a[4] == b[2] * b[4] else "resized"


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, kind (changed, resized, missing, extra) and both sides' page_id, offset, length, sha256 and copies of each record that differs.

    left and right: file, page_id, offset, length, sha256, copies. A record that both sides have, of one page_id and in one differing range of a file, is changed or resized."""
    parts = ["offset", "page_id", "length", "sha256", "copies"]
    both = left.select("file", *parts, F.lit(0).alias("side")).unionByName(right.select("file", *parts, F.lit(1).alias("side")))
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct(*parts)))
    names = ["page_id", "offset", "length", "sha256", "copies"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                l, r = (sorted((tuple(x[c] for c in parts) for x in batch.column(c)[i].as_py()), key=lambda x: x[0]) for c in ("l", "r"))
                rows += [(batch.column("file")[i].as_py(), kind(a, b), a, b) for a, b in compared(l, r)]
            cols = [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.string())]
            cols += [pa.array([x[side][parts.index(c)] if x[side] else None for x in rows], t) for side in (2, 3) for c, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["file", "kind", *names, *[f"replica_{c}" for c in names]])

    one = "page_id long, offset long, length long, sha256 string, copies long"
    schema = f"file int, kind string, {one}, " + ", ".join(f"replica_{c}" for c in one.split(", "))
    return both.groupBy("file").agg(of(0).alias("l"), of(1).alias("r")).mapInArrow(run, schema)


def damaged(own: DataFrame) -> DataFrame:
    """The records of a replica of placed pages, by page_id: every 101st has its last byte changed, every 211th is lost, every 307th is longer, every 401st has another after it."""
    i, url, html = F.col("page_id"), F.col("url"), F.coalesce("html", F.lit(""))
    r = lambda h, u=url: measured(i, u, h)
    flipped = F.concat(F.substr(html, F.lit(1), F.greatest(F.length(html) - 1, F.lit(0))), F.lit("\x01"))
    kept = F.when(i % 211 == 0, F.array().cast(f"array<{own.schema['r'].dataType.simpleString()}>")).when(i % 401 == 0, F.array(F.col("r"), r(html, F.concat(url, F.lit("#added")))))
    kept = kept.when(i % 307 == 0, F.array(r(F.concat(html, F.lit(" and more"))))).when((i % 101 == 0) & (F.octet_length(F.substr(html, F.length(html))) == 1), F.array(r(flipped))).otherwise(F.array("r"))
    return own.select("file", "place", F.explode(kept).alias("r"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' WARC records against a replica with changed, lost, grown and added records."""
    pages = table(spark, sf_dir, "pages")
    own = placed(pages, 1 + pages.count() // PER_FILE)
    return audit(laid_out(own), laid_out(damaged(own)))
