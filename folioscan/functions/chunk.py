"""Splitters: each gives an array of struct(text, start, end) of a text, start and end 0-based code points; some add more fields."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

SPACE = r"(?U)^\s+|\s+$"
SPAN = "array<struct<text:string,start:int,end:int>>"


def _lead(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))


def _tail(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, r"(?U)\s+$", ""))


def _trimmed(raw: Column, start: Column, end: Column) -> Column:
    """struct of a stretch without white space at its ends, offsets moved along; most windows have none there and need no pattern run over them."""

    def of(x: Column) -> Column:
        whole = F.struct(x.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        less = F.struct(F.regexp_replace(x, SPACE, "").alias("text"), (start + _lead(x)).cast("int").alias("start"), (end - _tail(x)).cast("int").alias("end"))
        return F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"(?U)\s"), less).otherwise(whole)

    return T.let(raw, of)


def sliding(text: Column, start: Column, end: Column, size: int, overlap: int) -> Column:
    """Windows of `size` from start to end, each `overlap` into the one before; the last is the first to reach the end. Trimmed; blank ones go."""
    step = max(1, size - overlap)

    def of(s: Column) -> Column:
        # the last start is the least that reaches the end: start + k step + size >= end
        last = F.greatest(F.lit(0), F.ceil((s.b - s.a - size) / step)).cast("int")
        one = lambda i: T.let(F.struct(i.alias("a"), F.least(s.b, i + size).alias("b")), lambda w: _trimmed(F.substr(text, w.a + 1, w.b - w.a), w.a, w.b))
        made = F.transform(F.sequence(F.lit(0), last), lambda k: one(s.a + k * step))
        return F.when(s.b > s.a, F.filter(made, lambda x: x.text != "")).otherwise(F.array().cast(SPAN))

    # the end is mostly a length, which is counted from the text's first byte: once, not for each window
    return T.let(F.struct(start.alias("a"), end.alias("b")), of)


def paragraphs(text: Column) -> Column:
    """The stretches between blank lines, trimmed."""
    parts = F.split(F.regexp_replace(text, r"(?U)(\n\s*\n)\s*", "$1\x02"), "\x02", -1)
    offsets = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), lambda a, x: F.struct((a.at + F.length(x)).alias("at"), F.array_append(a.out, _trimmed(x, a.at, a.at + F.length(x))).alias("out")), lambda a: a.out)
    return F.filter(T.let(parts, offsets), lambda x: x.text != "")


def packed_paragraphs(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs joined by blank lines as long as they fit in `size`; a longer one is cut by sliding().

    C2 and C3 of this order agree: what was gathered goes out before a long paragraph, or before one that doesn't fit."""
    empty = F.array().cast(SPAN)
    start = F.struct(empty.alias("out"), empty.alias("held"), F.lit(0).alias("n"))
    joined = lambda held: F.struct(F.array_join(F.transform(held, lambda x: x.text), "\n\n").alias("text"), F.get(held, F.lit(0)).start.alias("start"), F.element_at(held, -1).end.alias("end"))
    flushed = lambda a: F.when(F.size(a.held) > 0, F.array_append(a.out, joined(a.held))).otherwise(a.out)

    def step(a: Column, p: Column) -> Column:
        n = F.length(p.text)
        fits = a.n + F.when(F.size(a.held) > 0, 2).otherwise(0) + n <= size
        long_ = F.struct(F.concat(flushed(a), sliding(text, p.start, p.end, size, overlap)).alias("out"), empty.alias("held"), F.lit(0).alias("n"))
        more = F.struct(a.out.alias("out"), F.array_append(a.held, p).alias("held"), (a.n + F.when(a.n > 0, 2).otherwise(0) + n).alias("n"))
        new = F.struct(flushed(a).alias("out"), F.array(p).alias("held"), n.alias("n"))
        return F.when(n > size, long_).when((F.size(a.held) == 0) | fits, more).otherwise(new)

    return F.aggregate(paragraphs(text), start, step, flushed)


def split_text(text: Column, size: int, overlap: int) -> Column:
    """Cleaned text in chunks of whole paragraphs where they fit."""
    return T.let(T.clean(text), lambda t: packed_paragraphs(t, size, overlap))


def split_spans(text: Column, size: int, overlap: int) -> Column:
    """As split_text(), but only runs of empty lines are brought down before."""
    return T.let(T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n")), lambda t: packed_paragraphs(t, size, overlap))


def split_plain(text: Column, size: int, overlap: int) -> Column:
    """array<string>: paragraphs joined as long as they fit; windows of longer ones go on to the very end, so the last may lie in the one before."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("held"))
    flushed = lambda a: F.when(a.held != "", F.array_append(a.out, a.held)).otherwise(a.out)
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(max(1, size - overlap))), lambda i: F.substr(p, i + 1, F.lit(size)))

    def step(a: Column, p: Column) -> Column:
        both = F.when(a.held != "", F.concat_ws("\n\n", a.held, p)).otherwise(p)
        alone = F.when(F.length(p) <= size, F.struct(flushed(a).alias("out"), p.alias("held"))).otherwise(F.struct(F.concat(flushed(a), cut(p)).alias("out"), F.lit("").alias("held")))
        return F.when(F.length(both) <= size, F.struct(a.out.alias("out"), both.alias("held"))).otherwise(alone)

    cleaned = T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n"))
    parts = F.filter(F.transform(F.split(cleaned, r"(?U)\n\s*\n", -1), T.strip), lambda x: x != "")
    return F.aggregate(parts, start, step, flushed)


# Fixed value: the heading of an article.
ARTICLE = r"(?m)(?=^第[一二三四五六七八九十百千万零〇两0-9]+条)"


def split_articles(text: Column, size: int, overlap: int) -> Column:
    """array<struct(text, start, end, article)>: an article each, long ones cut by sliding(); what stands before the first by split_spans()."""
    kind = "array<struct<text:string,start:int,end:int,article:string>>"
    t = T.strip(F.replace(F.coalesce(text, F.lit("")), F.lit("﻿"), F.lit("")))

    def of(x: Column) -> Column:
        parts = F.split(x, ARTICLE, -1)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(a: Column, p: Column) -> Column:
            name = F.nullif(F.regexp_extract(p, r"^(第[一二三四五六七八九十百千万零〇两0-9]+条)", 1), F.lit(""))
            end = a.at + F.length(p)
            whole = F.when(F.length(p) <= size, F.filter(F.array(_trimmed(p, a.at, end)), lambda y: y.text != "")).otherwise(sliding(x, a.at, end, size, overlap))
            spans = F.when(name.isNull(), split_spans(p, size, overlap)).otherwise(whole)
            named = F.transform(spans, lambda y: F.struct(y.text.alias("text"), y.start.alias("start"), y.end.alias("end"), name.alias("article")))
            return F.struct(end.alias("at"), F.concat(a.out, named).alias("out"))

        return F.aggregate(parts, begin, step, lambda a: a.out)

    return T.let(t, of)


def pages(text: Column) -> Column:
    """array<struct(page, start, end)> between the page markers; a text without any is one section without a page."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?=\[PDF_PAGE_\d+\])", -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:int,start:int,end:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        mark = F.regexp_extract(p, r"^(\[PDF_PAGE_\d+\])", 1)
        page = F.regexp_extract(p, r"^\[PDF_PAGE_(\d+)\]", 1).try_cast("int")
        end = a.at + F.length(p)
        return F.struct(end.alias("at"), F.when(mark != "", F.array_append(a.out, F.struct(page.alias("page"), (a.at + F.length(mark)).alias("start"), end.alias("end")))).otherwise(a.out).alias("out"))

    none = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.lit(0).alias("start"), F.length(text).alias("end")))
    return T.let(F.aggregate(parts, begin, step, lambda a: a.out), lambda x: F.when(F.size(x) > 0, x).otherwise(none))


def page_chunks(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """doc_id, page, start, end, text (cleaned), candidate_id, quote_sha256, raw_sha256, page_numbering: fixed windows that never cross a page."""
    step = size - overlap
    one = docs.select("doc_id", "text", F.explode(pages(F.col("text"))).alias("p"))
    last = F.greatest(F.lit(0), F.ceil((F.col("p.end") - F.col("p.start") - size) / step)).cast("int")
    one = one.where("p.end > p.start").select("doc_id", "text", "p", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("p.start") + F.col("k") * step
    one = one.select("doc_id", F.col("p.page").alias("page"), start.alias("start"), F.least(start + size, F.col("p.end")).alias("end"), "text")
    one = one.withColumn("raw", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    one = one.withColumn("text", T.clean(F.col("raw"))).where("text != ''")
    named = F.concat_ws(":", "doc_id", F.coalesce(F.col("page").cast("string"), F.lit("None")), "start", "text")
    numbering = F.when(F.col("page").isNotNull() & (F.col("page") != 0), "physical_1_based").otherwise("not_paginated")
    return one.select("doc_id", "page", "start", "end", "text", F.left(F.sha2(named, 256), F.lit(24)).alias("candidate_id"), F.sha2("text", 256).alias("quote_sha256"), F.sha2("raw", 256).alias("raw_sha256"), numbering.alias("page_numbering"))
