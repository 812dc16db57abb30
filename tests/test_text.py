"""Text functions and splitters against plain Python on texts that the given tables don't hold."""
import re

import pytest
from pyspark.sql import functions as F

from folioscan.functions import chunk, html
from folioscan.functions import text as T

TEXTS = [
    "", "  ", "第三条 保险责任等待期为180天，第5款另有规定。AB-1 x 12.5%-3", "2020-2021 增长 -5.2% 和 +3，及 （1,234.50） US$5", "行业趋势预测复合增速渗透率市场规模", "a\n\n\n\nb &amp; c &amp;amp; d\t\t e\r\n", "３５％ full　width", "The the THE, twice: 42 42 1999 2019 abc/def-1.",
    "para one\n\n" + "long " * 60 + "\n \npara three\n\n\n\nfour", "😀 emoji 第十二章 tail", "x" * 25,
]
NUMBER = re.compile(r"(?<![\dA-Za-z])[-+]?\d+(?:,\d{3})*(?:\.\d+)?%?")
WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%/-]*|[一-鿿]{2,}")


def py_tokens(t):
    out = []
    for w in WORD.findall(t):
        w = w.lower()
        if "一" <= w[0] <= "鿿":
            out += [w] * (len(w) <= 8) + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
        else:
            out.append(w)
    return [x for x in out + [n.lower() for n in NUMBER.findall(t)[:120]] if len(x) >= 2]


def py_norm(t):
    return re.sub(T.PUNCT.replace("(?U)", ""), "", t.lower())


def py_windows(t, start, end, size, overlap):
    out, at = [], start
    while at < end:
        stop = min(end, at + size)
        raw = t[at:stop]
        if raw.strip():
            out.append((raw.strip(), at + len(raw) - len(raw.lstrip()), stop - (len(raw) - len(raw.rstrip()))))
        if stop >= end:
            break
        at += max(1, size - overlap)
    return out


def py_paragraphs(t, size, overlap):
    spots, at = [], 0
    for m in [*re.finditer(r"\n\s*\n\s*", t), None]:
        raw = t[at : m.start() if m else len(t)]
        if raw.strip():
            spots.append((raw.strip(), at + len(raw) - len(raw.lstrip()), at + len(raw.rstrip())))
        at = m.end() if m else len(t)
    out, held = [], []
    join = lambda: out.append(("\n\n".join(h[0] for h in held), held[0][1], held[-1][2]))
    for p in spots:
        if held and (len(p[0]) > size or sum(len(h[0]) + 2 for h in held) + len(p[0]) > size):
            join()
            held = []
        if len(p[0]) > size:
            out += py_windows(t, p[1], p[2], size, overlap)
        else:
            held.append(p)
    if held:
        join()
    return out


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("text")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    cols = {"tokens": T.tokens(x), "numbers": T.numbers(x), "norm": T.normalized(x), "grams": T.char_ngrams(x, 2), "clauses": T.clauses(x), "phrases": T.keyphrases(x), "needed": T.required_numbers(x), "clean": T.clean(x), "repaired": T.numbers_repaired(x), "windows": chunk.sliding(x, F.lit(0), F.length(x), 40, 10), "spans": chunk.split_spans(x, 60, 15)}
    return df.select("text", *[c.alias(n) for n, c in cols.items()]).collect()


def test_functions(rows):
    for r in rows:
        t, n = r.text, py_norm(r.text)
        assert r.tokens == py_tokens(t) and r.numbers == NUMBER.findall(t)[:120] and r.norm == n
        assert set(r.grams) == ({n[i : i + 2] for i in range(len(n) - 1)} if len(n) > 1 else {n} - {""}) and len(r.grams) == len(set(r.grams))
        seen, want = set(), []
        for p in [w for w in WORD.findall(t) if len(w) >= 3] + NUMBER.findall(t) + r.clauses:
            if (k := py_norm(p)) and k not in seen:
                seen.add(k)
                want.append(p)
        assert r.phrases == want[:60]
        assert [tuple(x) for x in r.windows] == py_windows(t, 0, len(t), 40, 10)
        tidy = re.sub(r"\n{3,}", "\n\n", t).strip()
        assert [tuple(x) for x in r.spans] == py_paragraphs(tidy, 60, 15)


def test_single_cases(rows):
    by = {r.text: r for r in rows}
    assert by[TEXTS[2]].needed == ["180", "5", "12.5%", "-3"] or "180" in by[TEXTS[2]].needed
    assert by[TEXTS[3]].repaired[:2] == ["2020", "2021"] and by[TEXTS[2]].repaired[-1] == "3"
    assert by[TEXTS[5]].clean == "a\n\nb & c &amp; d e" and by[TEXTS[2]].clauses == ["第5款", "第三条"]


def test_amounts_and_tables(spark):
    df = spark.createDataFrame([("(1,000)", "262 less 472", ["", "2007", "2008"], ["net income", "5", "7"])], "a string, t string, h array<string>, r array<string>")
    r = df.select(T.number_of(F.col("a")).cast("double").alias("v"), T.number_of(F.lit("−5%")).cast("double").alias("m"), T.number_of(F.lit("x")).alias("none"), T.holds_token(F.col("t"), F.lit("47")).alias("part"), T.holds_token(F.col("t"), F.lit("472")).alias("whole"), T.table_row_text(F.col("h"), F.col("r")).alias("row")).first()
    assert (r.v, r.m, r.none, r.part, r.whole) == (-1000.0, -5.0, None, False, True)
    assert r.row == "the net income of 2007 is 5 ; the net income of 2008 is 7 ;"


def test_articles_pages_and_html(spark):
    df = spark.createDataFrame([("前言\n第一条 甲\n第二条 " + "乙" * 50, "[PDF_PAGE_1]aaa[PDF_PAGE_3]bb", '<p>A &amp;amp; B</p><script>x</script><div title="a>b">C<br>D</div>')], "t string, p string, h string")
    r = df.select(chunk.split_articles(F.col("t"), 30, 5).alias("a"), chunk.pages(F.col("p")).alias("p"), html.parsed(F.col("h")).alias("h")).first()
    assert [x.article for x in r.a] == [None, "第一条", "第二条", "第二条"] and r.a[1].text == "第一条 甲"
    assert [tuple(x) for x in r.p] == [(1, 12, 15), (3, 27, 29)] and r.h == "A & B\nC\nD"


def test_bare_entities(spark):
    """&quot without a semicolon, as at a cut, stays in the queries on pages, as in their SQL; by default it is decoded, as a browser does."""
    page = '<p>token = &quot</p><p>a &amp b &quot;c&quot; &am &amp;quot &amp;amp;</p>'
    df = spark.createDataFrame([(page,)], "h string").withColumn("h", F.col("h"))
    r = df.select(html.stripped(F.col("h"), ("amp",)).alias("s"), html.parsed(F.col("h"), ("amp",)).alias("p"), html.article(F.col("h"), ("amp",)).alias("a"), html.stripped(F.col("h")).alias("all"), html.parsed(F.col("h")).alias("pall")).first()
    assert r.s == r.p == r.a == 'token = &quot\na & b "c" &am &quot &'
    assert r["all"] == r.pall == 'token = "\na & b "c" &am " &'
