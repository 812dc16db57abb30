import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import bpe, fingerprints, line_dedup, mixing, ngram_join, quality_model, quality_rules, token_counts, toxicity, warc_fixity
from folioscan.llm.common import with_stats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long"
LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, LONG, "en", "b", 0, 1), (2, LONG + " tail", "en", "b", 0, 2), (3, LONG, None, None, 0, 3), (4, None, "en", "a", None, None), (5, "", "en", "a", 0, 1),
    (6, "one two", "en", "a", 0, 1), (7, "ONE two", "en", "c", 0, 1), (8, " \n\t ", "en", "c", 0, 1), (9, "x " * 4000, "en", "d", 0, 1), (10, "a b c\n" + LONG + "\n\nend of it", "en", "d", 0, 1),
    (12, "p q r s t u v w p q r s t u v w z", "en", "a", 0, 1), (13, "# a\n# a\n\nb", "en", "a", 0, 1), (14, "\n".join(f"short line number {i} here" for i in range(30)), "en", "a", 0, 1), (15, "intro\n" + "\n".join(f"short line number {i} here" for i in range(4, 28)) + "\nend", "en", "a", 0, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_join(docs, empty):
    sets = {}
    for i, t, *_ in ROWS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()}
    assert got == {i: (len(sets[i]), part[i]) for i in sets}
    assert ngram_join.joined(empty).count() == 0
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {i for i in sets if part[i] == i}


def test_join_of_chains(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = [set(ngram_join.shingles(t).tolist()) for _, t in rows]
    part = list(range(120))
    for _ in range(6):
        for a in range(120):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = {r.doc_id: r.component_id for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(part))


def test_lines(docs, empty):
    places, gone = {}, {}
    lines = {i: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in (t or "").split("\n") if words(x)] for i, t, *_ in ROWS}
    for i, x in sorted(lines.items()):
        for a in range(len(x)):
            for b in range(a + 1, len(x) + 1):
                if sum(len(words(y)) for y in x[a:b]) >= 50:
                    key = tuple(x[a:b])
                    if key in places and places[key] != (i, a):
                        gone.setdefault(i, set()).update(range(a, b))
                    places.setdefault(key, (i, a))
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {i: len(gone.get(i, ())) for i in lines}
    assert got[4].text is None and got[10].text == "a b c\n\nend of it" and got[15].text == "intro\nend" and got[1].text == LONG
    assert line_dedup.dedup(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), f"s{i % 7}" if i % 3 else "s0") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 900 and (got.taken <= 3 * got["size"]).all()
    own = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    weight = dict(zip(sorted(own.index), [5, 2, 1, 5, 2, 1, 5], strict=True))
    target, free, left = {}, set(own.index), float(own["size"].sum())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * own["size"][s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * own["size"][s]
            left -= target[s]
            free.remove(s)
    assert all(abs(own.target[s] - target[s]) < 1e-6 for s in target)
    assert (abs(own.taken - own.target) <= 2 * mixing.BLOCK).all()
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0


def test_statistics(docs):
    got = {r.doc_id: r for r in with_stats(docs).collect()}
    for i, t, *_ in ROWS:
        w, t = words(t), t or ""
        seen, hit = {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                hit |= {k + d for k in at for d in range(8)}
        x = [y for y in t.split("\n") if words(y)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(x) - len(set(x)), len(hit))


def test_repeated_words_of_random_texts(spark):
    import random

    draw = random.Random(2)
    rows = [(i, "".join(x + draw.choice([" ", " ", "\n", "\t "]) for x in draw.choices(["a", "b", "\u00e9\u4e2d", "C9|"][: draw.randint(1, 4)], k=draw.randint(0, 60)))) for i in range(400)]
    made = with_stats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in made.collect()}
    for i, t in rows:
        w = words(t)
        at = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        again = {j + k for j, x in enumerate(at) if at.count(x) > 1 for k in range(8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(again))
    # words are cut once for all their statistics
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("split(text") == 2  # words and lines


def test_rules():
    rows = [(i, int(i % 10 != 0), 0.9 if i % 10 == 0 else 0.1, (i * 7 % 13) / 13) for i in range(600)]
    rules = quality_rules.learn(rows, ["u", "v"])
    assert rules and all(c[0] == "u" for c in rules[0]) and quality_rules.learn([], ["u", "v"]) == []


def test_additive_model():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.Gam(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert quality_model.Gam(np.zeros((0, 4)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_toxicity():
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(400):
        w = [f"{'abcdefgh'[k % 8]}or{'stuvw'[k % 5]}e" for k in rng.integers(0, 400, 60)]
        if i % 4 == 0:
            w[int(rng.integers(0, 60))] = ["vilething", "grossness"][i % 8 // 4]
        texts.append(" ".join(w))
        y.append(float(i % 4 == 0))
    m = toxicity.Model(texts, np.array(y))
    assert m.score("aorse bortue vilethhing corve") > m.score("aorse bortue corve dorse") and m.score("") < 0.3


def test_codec(spark, docs, empty):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import base64

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encoded(docs, path, P.PATTERN).collect()}
    for i, t, *_ in ROWS:
        ids = np.array(e.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encoded(empty, path, P.PATTERN).count() == 0
    path = P.path("byte_bpe_50k.json")
    counts = {r.doc_id: r for r in token_counts.count(docs, path).collect()}
    t = token_counts.tokenizer(path)
    assert {i: r.n_tokens for i, r in counts.items()} == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x, *_ in ROWS}
    text = ("don't  stop<|endoftext|> now\n\n12 x " * 400)
    assert sum(len(t.encode(p, add_special_tokens=False)) for p in token_counts.parts(text, 100)) == len(t.encode(text, add_special_tokens=False))


def test_codec_merges_and_remembers(monkeypatch):
    import random

    P = pytest.importorskip("public_tokenizers")
    own, draw = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(1)
    kinds = ["ab", "etaoinshr", "\u00e9\u00fc\u00df\u4e2d", "0123456789", "!-=/ ", "\U0001f600\u0301a"]
    for _ in range(3000):
        x = "".join(draw.choices(draw.choice(kinds), k=draw.randint(1, 60))).encode()
        assert own.merged_short(x) == own.merged(x)
    monkeypatch.setattr(bpe, "KEPT", 20)
    merged = []
    short = own.merged_short
    monkeypatch.setattr(own, "merged_short", lambda x: merged.append(x) or short(x))
    text = " qzqzx " + " ".join(f"zqx{a}{b} qzqzx" for a in "abcdefghij" for b in "abcdefghij")
    assert own.decode(own.encode(text)) == text.encode() and len(own.known) + len(own.older) <= 20
    assert merged.count(b" qzqzx") == 1  # a pre-token in use isn't forgotten and merged anew


def test_fingerprints(spark, tmp_path, empty):
    rows = [(i, t) for i, t, *_ in ROWS]
    for name, df in (("full", spark.createDataFrame(rows, "doc_id long, text string")), ("none", empty.select("doc_id", "text"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert fingerprints.op1_fingerprints(spark, f"{tmp_path}/none").count() == 0
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, f"{tmp_path}/full").collect()}
    ids = sorted(got, reverse=True)
    text = {i: t or "" for i, t in rows}
    for k, i in enumerate(ids):
        n, half = len(text[i]), len(text[i]) // 2
        edited = text[i][: n - half] + text[ids[(k + 1) % len(ids)]][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == n
        assert 0 <= got[i].near_edited <= 1
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[4].fingerprint == got[5].fingerprint
    two = spark.createDataFrame([("a b\nc d", "c d\na b", "a b", "c d")], "x string, y string, p string, q string").select(*[fingerprints.fingerprint(F.col(c)).alias(c) for c in "xypq"])
    r = two.select(F.col("x") == F.col("y"), fingerprints.combine(F.col("p"), F.col("q")) == F.col("x"), fingerprints.combine(F.col("x"), F.col("q"), -1) == F.col("p")).first()
    assert list(r) == [True, True, True]


def test_likeness_of_very_long_texts(spark):
    """More word pairs than a packed lane can count: likeness is as for short texts."""
    x = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_100_000)), lambda i: F.concat(F.lit("w"), (i % 5000).cast("string"))), " ")
    y = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_100_000)), lambda i: F.concat(F.lit("v"), (i % 5000).cast("string"))), " ")
    part = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(50_000)), lambda i: F.concat(F.lit("w"), (i % 5000).cast("string"))), " ")
    f = spark.range(1).select(fingerprints.fingerprint(x).alias("x"), fingerprints.fingerprint(y).alias("y"), fingerprints.fingerprint(part).alias("p"))
    r = f.select(F.col("x.soft")[0].alias("n"), fingerprints.likeness(F.col("x"), F.col("p")).alias("same"), fingerprints.likeness(F.col("x"), F.col("y")).alias("other")).first()
    assert r.n == 1_100_001 and r.same > 0.99 and r.other < 0.5


def test_fixity(spark, tmp_path):
    W = warc_fixity
    rows = [(i if i % 10 else None, f"u{i}", "x" * (i % 50) if i % 7 else None) for i in range(1, 900)] + [(5000, "u", "same")] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = W.placed(pages, 3)
    text = F.coalesce("html", F.lit(""))
    r = lambda h: W.measured(F.col("page_id"), F.col("url"), h)
    left = W.laid_out(own)
    longer = own.select("file", "place", F.when(F.col("page_id") == 333, r(F.concat(text, F.lit("yy")))).otherwise(F.col("r")).alias("r"))
    got = W.audit(left, W.laid_out(longer)).collect()
    assert [(x.kind, x.page_id, x.replica_length - x.length) for x in got] == [("resized", 333, 2)]
    lost = own.where("page_id IS NULL OR page_id NOT IN (11, 512)").select("file", "place", F.when(F.col("page_id") == 77, r(F.translate(text, "x", "z"))).otherwise(F.col("r")).alias("r"))
    got = {(x.kind, x.page_id) for x in W.audit(left, W.laid_out(lost)).collect()}
    assert got == {("missing", 11), ("missing", 512)} | ({("changed", 77)} if 77 % 7 else set())
    assert W.audit(left, left).count() == 0 and W.audit(left.limit(0), left.limit(0)).count() == 0
    assert {x.kind for x in W.audit(left, left.where("file != 1")).collect()} == {"missing"}
    assert left.where("page_id = 5000").first().copies == 40
    W.write(pages, 3, f"{tmp_path}/warc")
    back = W.read(spark, f"{tmp_path}/warc")
    assert back.count() == len(rows) and back.agg(F.sum("length")).first()[0] == left.agg(F.sum(F.col("length") * F.col("copies"))).first()[0]
    assert {r.sha256 for r in back.select("sha256").collect()} == {r.sha256 for r in left.select("sha256").collect()}
    assert [x[0] for x in W.parsed(b"no record")] == [None]


def test_fixity_query(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(2500)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.kind, r.page_id if r.page_id is not None else r.replica_page_id) for r in warc_fixity.op8_warc_fixity(spark, str(tmp_path)).collect()}
    kind = lambda i: "missing" if i % 211 == 0 else "extra" if i % 401 == 0 else "resized" if i % 307 == 0 else "changed" if i % 101 == 0 else None
    assert got == {(kind(i), i) for i in range(2500) if kind(i)}
