import numpy as np

from folioscan.llm import toxicity


def test_toxic_part_late_in_a_long_run():
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(400):
        w = [f"{'abcdefgh'[k % 8]}or{'stuvw'[k % 5]}e" for k in rng.integers(0, 400, 60)]
        if i % 4 == 0:
            w[int(rng.integers(0, 60))] = ["vilething", "grossness"][i % 8 // 4]
        texts.append(" ".join(w))
        y.append(float(i % 4 == 0))
    m = toxicity.Model(texts, np.array(y))
    clean = "aorsebortue" * 8
    assert m.score(clean + "vilething") > m.score(clean + "bortecors")


def test_runs_lose_no_ngram():
    for n in (1, 39, 40, 41, 44, 45, 76, 77, 200):
        w = "".join(chr(0x4E00 + i) for i in range(n))
        cut = toxicity.runs(f"a {w} b")
        assert cut[0] == "a" and cut[-1] == "b" and max(map(len, cut)) <= 40
        for k in (3, 4, 5):
            assert {w[i : i + k] for i in range(n - k + 1)} == {x[i : i + k] for x in cut[1:-1] for i in range(len(x) - k + 1)}
    assert toxicity.runs("") == []


def test_a_large_batch_is_scored_in_parts(spark, monkeypatch):
    texts = [None, "", *(f"word{i} vile" for i in range(2000))]
    docs = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "doc_id long, text string, more array<int>").coalesce(1)
    model = toxicity.Model(["vile thing", "fair thing"] * 50, np.array([1.0, 0.0] * 50))
    held = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: held.append(run))
    toxicity.scores(docs, model)
    monkeypatch.undo()
    whole = docs.toArrow().to_batches()[0]
    parts = list(held[0](iter([whole])))
    assert max(p.num_rows for p in parts) <= 256 and sum(p.num_rows for p in parts) == len(texts)
    got = toxicity.scores(docs, model).collect()
    assert [(r.doc_id, r.text, r.more) for r in got] == [(i, t, [i]) for i, t in enumerate(texts)]
    assert np.allclose([r.score for r in got], [model.score(t or "") for t in texts])
