"""Classifiers on held-out rows, neighbours against brute force, and both on odd rows."""

import numpy as np
import pytest

from skytrace.llm import additive, neighbours, toxicity
from skytrace.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.1"


def auc(y, score):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.85), ("op7_quality", "quality", 0.98)])
def test_held_out(spark, name, label, least):
    got = QUERIES[name][0](spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all() and auc(got[label].to_numpy(), got.score.to_numpy()) > least


@pytest.mark.parametrize("score", [toxicity.toxicity, additive.quality])
def test_classifiers_on_odd_rows(score, odd, none, labels):
    got = score(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert score(odd, labels.limit(0)).count() == odd.count() and score(none, labels).count() == 0


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 9}" for k in range(1, 40))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    neutral = (model.word[:, 0] == model.word[:, 1]).all()
    size = len(model.vocabulary) + 2
    for context in range(1, size):
        p = model.back[context] * model.word
        keys = (context << 20) | np.arange(size)
        at = np.minimum(np.searchsorted(model.keys, keys), max(0, len(model.keys) - 1))
        if len(model.keys):
            hit = model.keys[at] == keys
            p[hit] += model.gain[at[hit]]
        assert (p.sum(0) < 1.01).all() or neutral


@pytest.mark.parametrize(("words", "bigrams"), [(0, 0), (5, 0), (20, 10), (400_000, 3)])
def test_words_and_bigrams_outside_the_head_count_as_well(spark, monkeypatch, words, bigrams):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        bad = i % 3 == 0
        text = " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % (90 if bad else 70))
        rows.append((i, text + (" foul play" if bad and i % 2 else "") + f" only{i}"))
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (3, rows[3][1]), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    score = lambda: sorted(((r.doc_id is None, r.doc_id), r.score) for r in toxicity.toxicity(docs, labels).collect())
    whole = score()
    monkeypatch.setattr(toxicity, "WORDS", words)
    monkeypatch.setattr(toxicity, "BIGRAMS", bigrams)
    monkeypatch.setattr(toxicity, "BLOCK", 4096)
    got = score()
    assert [k for k, _ in got] == [k for k, _ in whole]
    assert np.abs(np.array([s for _, s in got]) - np.array([s for _, s in whole])).max() < 1e-9
    assert np.ptp([s for _, s in whole]) > 0.1


def test_packed_counts_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKET", 300)
    texts = [(" ".join(f"w{(i * k) % 23}" for k in range(1, 30)), i % 2) for i in range(50)] + [("", 1), (None, 0), ("w1", 1)]
    got = toxicity._counted(spark.createDataFrame(texts, "text string, mark int").repartition(5)).collect()
    plain = {}
    for text, mark in texts:
        for w in (text or "").split():
            plain.setdefault(w, [0, 0])[1 - mark] += 1
    assert len({r.key for r in got}) == len(got) and sorted([r.toxic, r.ordinary] for r in got) == sorted(plain.values())
    assert toxicity._counted(spark.createDataFrame([], "text string, mark int")).count() == 0


@pytest.mark.parametrize(("bits", "joined"), [(26, 0), (8, 300)])
def test_labelled_texts_are_not_shuffled(spark, monkeypatch, bits, joined):
    monkeypatch.setattr(toxicity, "BITS", bits)
    seen = []
    monkeypatch.setattr(toxicity, "stored", lambda df, label, *a, f=toxicity.stored: seen.append(f(df, label, *a)) or seen[-1])
    rows = [*((i, f"t{i}") for i in range(-300, 300)), (None, "x"), (5, "again"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = {i: i % 2 for i in range(-300, 400) if i % 3}
    got = toxicity.labelled(docs, spark.createDataFrame(list(marks.items()), "id long, mark int"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, t, marks[i])) for i, t in rows if i in marks)
    assert (seen[-1].count() > joined) if joined else not seen[-1].count()


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive.boost(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.9


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8:
            good.setdefault(i, np.array(v, float))
    for q in sorted(i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
        yield from ((q, r, i, d) for r, (d, i) in enumerate(near, 1))


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1400)] + [(1400, None), (1500, [0.0] * 8), (1600, [float("nan")] * 8), (1700, [1.0]), (None, [1.0] * 8), (1800, [None] * 8), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(exact).orderBy("query_id", "rank").collect()]
    want = list(brute(rows, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    monkeypatch.setattr(neighbours, "BUCKET", 32)  # many buckets
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df).collect()}
    assert len(got & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id < 3")).count() == 2
