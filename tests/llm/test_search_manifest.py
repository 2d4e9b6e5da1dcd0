"""Weighted fingerprints, Merkle manifest and lexical search on odd rows, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skytrace.llm import lexical, merkle, weighted_sampling


def test_samples_equal_a_plain_loop():
    texts = ["a b a b c", "", "one", "x y z " * 700, " \n", "a b a b d"]
    got = weighted_sampling.of_texts(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        found, _ = weighted_sampling.pairs(pa.array([text]))
        bag = Counter(found.tolist())
        if not bag:
            assert set(row.tolist()) == {2**32 - 1}
            continue
        terms = np.array(sorted(bag), np.uint64)
        r, c, b = weighted_sampling.Draws()(terms)
        for d in range(0, weighted_sampling.SIZE, 9):
            best = None
            for i, term in enumerate(terms.tolist()):
                t = math.floor(np.float32(np.log(bag[term])) / r[d, i] + b[d, i])
                a = c[d, i] - r[d, i] * (np.float32(t) + np.float32(1) - b[d, i])
                best = min(best or (math.inf,), (a, term, t))
            key = (best[1] + best[2] * 0x9E3779B97F4A7C15) % 2**64
            assert row[d] == weighted_sampling.mix(np.array([key], np.uint64))[0] >> np.uint64(32)


def test_draws_have_their_distributions():
    terms = np.arange(1, 100_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    take = weighted_sampling.Draws()
    r, c, b = (np.concatenate(x, 1) for x in zip(*([y.copy() for y in take(terms[i : i + 500])] for i in range(0, 4000, 500)), strict=True))
    assert abs(r.mean() - 2) < 0.02 and abs(r.var() - 2) < 0.1
    assert abs(np.exp(c).mean() - 2) < 0.02 and abs(b.mean() - 0.5) < 0.005
    assert abs(np.corrcoef(r.ravel(), np.exp(c).ravel())[0, 1]) < 0.01


def test_collisions_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    shares, wanted = [], []
    for _ in range(150):
        terms = np.sort(rng.integers(1, 1 << 62, 60, dtype=np.uint64))
        one = rng.integers(1, 9, 60).astype(float)
        two = np.maximum(1, np.where(rng.random(60) < 0.5, one, rng.integers(1, 30, 60)))
        found = [weighted_sampling.samples(terms, w, (np.array([0]), np.array([60])))[0][0] for w in (one, two)]
        shares.append((found[0] == found[1]).mean())
        wanted.append(np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(shares) - np.mean(wanted)) < 0.02
    assert np.abs(np.array(shares) - wanted).max() < 5 * 0.5 / 8


def _edited(rows):
    """Plain order and edit of ``(doc_id, text)`` with distinct doc_ids."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: -r[0])
    for i, (k, t) in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)][1], len(t)
        yield k, t, t[: n - n // 3] + after[: n // 3], after


def test_edits_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in weighted_sampling.with_edits(docs).collect()}
    want = list(_edited([tuple(r) for r in docs.collect()]))
    assert len(got) == len(want)
    prints = {t: weighted_sampling._hex(weighted_sampling.of_texts(pa.array([t])))[0] for row in want for t in row[1:]}
    same = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / weighted_sampling.SIZE
    for k, own, edited, after in want:
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[own], prints[edited])
        assert r["near_edited"] == same(prints[own], prints[edited]) and r["near_next"] == same(prints[own], prints[after])
    shown = weighted_sampling.fingerprints(docs).alias("a").crossJoin(weighted_sampling.fingerprints(docs.limit(1)).alias("b"))
    for r in shown.select(F.col("a.fingerprint"), weighted_sampling.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("like"), F.col("b.fingerprint").alias("o")).collect():
        assert r["like"] == same(r["fingerprint"], r["o"])


def test_edits_of_odd_rows(spark, odd, none):
    got = weighted_sampling.with_edits(odd).collect()
    assert len(got) == odd.count() and sum(r["doc_id"] is None for r in got) == 1
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == "f" * 512  # no words
    assert by[None]["n_chars"] == 10 and by[7]["n_chars"] == 7
    assert weighted_sampling.with_edits(none).count() == 0
    alone = weighted_sampling.with_edits(odd.where("doc_id = 7")).collect()[0]
    text = "é漢\U0001f600 ▁ ü"
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256((text[:5] + text[:2]).encode()).hexdigest()


def test_many_equal_rows_keep_their_order(spark):
    rows = [(5, "same text of many rows")] * 3000 + [(4, "the next one is another"), (9, "first of all")] + [(None, "x y z")] * 500
    got = Counter(tuple(r) for r in weighted_sampling.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "edited_sha256").collect())
    sha = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()
    five, four, nine, none = "same text of many rows", "the next one is another", "first of all", "x y z"
    assert got == Counter({(9, sha(nine, five)): 1, (5, sha(five, five)): 2999, (5, sha(five, four)): 1, (4, sha(four, none)): 1, (None, sha(none, none)): 499, (None, sha(none, nine)): 1})


def _plain_tree(leaves):
    """Root, and each leaf's siblings from its own level up."""
    paths = [[] for _ in leaves]
    at, level = list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, k in enumerate(at):
            run = runs[k // 8]
            paths[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
            at[i] = k // 8
        level = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
    return level[0], paths


@pytest.mark.parametrize("sizes", [[1], [2], [8, 1], [9, 513, 64], [1300], [3] * 20])
def test_proofs_equal_a_plain_tree(spark, sizes):
    rows = [(i * 1000 + k, "s", None if i == 0 else f"l{i:02}", k, f"Text {k}") for i, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r["doc_id"]: r for r in merkle.manifest(docs).collect()}
    assert len(got) == len(rows)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {r[0]: hashlib.sha256("".join(map(field, r)).encode()).hexdigest() for r in rows}
    trees = [_plain_tree([leaf[i * 1000 + k] for k in range(n)]) for i, n in enumerate(sizes)]
    root, tops = _plain_tree([t[0] for t in trees])
    for i, n in enumerate(sizes):
        for k in range(n):
            r = got[i * 1000 + k]
            assert (r["leaf"], r["subroot"], r["root"]) == (leaf[i * 1000 + k], trees[i][0], root)
            assert [tuple(s) for s in r["proof"]] == trees[i][1][k] + tops[i]
    checked = merkle.verified(docs).collect()
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0) for r in checked)


def test_manifest_of_odd_rows(spark, odd, none):
    docs = odd.withColumn("lang", F.col("source"))
    got = merkle.verified(docs).collect()
    assert len(got) == odd.count() and len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 3
    assert all(r["verified"] for r in got)  # no capital letters to lower
    one = [r["leaf"] for r in got if r["doc_id"] == 1]
    assert len(one) == 2 and len(set(one)) == 1
    assert merkle.verified(none.withColumn("lang", F.col("source"))).count() == 0


def _plain_ranking(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(split(t)), len(split(t))) for d, t in docs]
    total, length = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, words in asked.items():
        found = []
        for d, c, n in counts:
            m = 10 + (90 * n * total) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "k"), [(8192, 10), (7, 10), (50, 3)])
def test_search_equals_a_plain_ranking(spark, monkeypatch, block, k):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    got = sorted((tuple(r) for r in lexical.ranked(docs, items, k).collect()), key=str)
    assert got == _plain_ranking([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], k)


def test_search_of_odd_rows(spark, odd, none, monkeypatch):
    items = [(1, "one TWO three, zzz"), (2, None), (3, ""), (None, "no id"), (1, "words"), (4, "漢\U0001f600 X"), (5, "--")]
    queries = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank int, doc_id string")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for size in (4 << 20, 8):  # one group of queries, and several
        monkeypatch.setattr(lexical, "QUERY_BYTES", size)
        got = sorted((tuple(r) for r in lexical.ranked(odd, queries).collect()), key=str)
        assert got == _plain_ranking(rows, items)
    assert [r[1:3] for r in got if r[0] == 1][:2] == [(1, 1), (2, 1)]  # repeated rows rank one after the other
    assert lexical.ranked(none, queries).count() == 0 and lexical.ranked(odd, queries.limit(0)).count() == 0


def test_bounds_cut_the_search(spark):
    rng = np.random.default_rng(3)
    n = 4000
    size = rng.integers(1, 6, n)
    start = np.concatenate(([0], np.cumsum(size)))
    ranks = np.concatenate([np.sort(rng.choice(12, s, replace=False)) for s in size])
    tree = lexical.Tree(start, ranks, rng.integers(1, 5, len(ranks)), rng.integers(10, 400, n), np.arange(n), np.zeros(n, bool))
    asked, weights = np.array([2, 5, 9, 11]), np.array([10, 400, 900, 1500])
    best = lexical.Best(10)
    visited = lexical.search(tree, asked, weights, best)
    score = np.zeros(n, np.int64)
    for i in range(n):
        for at in range(tree.start[i], tree.start[i + 1]):
            for a, w in zip(asked, weights, strict=True):
                if a == _rank_at(tree, i, at):
                    score[i] += lexical._gain(w, tree.tf[at], tree.m[i])
    order = np.lexsort((tree.ids, -score))[:10]
    assert best.id.tolist() == tree.ids[order].tolist() and best.score.tolist() == score[order].tolist()
    assert 0 < visited < np.isin(tree.rank, asked).sum() / 4


def _rank_at(tree, doc, at):
    hit = np.flatnonzero((tree.low <= doc) & (tree.high > doc) & (tree.depth == at - tree.start[doc]))
    return tree.rank[hit[0]]
