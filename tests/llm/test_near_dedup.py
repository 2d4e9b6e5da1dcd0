"""Near-duplicate classes against brute force over all pairs."""

import random
import re
from itertools import combinations

import pyarrow as pa
import pytest

from skytrace.llm import components as module
from skytrace.llm import near_dedup, tasks
from skytrace.llm.components import components


def brute(rows, width, percent):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None], 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(d, len(s), find(d)) for d, s in sets if d is not None}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(9999)}"
        yield " ".join(copy)


@pytest.mark.parametrize(("leaf", "depth"), [(128, 6), (4, 6), (4, 1)])
def test_brute_force(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)  # small nodes force branching, pivots and blocks
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    rng = random.Random(3)
    texts = [*family(rng, 40, 60, 3), *family(rng, 25, 80, 6), *family(rng, 6, 30, 1), *["same text of five words"] * 9]
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)] + ["Aa bb", "aA BB", None, "", "one"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert sorted((r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] == 1) == [(1, 2), (1, 2)]
    assert {r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert near_dedup.near_duplicates(none).count() == 0


def test_ids_with_several_texts(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (3, "v w x y z"), (4, "other words are here now")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_one_of_each(odd, none):
    got = near_dedup.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert near_dedup.one_of_each(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(20, 60)]}


def template(rng, n, pairs):
    """Texts of which any two share some 0.83 of their shingles, and a near copy of some of them."""
    shared = [f"t{rng.randrange(500)}" for _ in range(110)]
    texts = [" ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(11)]) for _ in range(n)]
    return texts + [t.replace(t.split()[-1], "other") for t in texts[:pairs]]


@pytest.mark.parametrize("others", [0, 2])
def test_linked_pairs_in_a_template(spark, monkeypatch, others):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "OTHERS", others)
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    rng = random.Random(5)
    texts = [*template(rng, 120, 40), *family(rng, 9, 60, 3)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85)


def test_few_texts_reach_the_join(spark):
    rows = spark.range(20_000).selectExpr("id - 9000 as doc", "cast(id as string) as text").unionByName(spark.sql("select null as doc, 'x' as text"))
    ids = spark.createDataFrame([(i,) for i in (-9000, -1, 0, 3, 3, 10_999)], "id long")
    got = tasks.likely(rows, "doc", ids)
    found = {r["doc"] for r in got.collect()}
    assert {-9000, -1, 0, 3, 10_999} <= found and len(found) < 20 and got.columns == rows.columns
    assert tasks.likely(rows, "doc", ids.limit(0)).count() == 0


@pytest.mark.parametrize(("links", "stored"), [([(1, 9), (9, 3), (4, 1)], 2), ([(5, 2), (7, 2), (8, 6)], 1)])
def test_components_end_with_the_first_stars(spark, monkeypatch, links, stored):
    seen = []
    monkeypatch.setattr(module, "stored", lambda df, label: seen.append(label) or tasks.stored(df, label))
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == ({1: 1, 3: 1, 4: 1, 9: 1} if stored == 2 else {2: 2, 5: 2, 7: 2, 6: 6, 8: 6}) and len(seen) == stored


def test_small_steps_run_in_few_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = tasks.stored(spark.range(4000).selectExpr("id % 500 AS k", "id AS v"), "rows")
        limit = tasks.task_limit(rows)
        summed = tasks.stored(rows.groupBy("k").sum("v"), "summed", tasks=5)
        work = lambda table, bounds: pa.RecordBatch.from_arrays([pa.array(bounds[1:] - bounds[:-1])], ["n"])
        sizes = tasks.map_groups(rows, "k", work, "n long", 5)
        assert limit >= 4 * spark.sparkContext.defaultParallelism and len(summed.inputFiles()) <= 5 and summed.count() == 500
        assert sizes.rdd.getNumPartitions() == 5 and [r.n for r in sizes.collect()] == [8] * 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_open_node_of_a_few_leaves_ends_at_once(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 64)
    monkeypatch.setattr(near_dedup, "OTHERS", 0)
    branched = []
    monkeypatch.setattr(near_dedup, "_branch", lambda rows, percent, f=near_dedup._branch: branched.append(1) or f(rows, percent))
    rows = list(enumerate(template(random.Random(8), 120, 40)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85) and not branched


def test_rows_of_an_open_node_and_of_a_linked_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    monkeypatch.setattr(near_dedup, "OTHERS", 0)
    made = []
    f = near_dedup._candidates

    def counted(groups, *rest):
        got = f(groups, *rest)
        made.append((groups.count(), got.count()))
        return got

    monkeypatch.setattr(near_dedup, "_candidates", counted)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    texts = [*family(rng, 55, 80, 2), *template(rng, 55, 12)]
    texts += [" ".join(passage + [f"s{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85)
    # a node's member is a row of a group, not of each pair of blocks, and goes on to one subgroup at most
    assert max(max(x) for x in made) <= 6 * len(rows)


@pytest.mark.parametrize("volume", [60, 400])
def test_subgroups_of_many_shingles(spark, monkeypatch, volume):
    monkeypatch.setattr(near_dedup, "VOLUME", volume)
    rng = random.Random(4)
    rows = list(enumerate([*family(rng, 30, 60, 5), *template(rng, 20, 6), "short text here", ""]))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85)
