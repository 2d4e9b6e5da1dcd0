"""Ranked lexical search with document FP-trees and branch-and-bound (operator 13).

Documents are reduced to the terms that the queries hold. A task reads them in blocks and makes each block an
FP-tree: every document's terms in descending order of document frequency are a path, and documents share the
nodes of common prefixes. A node knows the largest term frequency of its term and the smallest length value
``m`` among the documents below it, so ``w * f(tf, m)`` of these bounds what the term adds to any of them.

For one query only the nodes of its terms count (``_project``). From the leaves upwards each gets the best sum that
it and nodes below can add; the depth-first search then takes the most promising child first, leaves out a subtree
whose bound is under the k-th best score so far, and scores the documents at visited nodes exactly. The k best are
kept over all blocks of a task, so later blocks are cut earlier.

Queries come in groups of about ``QUERY_BYTES`` of text, each with one pass over the documents; a group's terms
are what tasks receive. Tasks return at most k rows a query; these meet in two steps, by query and hash first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytrace.llm.tasks import stored
from skytrace.llm.textbytes import slices, span_hashes, text_buffer, word_spans

QUERY_BYTES = 4 << 20
BLOCK_DOCS, BLOCK_TERMS = 8192, 1_000_000  # of one tree
SPREAD = 32  # parts of a query's rows in the first merge
_BREAKS = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _BREAKS[_low:_high] = False


def terms(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte count of every term, and the index of each text's first (one more at the end)."""
    data, at = text_buffer(texts)
    start, end, first = word_spans(data, at, _BREAKS)
    return span_hashes(data, start, end), end - start, first


def vectors(docs: DataFrame, vocabulary: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, tf)``: all terms of a document, and its counts of those of the sorted ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, size, first = terms(part.column("text"))
                at = np.minimum(np.searchsorted(vocabulary, found), max(len(vocabulary) - 1, 0))
                hit = np.flatnonzero((vocabulary[at] == found) & (sizes[at] == size)) if len(vocabulary) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, hit, "right") - 1
                keys, tf = np.unique(doc * max(len(vocabulary), 1) + at[hit], return_counts=True)
                bounds = np.searchsorted(keys, np.arange(part.num_rows + 1) * max(len(vocabulary), 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (keys % max(len(vocabulary), 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Tree:
    """The FP-tree of a block. ``ranks[start[i]:start[i + 1]]`` are document ``i``'s terms, ascending; 0 is the most frequent."""

    def __init__(self, start: np.ndarray, ranks: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, null: np.ndarray):
        # documents in the order of their paths, so that a node's documents are consecutive
        big = ranks.astype(">u4")
        keys = [big[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        size = np.diff(start)[order]
        self.start = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(start[:-1][order] - self.start[:-1], size) + np.arange(len(ranks))
        ranks, self.tf, self.m, self.ids, self.null = ranks[take], tf[take], m[order], ids[order], null[order]
        rank, depth, low, high = (np.zeros(len(ranks), np.int64) for _ in range(4))
        most, least = np.zeros(len(ranks), np.int64), np.full(len(ranks), np.iinfo(np.int64).max)
        path = np.zeros(int(size.max(initial=0)), np.int64)  # the nodes of the document before
        nodes, length = 0, 0
        for i in range(len(order)):
            a, b = self.start[i], self.start[i + 1]
            own = ranks[a:b]
            near = min(length, b - a)
            differ = np.flatnonzero(own[:near] != ranks[a - length : a - length + near]) if near else own[:0]
            shared = int(differ[0]) if len(differ) else near
            high[path[shared:length]] = i
            new = np.arange(nodes, nodes + b - a - shared)
            path[shared : b - a] = new
            rank[new], low[new], depth[new] = own[shared:], i, np.arange(shared, b - a)
            nodes, length = nodes + len(new), b - a
            on = path[:length]
            most[on] = np.maximum(most[on], self.tf[a:b])
            least[on] = np.minimum(least[on], self.m[i])
        high[path[:length]] = len(order)
        by_rank = np.argsort(rank[:nodes], kind="stable")
        self.depth, self.low, self.high, self.most, self.least = (x[:nodes][by_rank] for x in (depth, low, high, most, least))
        self.rank = rank[:nodes][by_rank]


def _gain(weight, tf, m):
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Best:
    """The ``k`` best documents of a query so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must score to come in, or to tie."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least
        if keep.any():
            score, null, ids = (np.concatenate(x) for x in ((self.score, score[keep]), (self.null, null[keep]), (self.id, ids[keep])))
            order = np.lexsort((ids, null, -score))[: self.k]
            self.score, self.null, self.id = score[order], null[order], ids[order]


def search(tree: Tree, ranks: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds a block's documents to ``best`` for the query with terms ``ranks`` (ascending); returns the nodes visited."""
    # the nodes of the query's terms; deeper ones have higher ranks, so parents come first
    begin, end = np.searchsorted(tree.rank, ranks, "left"), np.searchsorted(tree.rank, ranks, "right")
    cover = np.full(len(tree.ids), -1)  # a document's deepest node so far
    nodes, parents, gains = [], [], []
    count = 0
    for a, b, weight in zip(begin, end, weights, strict=True):
        if a == b:
            continue
        parents.append(cover[tree.low[a:b]])
        nodes.append(np.arange(a, b))
        gains.append(_gain(weight, tree.most[a:b], tree.least[a:b]))
        width = tree.high[a:b] - tree.low[a:b]
        inside = np.repeat(tree.low[a:b] - np.cumsum(width) + width, width) + np.arange(width.sum())
        cover[inside] = np.repeat(np.arange(count, count + b - a), width)
        count += b - a
    if not count:
        return 0
    weight_of = np.repeat([w for a, b, w in zip(begin, end, weights, strict=True) if a < b], [len(x) for x in nodes])
    below = np.zeros(count, np.int64)  # the most that nodes under each can add
    at = count
    for p, g in zip(reversed(parents), reversed(gains), strict=True):
        at -= len(g)
        np.maximum.at(below, p[p >= 0], (g + below[at : at + len(g)])[p >= 0])
    node, parent, gain = (np.concatenate(x) for x in (nodes, parents, gains))
    bound = gain + below  # of a subtree, without what is above
    by_parent = np.lexsort((bound, parent))
    child = np.searchsorted(parent[by_parent], np.arange(-1, count + 1))
    by_cover = np.argsort(cover, kind="stable")
    docs = np.searchsorted(cover[by_cover], np.arange(count + 1))
    visited = 0
    stack = [(int(bound[v]), int(v), 0) for v in by_parent[child[0] : child[1]]]
    while stack:
        most, v, above = stack.pop()
        if most < best.least:
            continue
        visited += 1
        upto = above + int(gain[v])
        here = by_cover[docs[v] : docs[v + 1]]
        if len(here) and upto >= best.least:
            score, u = np.zeros(len(here), np.int64), v
            while u >= 0:
                score += _gain(weight_of[u], tree.tf[tree.start[here] + tree.depth[node[u]]], tree.m[here])
                u = parent[u]
            best.add(score, tree.null[here], tree.ids[here])
        for c in by_parent[child[v + 1] : child[v + 2]]:
            if upto + bound[c] >= best.least:
                stack.append((upto + int(bound[c]), int(c), upto))
    return visited


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, size = [], 0, 0
    for batch in batches:
        counts = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = int(counts[begin - 1]) if begin else 0
            end = min(batch.num_rows, begin + BLOCK_DOCS - docs, max(begin + 1, int(np.searchsorted(counts, done + BLOCK_TERMS - size, "right"))))
            held.append(batch.slice(begin, end - begin))
            docs, size, begin = docs + end - begin, size + int(counts[end - 1]) - done, end
            if docs >= BLOCK_DOCS or size >= BLOCK_TERMS:
                yield pa.Table.from_batches(held)
                held, docs, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a list column."""
    lists = column.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), lists.flatten().to_numpy().astype(np.int64)


def _found(rows: DataFrame, queries: list[tuple], rank: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """Each task's best documents of each query ``(item_id, ranks, weights)``: ``(item_id, doc_id, score)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for block in _blocks(batches):
            start, term = _flat(block.column("terms"))
            _, tf = _flat(block.column("tf"))
            ids = block.column("doc_id").combine_chunks()
            doc = np.repeat(np.arange(len(ids)), np.diff(start))
            order = np.lexsort((rank[term], doc))
            m = 10 + (90 * block.column("n").to_numpy() * total) // length
            tree = Tree(start, rank[term][order], tf[order], m, pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False))
            for (_, ranks, weights), b in zip(queries, best, strict=True):
                search(tree, ranks, weights, b)
        for (item, _, _), b in zip(queries, best, strict=True):
            if len(b.id):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(b.id), pa.int64()), pa.array(b.id, mask=b.null), pa.array(b.score)], ["item_id", "doc_id", "score"]
                )

    return rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tf").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each item: ``(item_id, rank, doc_id, score)``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. A term counts once in
    an item; rows with the same item_id are one item, null included. Ties go to the smaller doc_id, null last; each
    of several rows with one doc_id ranks on its own. Null, empty or termless texts match nothing; long texts are
    taken whole; other columns are ignored; an empty table on either side gives an empty result.
    """
    out = "item_id long, rank int, doc_id long, score long"
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // QUERY_BYTES)
    found = []
    for g in range(groups):
        # about QUERY_BYTES of queries; what they are searched in stays distributed
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow()
        hashes, sizes, first = terms(part.column("text"))
        vocabulary, at = np.unique(hashes, return_index=True)
        rows = stored(vectors(docs, vocabulary, sizes[at]), "vectors")
        total, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total or not len(vocabulary):
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a query term
            df[r[0]] = r[1]
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((vocabulary, -df))] = np.arange(len(df))
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        own: dict = {}
        for i, item in enumerate(part.column("item_id").to_pylist()):
            own.setdefault(item, []).append(np.searchsorted(vocabulary, hashes[first[i] : first[i + 1]]))
        queries = []
        for item, lists in own.items():
            mine = np.unique(np.concatenate(lists))
            mine = mine[np.argsort(rank[mine])]
            queries.append((item, rank[mine], weight[mine]))
        found.append(_found(rows, queries, rank, total, length, k))
    if not found:
        return spark.createDataFrame([], out)
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    hits = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    for by in (["item_id", "part"], ["item_id"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return hits.select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS row FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sums AS (SELECT count(*) FILTER (len(ws) > 0) AS total, sum(len(ws))::BIGINT AS length FROM words),
held AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM words) JOIN (SELECT DISTINCT term FROM asked) USING (term) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, sums GROUP BY term, total),
scores AS (SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * total) // length))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN words USING (row), sums GROUP BY item_id, row)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores JOIN words USING (row) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
