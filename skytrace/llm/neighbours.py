"""Approximate nearest neighbours by cross-polytope hashing (operator 3).

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs and a Hadamard
transform) and named after the signed axis they come nearest to. With ``n`` vectors, a bucket is a
combination of as many axes as leave about ``BUCKET`` vectors in it; the last rotation keeps only some
coordinates. Each of ``TABLES`` tables has its own rotations. A query probes a table's buckets in the
order of its coordinates there, the likeliest first.

How many buckets are probed is fitted: for a bounded sample of ``SAMPLE`` queries the true neighbours
are found in one pass over all vectors, and the smallest number of probes that reaches ``TARGET`` of
them is taken. Every vector is indexed, all candidates are reranked by exact distance.

Buckets are cut into blocks of ``BLOCK`` rows and queries go to every block of the buckets they
probe. Candidates are compared where they lie: a task emits each query's ``k`` best of a block, so
pairs are never listed. Equal vectors are one entry with their ``k + 1`` smallest ids, found in two steps
so that no task gathers all copies of one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.llm.tasks import fixed_bytes, map_groups, stored, to_binary

TABLES, BUCKET, BLOCK = 4, 512, 2048
SAMPLE, TARGET = 200, 0.96


class Hasher:
    """``TABLES`` hashes into ``buckets`` buckets each; ``probes`` gives a query's buckets in order."""

    def __init__(self, dim: int, n: int, seed: int = 5):
        self.dim, self.wide = dim, 1 << max(1, math.ceil(math.log2(max(2, dim))))
        bits = max(0, math.ceil(math.log2(max(1, n / BUCKET))))  # buckets wanted, as a power of two
        full = int(math.log2(2 * self.wide))
        self.parts = [full] * (bits // full) + ([bits % full] if bits % full else [])
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (TABLES, max(1, len(self.parts)), 3, self.wide))

    def _rotated(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        y = np.zeros((len(x), self.wide))
        y[:, : self.dim] = x
        for s in self.signs[table, part]:
            y *= s
            h = 1
            while h < self.wide:
                y = y.reshape(len(x), -1, 2, h)
                y = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), 2).reshape(len(x), self.wide)
                h *= 2
            y /= math.sqrt(self.wide)
        return y

    def _scores(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """Nearness to each signed axis; the last part keeps fewer axes."""
        y = self._rotated(x, table, part)[:, : max(1, (1 << self.parts[part]) // 2)]
        return np.concatenate((y, -y), 1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for part, bits in enumerate(self.parts):
            out = (out << bits) | self._scores(x, table, part).argmax(1)
        return out

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """For each vector the ``most`` buckets with the smallest sum of losses against the nearest axes."""
        names, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for part, bits in enumerate(self.parts):
            s = self._scores(x, table, part)
            s = s.max(1, keepdims=True) - s
            both = (loss[:, :, None] + s[:, None, :] ** 2).reshape(len(x), -1)
            name = ((names << bits)[:, :, None] | np.arange(1 << bits)[None, None, :]).reshape(len(x), -1)
            order = np.argsort(both, 1, kind="stable")[:, :most]
            names, loss = np.take_along_axis(name, order, 1), np.take_along_axis(both, order, 1)
        return names

    @property
    def count(self) -> int:
        return 1 << sum(self.parts)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # very small and very large components
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences, which is exact also for close vectors."""
    out = np.empty((len(q), len(x)))
    for i, v in enumerate(q):
        d = x - v
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each query's ``k`` best by score, then id, no id twice."""
    order = np.lexsort((ids, score, query))
    q = query[order]
    first = np.concatenate(([True], (q[1:] != q[:-1]) | (ids[order][1:] != ids[order][:-1])))
    order = order[first]
    q = query[order]
    begin = np.concatenate(([True], q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0))
    return order[rank < k]


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found, the nearest first.

    ``queries`` is a condition on ``vectors(vec_id, embedding, ...)``; candidates are all rows but the
    query's own id. score is the Euclidean distance in double precision, ties go to the smaller
    vec_id. Rows with a null id, and vectors that are null, empty, zero or hold a null or non-finite component, take no
    part; nor do vectors of another length than the most common one. Rows that share an id and a vector count once. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    )
    schema = "query_id long, rank int, vec_id long, score double"
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]

    def packed(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), to_binary(flat.reshape(-1, dim) + 0.0)], ["vec_id", "v"])

    rows = stored(good.where(F.size("x") == dim).mapInArrow(packed, "vec_id long, v binary"), "vectors")
    # equal vectors: the smallest ids by (vector, salt), then by vector
    key = F.xxhash64("v")
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(W.partitionBy(key, "v", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    some = some.withColumn("r", F.row_number().over(W.partitionBy(key, "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = stored(some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = stored(rows.where(F.expr(queries)).distinct().select(F.col("vec_id").alias("query_id"), "v"), "queries")
    n = entries.count()
    hasher = Hasher(dim, n)

    def found(part: np.ndarray, batch_ids, q: np.ndarray, query_ids: np.ndarray):
        """Each query's best among the entries, as (query, id, score) arrays."""
        counts = np.array([len(i) for i in batch_ids])
        flat = np.concatenate([np.asarray(i, np.int64) for i in batch_ids])
        entry = np.repeat(np.arange(len(part)), counts)
        out = []
        for at in range(0, len(q), 64):
            d = _distances(q[at : at + 64], part)
            m = min(k + 1, len(part))
            limit = np.partition(d, m - 1, 1)[:, m - 1 : m]
            i, j = np.nonzero(d[:, entry] <= limit)
            own = flat[j] != query_ids[at + i]
            i, j = i[own], j[own]
            query, score = query_ids[at + i], d[i, entry[j]]
            keep = _best(query, flat[j], score, k)
            out.append((query[keep], flat[j][keep], score[keep]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def batch_of(cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    result = "query_id long, vec_id long, score double"
    probes = hasher.count
    if probes > 1:
        sample = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).toArrow()
        sq, sid = fixed_bytes(sample.column("v"), 8 * dim).view(np.float64), sample.column("query_id").to_numpy()

        def truth(batches):
            for batch in batches:
                if batch.num_rows:
                    v = fixed_bytes(batch.column("v"), 8 * dim).view(np.float64)
                    yield batch_of(found(v, [np.array(i) for i in batch.column("ids").to_pylist()], sq, sid))

        if len(sid):
            true = _top(entries.mapInArrow(truth, result), k).join(rows.withColumnRenamed("vec_id", "i"), F.col("vec_id") == F.col("i")).select("query_id", "v").toArrow()
            where = {int(q): i for i, q in enumerate(sid)}
            of = np.array([where[q] for q in true.column("query_id").to_pylist()], np.int64)
            tv = _unit(fixed_bytes(true.column("v"), 8 * dim).view(np.float64))
            needed = np.full(len(of), hasher.count)
            most = min(hasher.count, 4096)
            for t in range(TABLES):
                order = hasher.probes(_unit(sq), t, most)
                hit = order[of] == hasher.buckets(tv, t)[:, None]
                needed = np.minimum(needed, np.where(hit.any(1), hit.argmax(1) + 1, hasher.count))
            probes = int(np.quantile(needed, TARGET, method="higher")) if len(of) else 1

    def indexed(batches):
        for batch in batches:
            if batch.num_rows:
                u = _unit(fixed_bytes(batch.column("v"), 8 * dim).view(np.float64))
                b = np.stack([hasher.buckets(u, t) * TABLES + t for t in range(TABLES)], 1)
                at = np.arange(0, b.size + 1, TABLES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(b.ravel())), batch.column("ids"), batch.column("v")], ["b", "ids", "v"])

    def probed(batches):
        for batch in batches:
            if batch.num_rows:
                u = _unit(fixed_bytes(batch.column("v"), 8 * dim).view(np.float64))
                b = np.concatenate([hasher.probes(u, t, probes) * TABLES + t for t in range(TABLES)], 1)
                at = np.arange(0, b.size + 1, b.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(b.ravel())), batch.column("query_id"), batch.column("v")], ["b", "query_id", "v"])

    if probes >= hasher.count:  # everything is a candidate: one table, one bucket, still in blocks
        index = entries.select(F.lit(0).cast("long").alias("bucket"), "ids", "v")
        wanted = asked.select(F.lit(0).cast("long").alias("bucket"), "query_id", "v")
    else:
        index = entries.mapInArrow(indexed, "b array<long>, ids array<long>, v binary").select(F.explode("b").alias("bucket"), "ids", "v")
        wanted = asked.mapInArrow(probed, "b array<long>, query_id long, v binary").select(F.explode("b").alias("bucket"), "query_id", "v")
    index, wanted = stored(index, "index"), stored(wanted, "wanted")
    sizes = index.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    wanted = wanted.join(sizes, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.pmod(F.xxhash64("v"), F.col("blocks"))
    index = index.join(sizes, "bucket").select(F.xxhash64("bucket", block).alias("g"), F.lit(None).cast("long").alias("query_id"), "ids", "v")
    wanted = wanted.select(F.xxhash64("bucket", "block").alias("g"), "query_id", F.lit(None).cast("array<long>").alias("ids"), "v")

    def compared(table: pa.Table, bounds: np.ndarray):
        query = table.column("query_id").to_pandas().to_numpy(np.float64)
        ids = table.column("ids").to_pylist()
        v = fixed_bytes(table.column("v"), 8 * dim).view(np.float64)
        exact = table.column("query_id").fill_null(0).to_numpy()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            asks = a + np.flatnonzero(~np.isnan(query[a:b]))
            has = a + np.flatnonzero(np.isnan(query[a:b]))
            if len(asks) and len(has):
                out.append(found(v[has], [ids[i] for i in has], v[asks], exact[asks]))
        return batch_of([np.concatenate(c) for c in zip(*out, strict=True)]) if out else None

    pairs = map_groups(wanted.unionByName(index), "g", compared, result).distinct()
    return _top(pairs, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
