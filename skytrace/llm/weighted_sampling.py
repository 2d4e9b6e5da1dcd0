"""Fingerprints by consistent weighted sampling (operator 11).

A text is the bag of its adjacent word pairs, the ends of the text counting as words of their own;
A-Z is lower-cased and a pair weighs its number of occurrences. For each of ``SIZE`` samples every pair
draws ``r`` and ``c`` from Gamma(2, 1) and ``b`` from [0, 1), all fixed by the pair and the sample number.
A pair of weight ``w`` gets ``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t + 1 - b)``; the sample is
the ``(pair, t)`` with the smallest ``a``. Two bags agree in a sample with probability
``sum(min(w1, w2)) / sum(max(w1, w2))``, so the share of equal samples estimates generalised Jaccard.

``with_edits`` compares each text with an edited one, which needs the next text in descending doc_id. Rows are dealt
into ranges of that order, whose bounds are keys of sampled rows. The first row of each range also goes, as a
marked row, to the end of the range before it. So each text is shuffled once, and no range needs another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.textbytes import mix, slices, word_hashes
from skytrace.session import shuffle_partitions

SIZE = 64  # samples of a fingerprint, 32 bits each
PER_RANGE = 64  # sampled keys for each range's bounds
_BLOCK = 1024
_EDGE = np.uint64(0x2545F4914F6CDD1D)
_LAST = (1 << 63) - 1
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Gamma(2, 1) at the middles of ``2 ** bits`` equal parts of probability: ``1 - (1 + x) exp(-x)`` inverted on a fine grid."""
    x = np.concatenate((np.geomspace(1e-6, 1e-2, 20_000), np.linspace(0.01, 25, 500_000)[1:]))
    below = np.where(x < 1e-3, x * x / 2 - x**3 / 3, 1 - (1 + x) * np.exp(-x))
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), below, x)


_LOG_GAMMA = np.log(_gamma_quantiles(16)).astype(np.float32)


def pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every adjacent pair of words, ends included, and the index of each text's first (one more at the end)."""
    words, first = word_hashes(texts)
    n = np.diff(first)
    full = n > 0
    left = np.insert(words, first[:-1][full], _EDGE)
    right = np.insert(words, first[1:][full], _EDGE)
    return mix(left * np.uint64(3) + mix(right + np.uint64(1))), np.concatenate(([0], np.cumsum(n + full)))


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each text with their counts: index of the text, pair, weight."""
    found, first = pairs(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    if not len(found):
        return text, found, np.zeros(0, np.int64)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    at = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (text[1:] != text[:-1]))))
    return text[at], found[at], np.diff(np.append(at, len(found)))


class Draws:
    """``r``, ``ln c`` and ``b`` of each sample (rows) and term (columns), in arrays that the next call overwrites."""

    def __init__(self):
        self.words = np.empty((3, SIZE, _BLOCK), np.uint64)
        self.numbers = np.empty((3, SIZE, _BLOCK), np.float32)

    def __call__(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(terms)
        word, part, other = (w.reshape(-1)[: SIZE * n].reshape(SIZE, n) for w in self.words)
        r, c, b = (x.reshape(-1)[: SIZE * n].reshape(SIZE, n) for x in self.numbers)
        np.multiply(terms[None, :], _FACTORS[:, None], out=word)
        for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
            word ^= np.right_shift(word, np.uint64(shift), out=part)
            word *= np.uint64(factor)
        # r: -ln of the product of two uniforms of 24 bits is Gamma(2, 1)
        np.bitwise_or(np.right_shift(word, np.uint64(40), out=part), np.uint64(1), out=part)
        np.bitwise_or(np.bitwise_and(word, np.uint64(0xFFFFFF), out=other), np.uint64(1), out=other)
        part *= other
        np.copyto(r, part.view(np.int64), casting="unsafe")
        r *= np.float32(2.0**-48)
        np.negative(np.log(r, out=r), out=r)
        # c: by quantile of the 16 bits between; b: 16 bits of a further product
        np.bitwise_and(np.right_shift(word, np.uint64(24), out=part), np.uint64(0xFFFF), out=part)
        np.take(_LOG_GAMMA, part.view(np.int64), out=c, mode="clip")
        word *= np.uint64(0x94D049BB133111EB)
        np.copyto(b, np.right_shift(word, np.uint64(48), out=part).view(np.int64), casting="unsafe")
        b *= np.float32(2.0**-16)
        return r, c, b


def samples(terms: np.ndarray, weights: np.ndarray, *bags: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each ``(begin, end)`` the samples of the bags ``terms[begin[i]:end[i]]``, a row each; bounds ascend.

    A bag without terms has all ones.
    """
    best = [np.full((len(begin), SIZE), np.inf, np.float32) for begin, _ in bags]
    term = [np.zeros((len(begin), SIZE), np.uint64) for begin, _ in bags]
    time = [np.zeros((len(begin), SIZE), np.int64) for begin, _ in bags]
    line, draws = np.arange(SIZE), Draws()
    log_weight = np.log(weights).astype(np.float32)
    for at in range(0, len(terms), _BLOCK):
        to = min(at + _BLOCK, len(terms))
        r, c, b = draws(terms[at:to])
        several = np.flatnonzero(weights[at:to] != 1)  # t is 0 for the others
        t = np.floor(log_weight[at:to][several] / r[:, several] + b[:, several])
        times = np.full(to - at, -1)
        times[several] = np.arange(len(several))
        b -= np.float32(1)
        b[:, several] -= t
        b *= r
        c += b
        for k, (begin, end) in enumerate(bags):
            for i in range(int(np.searchsorted(end, at, "right")), int(np.searchsorted(begin, to, "left"))):
                low, high = max(int(begin[i]), at) - at, min(int(end[i]), to) - at
                if low >= high:
                    continue
                j = c[:, low:high].argmin(1)
                j += low
                value = c[line, j]
                better = np.flatnonzero(value < best[k][i])
                j = j[better]
                best[k][i, better], term[k][i, better] = value[better], terms[at + j]
                time[k][i, better] = np.where(times[j] < 0, 0, t[better, times[j]]) if len(several) else 0
    out = []
    for (begin, end), x, y in zip(bags, term, time, strict=True):
        found = (mix(x + y.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        found[begin >= end] = np.iinfo(np.uint32).max
        out.append(found)
    return out


def _starts(text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


def of_texts(texts: pa.Array) -> np.ndarray:
    """Samples of each text, a row each."""
    text, term, weight = bags(texts)
    at = _starts(text, len(texts))
    return samples(term, weight, (at[:-1], at[1:]))[0]


def of_texts_and_edits(texts: list[str], edited: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each text and of its edited form. A pair that weighs the same in both is drawn once."""
    both = [bags(pa.array(x, pa.large_string())) for x in (texts, edited)]
    text, term, weight = (np.concatenate(x) for x in zip(*both, strict=True))
    side = np.repeat([0, 2], [len(x[0]) for x in both])  # 0: text alone, 1: both, 2: edited form alone
    order = np.lexsort((side, weight, term, text))
    text, term, weight, side = text[order], term[order], weight[order], side[order]
    again = np.zeros(len(text), bool)
    again[1:] = (text[1:] == text[:-1]) & (term[1:] == term[:-1]) & (weight[1:] == weight[:-1])
    side[np.flatnonzero(again) - 1] = 1
    text, term, weight, side = text[~again], term[~again], weight[~again], side[~again]
    order = np.lexsort((side, text))
    text, term, weight, side = text[order], term[order], weight[order], side[order]
    n = len(texts)
    count = np.bincount(text * 3 + side, minlength=3 * n).reshape(n, 3)
    first = _starts(text, n)[:-1]
    return tuple(samples(term, weight, (first, first + count[:, 0] + count[:, 1]), (first + count[:, 0], first + count.sum(1))))


def _hex(rows: np.ndarray) -> list[str]:
    return [x.astype(">u4").tobytes().hex() for x in rows]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` per row of ``docs(doc_id, text, ...)``.

    ``n_chars`` counts code points. Equal texts have equal fingerprints, also null and empty ones; texts without a
    word share the fingerprint ``ff...``. Null doc_ids and repeated rows stay, other columns are ignored, an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _hex(of_texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_chars"), pa.array(found, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def likeness(one: Column, other: Column) -> Column:
    """Share of equal samples of two fingerprints, 0 to 1."""
    parts = [F.regexp_extract_all(x, F.lit("(.{8})"), F.lit(1)) for x in (one, other)]
    same = F.filter(F.zip_with(*parts, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.lit(float(SIZE))


def _ranges(rows: DataFrame) -> list[tuple[int, int]]:
    """Keys of rows at which the ranges begin, ascending; the first is the least of all. A frequent key may come twice.

    At most ``PER_RANGE`` sampled keys a range come to the driver.
    """
    spark, keys = rows.sparkSession, rows.select("o", "h")
    least = keys.agg(F.min(F.struct("o", "h")).alias("k"), F.count("*").alias("n")).first()
    if not least["n"]:
        return []
    ranges = shuffle_partitions(spark)
    share = min(1.0, PER_RANGE * ranges / least["n"])
    found = sorted((r["o"], r["h"]) for r in keys.sample(share, seed=11).collect())
    step = max(1.0, len(found) / ranges)
    inner = [found[int(k * step)] for k in range(1, ranges) if int(k * step) < len(found)]
    return [tuple(least["k"]), *(x for x in inner if x > tuple(least["k"]))]


def _dealt(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of their range.

    Rows whose key is the bound of several ranges are alike and dealt over these; each task sends its first one
    to the last of them, where later keys follow it.
    """
    o, h = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        met: dict[tuple[int, int], int] = {}
        for x, y in parts:
            x, y = x.to_numpy(), y.to_numpy()
            low, high = np.searchsorted(o, x, "left"), np.searchsorted(o, x, "right")
            out = high - 1
            for i in np.flatnonzero(low < high):  # rows whose doc_id is a bound's
                a, b = (low[i] + np.searchsorted(h[low[i] : high[i]], y[i], s) for s in ("left", "right"))
                out[i] = b - 1
                if b - a > 1:
                    seen = met.get((x[i], y[i]), 0)
                    met[x[i], y[i]] = seen + 1
                    out[i] -= seen % (b - a)
            yield pd.Series(out.astype(np.int32))

    return rows.withColumn("range", place("o", "h"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited form and of the next text.

    Per row of ``docs(doc_id, text, ...)``: ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``. The edited form has the last ``floor(n_chars / 3)`` code points replaced by the first
    as many of the next text in descending doc_id, or all of it; after the last comes the first. Null doc_ids come
    last; rows with equal doc_id follow each other by a hash of the text. Null text is empty; a single row is its own
    next; repeated rows, empty texts and any length are taken as they are; other columns are ignored; an empty
    table gives an empty result.
    """
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        doc_id.alias("doc_id"), text.alias("text"),
        F.coalesce(F.bitwise_not(doc_id), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("h"),
    )
    bounds = _ranges(rows)
    if not bounds:
        return spark.createDataFrame([], out)
    dealt = _dealt(rows, bounds).withColumn("mark", F.lit(0))
    after = [(*bounds[(k + 1) % len(bounds)], k, 1) for k in range(len(bounds))]
    marks = spark.createDataFrame(after, "o long, h long, range int, mark int")  # one row a range
    firsts = rows.join(F.broadcast(marks.select("o", "h").distinct()), ["o", "h"]).groupBy("o", "h").agg(
        F.max("doc_id").alias("doc_id"), F.max("text").alias("text")
    )
    firsts = firsts.join(F.broadcast(marks), ["o", "h"]).select(dealt.columns)
    whole = dealt.unionByName(firsts).repartitionById(len(bounds), F.col("range")).sortWithinPartitions("mark", "o", "h")

    def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
        n = [len(x) for x in texts[:-1]]
        edited = [x[: k - k // 3] + y[: k // 3] for x, y, k in zip(texts, texts[1:], n, strict=False)]
        own, new = of_texts_and_edits(texts, [*edited, ""])
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        near = [pa.array((own[:-1] == x).mean(1)) for x in (new[:-1], own[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(_hex(own[:-1]), pa.string()), pa.array(_hex(new[:-1]), pa.string()), *near],
            [x.split()[0] for x in out.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []  # the last row so far, which waits for its next; in the end the mark
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = ids[-1:] + part.column("doc_id").to_pylist(), texts[-1:] + part.column("text").to_pylist()
                if len(ids) > 1:
                    yield compared(ids, texts)

    return whole.select("doc_id", "text").mapInArrow(run, out)
