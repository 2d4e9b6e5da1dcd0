"""Text quality by a generalised additive model with pairwise interactions (operator 7).

Each text has a few plain measures (``MEASURES``), cut into bins at quantiles. The model adds one value
per measure, looked up by bin, and one per chosen pair of measures, looked up in a coarse grid. The
tables are learnt by cyclic boosting: round by round, each measure in turn gets a tree of three leaves
fitted to what the others leave unexplained; then, with these held, the ``PAIRS`` pairs that explain
most of the rest get trees of four leaves in the same way. Scoring is bin lookup and addition.

The model is fitted on the driver from at most ``ROWS`` labelled rows of the training folds, those with
the smallest hashes; their ids are a broadcast of that bound. All texts are measured whole, in one pass.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.textbytes import slices, span_hashes, text_buffer, word_spans
from skytrace.llm.toxicity import fold

ROWS, BINS, GRID, PAIRS = 20_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 200, 80, 0.1
FOLDS, HELD_OUT, CUT = 3, 1, 0.5
MEASURES = [
    "log words", "letters per word", "symbol share", "capital share", "digit share", "other punctuation share", "beyond ASCII share",
    "words per line", "distinct word share", "word repeats the last", "repeated line share",
]
_KIND = np.full(256, 0, np.uint8)  # 1 symbol, 2 capital, 3 digit, 4 other punctuation, 5 beyond ASCII
for _chars, _k in (("#*$%&|<>", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), ("!?.,;:-_'\"()[]{}/\\@=+~^`", 4)):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 5


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct values in each run ``first[i]:first[i + 1]``."""
    out = np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            part = np.sort(values[a:b])
            out[i] = 1 + np.count_nonzero(part[1:] != part[:-1])
    return out


def measures(texts: pa.Array) -> np.ndarray:
    """A row of ``MEASURES`` per text; zeros for a text without words."""
    data, at = text_buffer(texts)
    start, end, first = word_spans(data, at)
    n, size = np.diff(first).astype(float), np.maximum(np.diff(at), 1).astype(float)
    words = span_hashes(data, start, end, lower=False)
    kinds = _KIND[data]
    columns = [np.log1p(n)]
    lengths = np.concatenate(([0], np.cumsum(end - start)))
    some = np.maximum(n, 1)
    columns.append((lengths[first[1:]] - lengths[first[:-1]]) / some)
    for k in range(1, 6):
        where = np.flatnonzero(kinds == k)
        columns.append(np.diff(np.searchsorted(where, at)) / size)
    breaks = np.flatnonzero(data == 10)
    # a line begins at the text's begin and after every break
    begins = np.sort(np.concatenate((at[:-1][at[1:] > at[:-1]], breaks + 1)))
    begins = np.unique(begins[begins < len(data)])
    line_first = np.searchsorted(begins, at)
    # words tell a line: the sum of its words' hashes with the number of words
    line_word = np.searchsorted(start, begins)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words)))
    line_end = np.append(line_word[1:], len(start)) if len(begins) else line_word
    full = line_end > line_word
    lines = (sums[line_end] - sums[line_word])[full]
    line_first = np.concatenate(([0], np.cumsum(full)))[line_first]
    n_lines = np.maximum(np.diff(line_first), 1)
    columns.append(n / n_lines)
    columns.append(_distinct(words, first) / some)
    again = np.concatenate(([0], np.cumsum(np.concatenate(([False], words[1:] == words[:-1]))))) if len(words) else np.zeros(1)
    last = np.minimum(first[:-1] + 1, first[1:])
    columns.append((again[first[1:]] - again[last]) / some)
    columns.append(1 - _distinct(lines, line_first) / n_lines)
    out = np.stack(columns, 1)
    out[n == 0] = 0
    return out


class Model(NamedTuple):
    base: float
    edges: list[np.ndarray]  # bin borders per measure
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # grid borders per measure
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        cells = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[cells[i], cells[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best cut of the bins ``lo:hi`` in two, and what it gains."""
    if hi - lo < 2:
        return 0.0, hi
    gl, hl = np.cumsum(g[lo : hi - 1]), np.cumsum(h[lo : hi - 1])
    gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
    gains = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
    k = int(gains.argmax())
    return float(gains[k]), lo + k + 1


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of three leaves over ordered bins, as a value per bin."""
    cuts = [0, len(g)]
    for _ in range(2):
        gain, _, cut = max((*_split(g, h, a, b)[:1], a, _split(g, h, a, b)[1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        if gain <= 0:
            break
        cuts = sorted({*cuts, cut})
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _grid_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of four leaves over a grid: one cut along the better axis, then one across on either side."""
    best = None
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, cut = _split(a.sum(1), b.sum(1), 0, len(a))
        out, total = np.zeros(a.shape), 0.0
        for rows in (slice(0, cut), slice(cut, len(a))):
            x, y = a[rows].sum(0), b[rows].sum(0)
            _, across = _split(x, y, 0, len(x))
            for columns in (slice(0, across), slice(across, len(x))):
                out[rows, columns] = x[columns].sum() / (y[columns].sum() + 1.0)
                total += float(_gain(x[columns].sum(), y[columns].sum()))
        if best is None or total > best[0]:
            best = total, out.T if turn else out
    return best[1]


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Learns the tables from measures and labels 0 or 1."""
    width = x.shape[1]
    cut = lambda j, n: np.unique(np.quantile(x[:, j], np.arange(1, n) / n)) if len(x) else np.zeros(0)
    edges, coarse = [cut(j, BINS) for j in range(width)], [cut(j, GRID) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            m = len(tables[j])
            step = RATE * _leaves(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m))
            tables[j] += step
            total += step[bins[j]]
    cells = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def hist(i: int, j: int, v: np.ndarray) -> np.ndarray:
        m, n = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * n + cells[j], v, m * n).reshape(m, n)

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: -float((_grid_leaves(hist(*p, g), hist(*p, h)) * hist(*p, g)).sum()))
    pairs = ranked[:PAIRS]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for grid, (i, j) in zip(grids, pairs, strict=True):
            g, h = slopes()
            step = RATE * _grid_leaves(hist(i, j, g), hist(i, j, h))
            grid += step
            total += step[cells[i], cells[j]]
    return Model(base, edges, tables, coarse, pairs, grids)


def _measured(rows: DataFrame, keep: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = measures(part.column("text"))
                at = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(keep), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], [keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {rows.schema[keep].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` labelled rows outside the held-out fold."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("mark"))
    marks = marks.where(fold(F.col("id"), FOLDS) != HELD_OUT).orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = docs.join(F.broadcast(marks), docs.doc_id == marks.id)  # ``rows`` ids at most, each perhaps on many rows
    chosen = chosen.withColumn("key", F.struct((F.col("mark") == 1).cast("int").alias("mark"), F.xxhash64("id", "text").alias("order")))
    table = _measured(chosen, "key").orderBy("key.order", "x").limit(rows).select("key.mark", "x").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(MEASURES))
    return boost(x, table.column("mark").to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text, ...)``.

    Null and empty texts have measures of 0. A null doc_id is scored and not held out. Label rows of one
    doc_id count once, as poor if any is. Without labels every score is one half. Repeated rows are
    each returned; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(measures(part.column("text"))))], ["doc_id", "score"])

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
