"""Toxicity by class-conditional Kneser-Ney models (operator 4).

Two bigram models, of toxic and of ordinary texts, share one vocabulary and one lowest level. A
bigram's discounted count backs off to the class's continuation counts (in how many contexts a word
follows), and those to the continuation counts of both classes together, so a rare expression is
judged by how surprising it is in one class and not in the other. A text's log-likelihood ratio is
normalised by length: over the whole text, and over each run of ``SPANS`` words, of which the highest
counts. A few insults in a long text show in the short runs. All go through a logistic calibration.

Copies of a passage are no evidence: words met fewer than ``SEEN`` times or in fewer than ``CONTEXTS``
contexts are neutral, and bigrams met fewer than ``SEEN`` times, or whose first word has fewer
followers, back off.

Counts come from all labelled rows of the training folds: they grow with the input and are added up
before they are shuffled. Every word and bigram that passes the thresholds above takes part. The head is
broadcast: ``WORDS`` words by toxic and as many by total count, ``BIGRAMS`` likewise. All others stay a
table: texts are dealt into blocks, the keys a block needs are joined with that table, and the block is
read with its answers, which gives what a broadcast of everything would. Without others no text is
shuffled for it. The calibration is fitted on all rows of a fold of its own, by Newton steps whose sums
come from the tasks. Labelled texts get their marks from bit fields of fixed size; only texts whose cell there
holds documents of several kinds are shuffled and joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.llm.tasks import likely, long_keys, stored
from skytrace.llm.textbytes import mix, slices, word_hashes

WORDS, BIGRAMS = 400_000, 1_000_000  # in the broadcast head; ids have 20 bits
BUCKET = 8 << 20  # bytes of text whose words or bigrams make one bucket of counts
BLOCK = 8 << 20  # bytes of text that share their answers from the table of the others
SPANS = [1, 4, 16]
SEEN, CONTEXTS = 4, 4
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
CUT = 0.3
BITS = 26  # of the cells in the fields of labelled ids
UNKNOWN, BEGIN = 0, 1  # ids of the unknown word and the beginning of a text; words follow
OUTSIDE = np.uint64(1 << 63)  # set in the hash of a word outside the head, so its code is negative


def fold(doc_id, folds: int):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` joined with the distinct ``marks(id, mark)``, stored; most texts aren't shuffled for it.

    Ids fall into ``2 ** BITS`` cells. Where all documents of a cell have the same mark, two bit fields of the cells give
    it, or say there is none. Texts of the other cells, which a third field names, are joined by id.
    """
    shift = 64 - BITS
    cell = lambda c: F.shiftrightunsigned(F.xxhash64(c), shift)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").join(marks, F.col("doc_id") == F.col("id"), "left").select(cell("doc_id").alias("c"), "mark")
    bit = F.expr("shiftleft(1L, cast(c & 63 AS int))")
    kinds = [F.col("mark") == 0, F.col("mark") == 1, F.col("mark").isNull()]
    words = ids.groupBy(F.shiftright("c", 6).alias("w")).agg(*[F.coalesce(F.bit_or(F.when(k, bit)), F.lit(0).cast("long")).alias(f"k{i}") for i, k in enumerate(kinds)])
    words = words.where("k0 <> 0 OR k1 <> 0").toArrow()
    at, (zero, one, none) = words.column("w").to_numpy(), (words.column(f"k{i}").to_numpy() for i in range(3))
    fields = np.zeros((3, 1 << (BITS - 6)), np.int64)
    fields[:, at] = zero & ~(one | none), one & ~(zero | none), (zero | one) & ((zero & one) | none)
    shared = docs.sparkSession.sparkContext.broadcast(fields)

    def marked(batches):
        for batch in batches:
            c = batch.column("c").to_numpy()
            has = (shared.value[:, c >> 6] >> (c & 63)) & 1 == 1
            # 2: the cell doesn't tell
            mark = pa.array(np.where(has[2], 2, has[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), mark], ["doc_id", "text", "mark"]).filter(pa.array(has.any(0)))

    some = docs.where("doc_id IS NOT NULL").select("doc_id", "text", cell("doc_id").alias("c"))
    some = stored(some.mapInArrow(marked, "doc_id long, text string, mark int"), "marked", "zstd")
    rest = some.where("mark = 2").select("doc_id", "text").join(marks, F.col("doc_id") == F.col("id")).select("doc_id", "text", "mark")
    return some.where("mark < 2").unionByName(stored(rest, "labelled", "zstd"))


def _counted(texts: DataFrame) -> DataFrame:
    """``(key, toxic, ordinary)``: words by class."""

    def count(part):
        keys, first = word_hashes(part.column("text"))
        toxic = np.repeat(part.column("mark").to_numpy() == 1, np.diff(first))
        distinct, index = np.unique(keys, return_inverse=True)
        t, n = _by_class(index, toxic, len(distinct))
        return [long_keys(distinct), t, n - t]

    return _summed(texts, count, ["key"])


def _pairs(texts: DataFrame, vocabulary, others: DataFrame | None) -> DataFrame:
    """``(a, b, toxic, ordinary)``: bigrams of codes by class; ``others(w)`` are the codes of words outside the vocabulary."""
    wide = others is not None

    def count(part):
        words, first = word_hashes(part.column("text"))
        toxic = np.repeat(part.column("mark").to_numpy() == 1, np.diff(first))
        after = _codes(words, vocabulary.value, wide)
        before = _before(after, first)
        _, at, index = np.unique(_pair_keys(before, after) if wide else _bigrams(before, after), return_index=True, return_inverse=True)
        t, n = _by_class(index, toxic, len(at))
        return [before[at], after[at], t, n - t]

    found = _summed(texts, count, ["a", "b"])
    if others is None:
        return found
    for c in ("a", "b"):  # words outside the vocabulary that are too rare are the unknown word
        found = found.join(others.withColumnRenamed("w", "w" + c), F.col(c) == F.col("w" + c), "left")
        found = found.withColumn(c, F.when((F.col(c) < 0) & F.col("w" + c).isNull(), F.lit(UNKNOWN).cast("long")).otherwise(F.col(c)))
    return found.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary")])


def _summed(texts: DataFrame, count: Callable[[pa.RecordBatch], list[np.ndarray]], keys: list[str]) -> DataFrame:
    """``(*keys, toxic, ordinary)``: the sums of what ``count`` finds in runs of ``texts(text, mark)``.

    Keys are dealt into buckets by hash. A run's keys of one bucket are shuffled as one value: sorted, the first column
    as differences, byte by byte, compressed; that takes a third of what single rows do.
    """
    names = [*keys, "toxic", "ordinary"]
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = np.uint64(size // BUCKET + 1)

    def packed(batches):
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                columns = count(part)
                if not len(columns[0]):
                    continue
                bucket = (_pair_keys(columns[0], columns[1] if len(keys) > 1 else BEGIN) % buckets).astype(np.int64)
                order = np.lexsort((*columns[len(keys) - 1 :: -1], bucket))
                bucket, columns = bucket[order], [c[order] for c in columns]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                blobs = []
                for begin, end in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    own = np.stack([np.diff(columns[0][begin:end], prepend=np.int64(0)), *(c[begin:end] for c in columns[1:])])
                    blobs.append(pa.compress(own.view(np.uint8).reshape(len(own), -1, 8).transpose(0, 2, 1).tobytes(), "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), pa.array(np.diff(np.append(cuts, len(bucket)))), pa.array(blobs, pa.binary())], ["bucket", "n", "packed"]
                )

    def unpacked(n: int, blob: bytes) -> np.ndarray:
        flat = np.frombuffer(pa.decompress(blob, 8 * n * len(names), "zstd", asbytes=True), np.uint8)
        columns = flat.reshape(len(names), 8, n).transpose(0, 2, 1).copy().view(np.int64).reshape(len(names), n)
        np.cumsum(columns[0], out=columns[0])
        return columns

    def total(held: list[np.ndarray]) -> pa.RecordBatch:
        columns = np.concatenate(held, 1)
        columns = columns[:, np.lexsort(columns[len(keys) - 1 :: -1])]
        fresh = np.ones(columns.shape[1], bool)
        fresh[1:] = (columns[: len(keys), 1:] != columns[: len(keys), :-1]).any(0)
        at = np.flatnonzero(fresh)
        return pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns[: len(keys)]), *(pa.array(np.add.reduceat(c, at)) for c in columns[len(keys) :])], names)

    def merged(batches):
        held, now = [], None
        for batch in batches:
            for bucket, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield total(held)
                    held = []
                now = bucket
                held.append(unpacked(n, blob))
        if held:
            yield total(held)

    found = texts.select("text", "mark").mapInArrow(packed, "bucket long, n long, packed binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, ", ".join(f"{c} long" for c in names))


def _by_class(index: np.ndarray, toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(index, toxic, size).astype(np.int64), np.bincount(index, minlength=size)


def _ids(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(words), UNKNOWN, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at + 2, UNKNOWN)


def _codes(words: np.ndarray, vocabulary: np.ndarray, wide: bool) -> np.ndarray:
    """Ids of words; if ``wide``, words outside the vocabulary get negative codes of their own."""
    ids = _ids(words, vocabulary)
    return np.where(ids == UNKNOWN, (words | OUTSIDE).view(np.int64), ids) if wide else ids


def _before(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.concatenate(([BEGIN], ids[:-1])) if len(ids) else ids.copy()
    before[first[:-1][first[1:] > first[:-1]]] = BEGIN
    return before


def _bigrams(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ((before << 20) | ids).astype(np.uint64)


def _pair_keys(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """64-bit keys of pairs of codes; with ``BEGIN``, which follows nothing, as b: of the word a."""
    return mix(mix(a.view(np.uint64)) + np.asarray(b, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _most(counts: DataFrame, limit: int):
    """Condition for the keys with the highest toxic or the highest total counts, at most ``limit`` of either.

    The lowest count that fits comes from the number of keys per count, so no task gathers the keys
    of all others; keys that tie below it go together.
    """
    most = F.lit(False)
    for c in (F.col("toxic"), F.col("toxic") + F.col("ordinary")):
        values = counts.groupBy(c.alias("c")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(F.desc("c")))
        least = values.withColumn("upto", upto).where(F.col("upto") <= limit).agg(F.min("c")).first()[0]
        if least is not None:
            most = most | (c >= least)
    return most


class Others(NamedTuple):
    """What a block of texts needs of the words and bigrams outside the head."""

    keys: np.ndarray  # sorted, as of ``_pair_keys``
    values: np.ndarray  # of a word: its two of back and of word; of a bigram: its two of gain, and two zeros


class Model(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes; a word's id is its place + 2
    keys: np.ndarray  # sorted bigrams
    gain: np.ndarray  # (bigram, class): discounted probability
    back: np.ndarray  # (context, class): mass that backs off
    word: np.ndarray  # (word, class): continuation probability
    weights: np.ndarray  # of the calibration

    def ratios(self, words: np.ndarray, first: np.ndarray, others: Others | None = None) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        ids = _codes(words, self.vocabulary, others is not None)
        if others is not None:
            at, known = _place(others.keys, _pair_keys(ids, BEGIN))
            ids = np.where((ids < 0) & ~known, UNKNOWN, ids)
        before = _before(ids, first)
        keys = _bigrams(before, ids)
        if others is None:
            p = self.back[before] * self.word[ids]
        else:
            back, word = self.back[np.maximum(before, 0)], self.word[np.maximum(ids, 0)]
            word[ids < 0] = others.values[at[ids < 0], 2:]
            back[before < 0] = others.values[at[np.flatnonzero(before < 0) - 1], :2]
            p = back * word
            at, hit = _place(others.keys, _pair_keys(before, ids))
            p[hit] += others.values[at[hit], :2]
            keys[(before < 0) | (ids < 0)] = np.iinfo(np.uint64).max
        at, hit = _place(self.keys, keys)
        p[hit] += self.gain[at[hit]]
        return np.log(p[:, 0]) - np.log(p[:, 1])

    def needs(self, texts: pa.Array) -> np.ndarray:
        """Keys outside the head that the texts may hold, rare words as themselves and as the unknown word."""
        words, first = word_hashes(texts)
        ids = _codes(words, self.vocabulary, True)
        before = _before(ids, first)
        found = [_pair_keys(ids[ids < 0], BEGIN)]
        for a in (before, np.maximum(before, UNKNOWN)):
            for b in (ids, np.maximum(ids, UNKNOWN)):
                out = (a < 0) | (b < 0) | ~_place(self.keys, _bigrams(a, b))[1]
                found.append(_pair_keys(a[out], b[out]))
        return np.unique(np.concatenate(found))

    def features(self, texts: pa.Array, others: Others | None = None) -> np.ndarray:
        """Per text: mean ratio, and the highest mean over each of ``SPANS``; 0 for a text without words."""
        words, first = word_hashes(texts)
        n = np.diff(first)
        out = np.zeros((len(n), 1 + len(SPANS)))
        if not len(words):
            return out
        sums = np.concatenate(([0.0], np.cumsum(self.ratios(words, first, others))))
        whole = sums[first[1:]] - sums[first[:-1]]
        out[:, 0] = whole / np.maximum(n, 1)
        for k, span in enumerate(SPANS, 1):
            full = n >= span
            out[:, k] = np.where(full, 0, whole / span)
            if full.any():
                runs = np.append((sums[span:] - sums[:-span]) / span, 0.0)  # so that the last end is a valid place
                cuts = np.stack((first[:-1][full], first[1:][full] - span + 1), 1).ravel()
                out[full, k] = np.maximum.reduceat(runs, cuts)[::2]
        return out


def _design(features: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(features)), features))


def _measured(rows: DataFrame, model: Model, others: DataFrame | None) -> DataFrame:
    """``(x, f)``: the features of each row of ``rows(x, text)``, x a long."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def out(part, others=None):
        f = shared.value.features(part.column("text"), others)
        at = np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)
        return pa.RecordBatch.from_arrays([part.column("x"), pa.ListArray.from_arrays(pa.array(at), pa.array(f.ravel()))], ["x", "f"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield out(part)

    if others is None:
        return rows.select("x", "text").mapInArrow(run, "x long, f array<double>")

    def asked(batches):
        for batch in batches:
            blocks = batch.column("r").to_numpy()
            for r in np.unique(blocks):
                for part in slices(batch.filter(pa.array(blocks == r)), "text"):
                    k = shared.value.needs(part.column("text"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r)), pa.array(long_keys(k))], ["r", "k"])

    def read(batches):
        """Rows come by block, its answers first."""
        block, held, known = None, [], None
        for batch in batches:
            blocks, texts = batch.column("r").to_numpy(), batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (texts[1:] != texts[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if begin == end:
                    continue
                if blocks[begin] != block:
                    block, held, known = blocks[begin], [], None
                run = batch.slice(begin, end - begin)
                if not texts[begin]:
                    held.append(run)
                    continue
                if known is None:
                    k = np.concatenate([np.zeros(0, np.uint64), *(x.column("k").to_numpy().view(np.uint64) for x in held)])
                    v = np.concatenate([np.zeros((0, 4)), *(np.stack([x.column(c).to_numpy() for c in names], 1) for x in held)])
                    order = np.argsort(k)
                    known, held = Others(k[order], v[order]), []
                for part in slices(run, "text"):
                    yield out(part, known)

    names = ["v0", "v1", "v2", "v3"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.select("x", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("r", F.pmod(F.xxhash64("x", "text"), F.lit(size // BLOCK + 1)))
    needed = likely(rows.select("r", "text").mapInArrow(asked, "r long, k long"), "k", others.select("k"), 26).distinct()
    answers = needed.join(others, "k").select("r", "k", *names)
    both = rows.unionByName(answers, allowMissingColumns=True).repartition("r").sortWithinPartitions("r", F.col("text").isNotNull())
    return both.mapInArrow(read, "x long, f array<double>")


def _calibrated(rows: DataFrame, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression on ``rows(x, f)``, x the mark, by Newton steps; the first is the constant."""
    size = 2 + len(SPANS)

    def sums(w):
        def run(batches):
            total = np.zeros(2 + size + size * size)
            for batch in batches:
                y = batch.column("x").to_numpy().astype(float)
                x = _design(batch.column("f").flatten().to_numpy().reshape(-1, size - 1))
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total += np.concatenate(([len(y), y.sum()], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        found = pc.list_flatten(rows.mapInArrow(run, "s array<double>").toArrow().column("s")).to_numpy().reshape(-1, 2 + size + size * size)
        total = np.array([math.fsum(c) for c in found.T])
        return total[0], total[1], total[2 : 2 + size], total[2 + size :].reshape(size, size)

    w, keep = np.zeros(size), np.full(size, ridge)
    keep[0] = 1e-6
    for _ in range(30):
        n, toxic, slope, curve = sums(w)
        if not 0 < toxic < n:
            return np.array([np.log((toxic + 0.5) / (n - toxic + 0.5)), *[0.0] * (size - 1)])
        step = np.linalg.solve(curve + np.diag(keep), slope - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows outside the held-out fold; its head, if not all fits there."""
    return _fit(docs, labels)[0]


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame | None]:
    """The model's head, and the table ``(k, v0, v1, v2, v3)`` of the words and bigrams outside it, if there are any."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("mark"))
    marks = marks.withColumn("mark", (F.col("mark") == 1).cast("int")).where(fold(F.col("id"), FOLDS) != HELD_OUT)
    texts = labelled(docs, marks).withColumn("fold", fold(F.col("doc_id"), FOLDS))
    train = texts.where(F.col("fold") != CALIBRATION)
    sc = docs.sparkSession.sparkContext
    often = F.col("toxic") + F.col("ordinary") >= SEEN
    words = stored(_counted(train).where(often), "words")
    most = _most(words, WORDS)
    vocabulary = np.sort(words.where(most).select("key").toArrow().column("key").to_numpy().view(np.uint64))
    rest = words.where(~most)
    outside = None if rest.isEmpty() else rest.select(F.col("key").bitwiseOR(int(OUTSIDE.view(np.int64))).alias("w")).distinct()
    pairs = stored(_pairs(train, sc.broadcast(vocabulary), outside), "bigrams")

    size = len(vocabulary) + 2
    seen = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")]

    def dense(rows: DataFrame, columns: list[str]) -> np.ndarray:
        table = rows.where("i >= 0").toArrow()
        out = np.zeros((size, len(columns)))
        out[table.column("i").to_numpy()] = np.stack([table.column(c).to_numpy() for c in columns], 1)
        return out

    after = pairs.groupBy(F.col("b").alias("i")).agg(*seen, F.count("*").alias("both"))
    starts = pairs.groupBy(F.col("a").alias("i")).agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"), *seen)
    follows, contexts = dense(after, ["toxic", "ordinary", "both"]), dense(starts, ["t", "o", "toxic", "ordinary"])
    ones = pairs.agg(*[F.count(F.when(F.col(c) == n, 1)).alias(f"{c}{n}") for c in ("toxic", "ordinary") for n in (1, 2)]).first()
    discount = np.array([(ones[f"{c}1"] + 0.5) / (ones[f"{c}1"] + 2 * ones[f"{c}2"] + 1.0) for c in ("toxic", "ordinary")])
    both, types, lower = (follows[:, 2] + 0.5).sum(), follows[:, :2].sum(0), np.maximum(follows[:, :2] - discount, 0).sum(0)
    if outside is not None:
        after = stored(after.where("i < 0"), "follows")
        more = after.agg(
            F.sum(F.col("both") + 0.5), *[F.sum(c) for c in ("toxic", "ordinary")],
            *[F.sum(F.greatest(F.col(c) - float(d), F.lit(0.0))) for c, d in zip(("toxic", "ordinary"), discount, strict=True)],
        ).first()
        both, types, lower = both + more[0], types + np.array(more[1:3], float), lower + np.array(more[3:], float)
    lower, types = lower / np.maximum(types, 1), np.maximum(types, 1)
    shared = (follows[:, 2] + 0.5) / both
    continuation = np.maximum(follows[:, :2] - discount, 0) / types + (1 - lower) * shared[:, None]
    continuation[follows[:, 2] < CONTEXTS] = shared[follows[:, 2] < CONTEXTS, None]
    totals = contexts[:, :2]
    varied = contexts[:, 2:].sum(1) >= CONTEXTS
    back = np.where((totals > 0) & varied[:, None], discount * contexts[:, 2:] / np.maximum(totals, 1), 1.0)
    inside = (F.col("a") >= 0) & (F.col("b") >= 0)
    frequent = pairs.where(often)
    most = inside & _most(frequent.where(inside), BIGRAMS)
    kept = frequent.where(most).withColumn("key", F.shiftleft("a", 20).bitwiseOR(F.col("b"))).toArrow().sort_by("key")
    kept = kept.filter(pa.array(varied[kept.column("key").to_numpy() >> 20]))
    keys = kept.column("key").to_numpy().view(np.uint64)
    counts = np.stack([kept.column(c).to_numpy() for c in ("toxic", "ordinary")], 1)
    gain = np.maximum(counts - discount, 0) / np.maximum(totals[(keys >> np.uint64(20)).astype(np.int64)], 1)
    model = Model(vocabulary, keys, gain, back, continuation, np.zeros(2 + len(SPANS)))

    others, rest = None, frequent.where(~most)
    if outside is not None or not rest.isEmpty():
        starts = stored(starts.withColumn("varied", F.col("toxic") + F.col("ordinary") >= CONTEXTS), "contexts")
        share = lambda c, d, n: F.greatest(F.col(c) - float(d), F.lit(0.0)) / F.greatest(n, F.lit(1))
        table = rest.join(starts.where("varied").select(F.col("i").alias("a"), "t", "o"), "a").select(
            "a", "b", share("toxic", discount[0], F.col("t")).alias("v0"), share("ordinary", discount[1], F.col("o")).alias("v1"), F.lit(0.0).alias("v2"), F.lit(0.0).alias("v3")
        )
        if outside is not None:
            left = after.withColumn("shared", (F.col("both") + 0.5) / float(both)).select("i", "both", "shared", F.col("toxic").alias("f0"), F.col("ordinary").alias("f1"))
            word = left.join(starts, "i", "left").select(
                F.col("i").alias("a"), F.lit(BEGIN).cast("long").alias("b"),
                *[F.when(F.col("varied") & (F.col(n) > 0), float(d) * F.col(c) / F.col(n)).otherwise(1.0).alias(v) for c, d, n, v in zip(("toxic", "ordinary"), discount, ("t", "o"), ("v0", "v1"), strict=True)],
                *[F.when(F.col("both") < CONTEXTS, F.col("shared")).otherwise(share(f"f{k}", discount[k], F.lit(float(types[k]))) + float(1 - lower[k]) * F.col("shared")).alias(f"v{2 + k}") for k in (0, 1)],
            )
            table = table.unionByName(word)

        def keyed(batches):
            for batch in batches:
                k = _pair_keys(batch.column("a").to_numpy(), batch.column("b").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(long_keys(k)), *batch.columns[2:]], ["k", "v0", "v1", "v2", "v3"])

        others = stored(table.mapInArrow(keyed, "k long, v0 double, v1 double, v2 double, v3 double"), "others")

    marked = texts.where(F.col("fold") == CALIBRATION).select(F.col("mark").cast("long").alias("x"), "text")
    return model._replace(weights=_calibrated(stored(_measured(marked, model, others), "calibration"))), others


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text, ...)``.

    Null and empty texts have the features of no evidence (0) and the score that the calibration gives
    them. A null doc_id is scored and not held out. Label rows of one doc_id count once, as toxic if
    any is. Without labels of both classes the score rests on the prior. Repeated rows are each
    returned; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model, others = _fit(rows, labels)
    w = model.weights

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    found = _measured(rows.withColumnRenamed("doc_id", "x"), model, others)
    z = F.lit(float(w[0]))
    for k in range(1 + len(SPANS)):
        z = z + float(w[1 + k]) * F.element_at("f", k + 1)
    found = found.select(F.col("x").alias("doc_id"), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    return found.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
