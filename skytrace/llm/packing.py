"""Token rows for training (operator 8): best-fit-decreasing packing and binary output.

Texts become byte-level BPE ids, each text closed by ``END``. A text longer than a row is split into
full rows and a remainder, nothing is cut off. Remainders are placed from long to short, each into the
open row whose free room is the smallest that still fits. Rows are found by a segment tree over
capacities: a leaf holds the rows with exactly that much room, an inner node says whether any is
below, so a search takes log2(length) steps whatever the number of rows.

A task packs what it reads, in blocks of ``BLOCK`` tokens: memory is bounded, nothing is shuffled,
and a task that runs again gives the same rows.
"""

from __future__ import annotations

import base64
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.tasks import long_keys, to_binary
from skytrace.llm.textbytes import mix, slices

LENGTH, BLOCK, END = 2048, 4 << 20, 50256


class Capacities:
    """Open rows by free room, 0 to ``length``; finds the smallest room of at least ``n``."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.some = [False] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.width + room
        while i and not self.some[i]:
            self.some[i] = True
            i //= 2

    def take(self, n: int) -> tuple[int, int] | None:
        """Removes and returns ``(room, row)`` of the best fit for ``n``, or None."""
        i = self.width + n
        if not self.some[i]:
            # up to the first ancestor with something to the right, then down its left edge
            while i > 1 and (i % 2 or not self.some[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[i] = False
            i //= 2
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = False
                i //= 2
        return room, row


def best_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers, by best fit from long to short (equal ones in order)."""
    rooms, rows = Capacities(length), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = rooms.take(n)
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(k)
        if room > n:
            rooms.put(room - n, row)
    return rows


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


_READY: dict[str, object] = {}


def encoder(name: str, shared):
    """The tokenizer of a broadcast ``(ranks, pattern)`` of this name, built once per worker."""
    if name not in _READY:
        import tiktoken

        _READY.clear()
        ranks, pattern = shared.value
        _READY[name] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _READY[name]


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], length: int) -> pa.RecordBatch:
    """Rows from pieces ``(doc_id, part, ids)``."""
    rows = best_fit(np.array([len(p[2]) for p in pieces], np.int64), length)
    ids, spots = np.full((len(rows), length), END, np.uint16), np.zeros((len(rows), length), np.uint16)
    docs, parts, ends, names = [], [], [], []
    for r, row in enumerate(rows):
        at, cuts = 0, [0]
        for k in row:
            piece = pieces[k][2]
            ids[r, at : at + len(piece)] = piece
            spots[r, at : at + len(piece)] = np.arange(len(piece))
            at += len(piece)
            cuts.append(at)
        docs.append([pieces[k][0] for k in row])
        parts.append([pieces[k][1] for k in row])
        ends.append(cuts)
        names.append((docs[-1][0] or 0, parts[-1][0]))
    doc, part = (np.array([n[i] for n in names], np.int64).view(np.uint64) for i in (0, 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(long_keys(mix(mix(doc) + part))), pa.array([c[-1] for c in ends], pa.int32()), pa.array(docs, pa.list_(pa.int64())),
            pa.array(parts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), to_binary(ids), to_binary(spots),
        ],
        ["pack_id", "n_tokens", "doc_ids", "parts", "cu_seqlens", "ids", "positions"],
    )


SCHEMA = "pack_id long, n_tokens int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, ids binary, positions binary"


def packed(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """Rows of ``length`` ids from ``docs(doc_id, text, ...)``.

    ``ids`` and ``positions`` are little-endian 16-bit values; ids past ``n_tokens`` are ``END``, positions
    restart with each segment. Segment k of a row covers ``cu_seqlens[k]`` to ``cu_seqlens[k + 1]`` and
    is part ``parts[k]`` of document ``doc_ids[k]``. pack_id is the hash of the first segment's
    doc_id (null as 0) and part. A null or empty text is one ``END``. Repeated rows are packed each;
    other columns are ignored; an empty table gives an empty result.
    """
    if not 2 <= length <= 1 << 16:
        raise ValueError("rows have 2 to 65536 tokens")
    shared, name = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern)), uuid.uuid4().hex
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        encode = encoder(name, shared).encode_ordinary
        held: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text), END], np.uint16)
                    held.extend((doc, k, ids[k * length : (k + 1) * length]) for k in range(-(-len(ids) // length)))
                    tokens += len(ids)
                    if tokens >= BLOCK:
                        yield from pa.Table.from_batches([_packed(held, length)]).to_batches(1000)
                        held, tokens = [], 0
        if held:
            yield from pa.Table.from_batches([_packed(held, length)]).to_batches(1000)

    return rows.mapInArrow(run, SCHEMA)


def unpacked(rows: DataFrame) -> DataFrame:
    """``(doc_id, part, ids)`` of each segment of packed rows: the way back."""

    def run(batches):
        for batch in batches:
            out = []
            for docs, parts, cuts, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "parts", "cu_seqlens", "ids")), strict=True):
                flat = np.frombuffer(ids, np.uint16)
                out += [(d, p, flat[a:b].tolist()) for d, p, a, b in zip(docs, parts, cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int32()))],
                ["doc_id", "part", "ids"],
            )

    return rows.select("doc_ids", "parts", "cu_seqlens", "ids").mapInArrow(run, "doc_id long, part int, ids array<int>")


def write_packed(docs: DataFrame, path: str, ranks_path: str, pattern: str, length: int = LENGTH) -> None:
    """The rows as Parquet files at ``path``, a binary id row and a position row each."""
    packed(docs, ranks_path, pattern, length).write.parquet(path)
