"""SentencePiece encoding and decoding (operator 6): shared-prefix Viterbi.

Texts are marked (a space becomes U+2581, one is put in front) and cut where a piece can't cross: at a
mark after another character, and at characters that occur in no piece. The distinct marked words of a
block of rows are sorted, which lists the nodes of their trie in depth-first order: a word keeps the
forward states of the prefix it shares with the word before it and computes only the rest.

A forward state is the best last piece of the prefix. For a unigram model that is the piece with the
highest sum of scores. A BPE model has no sums: its segmentation is the one that the merges give, and
two pieces may stand side by side in it if and only if merging the two alone leaves them as they are.
Transitions that this rules out score minus infinity; exactly one path remains for every prefix, and
it is the library's own result. Candidates for the last piece come from an automaton over all pieces.

Pieces travel as a broadcast, whose size is the model's vocabulary. Nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid
from array import array
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.textbytes import slices

MARK = "▁"
KNOWN = 150_000  # words of a generation; the last two are kept between blocks of a task
PAIRS = 500_000  # pairs of pieces remembered in a task
BLOCK = 1 << 20  # bytes of text whose words are held at a time


class Model(NamedTuple):
    kind: str  # "bpe" or "unigram"
    pieces: list[str]
    scores: list[float]
    types: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    prefix: bool


def read_model(path: str) -> Model:
    """Pieces of a model file that neither rewrites characters nor drops white space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    norm, kinds = proto.normalizer_spec, {1: "unigram", 2: "bpe"}
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("the model normalises texts; only identity models are supported")
    if proto.trainer_spec.model_type not in kinds or any(p.type in (4, 5) for p in proto.pieces):
        raise ValueError("only BPE and unigram models without user-defined or unused pieces are supported")
    return Model(kinds[proto.trainer_spec.model_type], [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], norm.add_dummy_prefix)


class Coder:
    """A model made ready for a task. Ids from ``len(pieces)`` on stand for single unknown characters."""

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.pieces)
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == 1}
        self.rank = {p: -model.scores[i] for p, i in self.ids.items()}
        self.unknown = next((i for i, t in enumerate(model.types) if t == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == 6}
        raw = {1: lambda p: p.replace(MARK, " ").encode(), 2: lambda _: " ⁇ ".encode(), 3: lambda _: b"", 6: lambda p: bytes([int(p[3:5], 16)])}
        self.raw = [raw[t](p) for p, t in zip(model.pieces, model.types, strict=True)]
        self.alphabet = inside = {c for p in self.ids for c in p}
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        cut = "" if "\n" in inside else "\n"
        self.split = re.compile(r"(?s).+" if crossing else f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}" if cut else ""))
        self.least = min((s for s, t in zip(model.scores, model.types, strict=True) if t == 1), default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.length = list(map(len, model.pieces))
        self._automaton()

    def _automaton(self) -> None:
        """Trie of the pieces with failure links; ``ends[n]`` has (id, length) of pieces that end there, longest first."""
        self.next: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        for p, i in self.ids.items():
            n = 0
            for c in p:
                if c not in self.next[n]:
                    self.next[n][c] = len(self.next)
                    self.next.append({})
                    own.append(-1)
                n = self.next[n][c]
            if self.model.kind == "unigram" or self._merged(p) == [p]:
                own[n] = i
        self.fail = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        level = [(n, 1) for n in self.next[0].values()]
        for n, _ in level:
            self.ends[n] = ((own[n], 1),) if own[n] >= 0 else ()
        while level:
            below = []
            for n, depth in level:
                for c, child in list(self.next[n].items()):
                    f = self.fail[n]
                    while f and c not in self.next[f]:
                        f = self.fail[f]
                    f = self.next[f].get(c, 0)
                    self.fail[child] = f
                    self.ends[child] = (((own[child], depth + 1),) if own[child] >= 0 else ()) + self.ends[f]
                    below.append((child, depth + 1))
            level = below
        self.longer = [e[:-1] if e and e[-1][1] == 1 else e for e in self.ends]
        self.single = [e[-1][0] if e and e[-1][1] == 1 else -1 for e in self.ends]

    def _text(self, piece: int) -> str:
        return self.model.pieces[piece] if piece < self.size else chr(piece - self.size)

    def _stable(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces ends with these two."""
        left, right = self._text(a), self._text(b)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 21 | b] = self._merged(left + right) == [left, right]
        return known

    def _walk(self, words: list[str]):
        """Ids of each of the sorted distinct ``words``, as bytes. Element d of each list below belongs to the prefix of d characters."""
        node, last, score = [0], [-1], [0.0]
        before, unigram = "", self.model.kind == "unigram"
        go, ends, longer, single, pairs, scores = self.next, self.ends, self.longer, self.single, self.pairs, self.model.scores
        length, limit = self.length, self.size
        for word in words:
            d = 0
            for x, y in zip(before, word):  # noqa: B905  the shorter ends it
                if x != y:
                    break
                d += 1
            before = word
            del node[d + 1 :], last[d + 1 :], score[d + 1 :]
            n = node[d]
            for at, c in enumerate(word[d:], d + 1):
                n = go[n].get(c)
                if n is None:
                    n = self._go(node[-1], c)
                node.append(n)
                if unigram:
                    best, top = limit + ord(c), -np.inf
                    for i, k in ends[n]:
                        if (s := score[at - k] + scores[i]) > top:
                            best, top = i, s
                    if single[n] < 0 and (s := score[at - 1] + self.least) > top:
                        best, top = limit + ord(c), s
                    score.append(top)
                else:
                    for i, k in longer[n]:
                        if k == at:
                            best = i
                            break
                        ok = pairs.get(last[at - k] << 21 | i)
                        if ok or (ok is None and self._stable(last[at - k], i)):
                            best = i
                            break
                    else:  # one character is what remains when no longer piece fits
                        best = single[n] if single[n] >= 0 else limit + ord(c)
                last.append(best)
            at, path = len(word), []
            while at:
                path.append(best := last[at])
                at -= length[best] if best < limit else 1
            path.reverse()
            yield array("i", path if max(path) < limit else self._final(path)).tobytes()

    def _go(self, n: int, c: str) -> int:
        """The automaton's next state, remembered at the state it is asked of."""
        m = n
        while m and c not in self.next[m]:
            m = self.fail[m]
        m = self.next[m].get(c, 0)
        if c in self.alphabet:
            self.next[n][c] = m
        return m

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored neighbours first, the leftmost of equals."""
        parts, rank, never = list(text), self.rank.get, np.inf
        ranks = [rank(x + y, never) for x, y in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], never)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], never)
        return parts

    def _final(self, path: list[int]):
        """Pieces as ids; unknown characters as bytes if the model has them."""
        for i in path:
            if i < self.size:
                yield i
            elif self.bytes:
                yield from (self.bytes[b] for b in chr(i - self.size).encode("utf-8", "surrogatepass"))
            else:
                yield self.unknown

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = self.split.findall
        lead = MARK if self.model.prefix else ""
        marked = [split(lead + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in set(chain.from_iterable(marked)).difference(known):
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        new.sort()
        known.update(zip(new, self._walk(new), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in marked]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; byte pieces that don't form a character become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_READY: dict[str, Coder] = {}


def _coder(name: str, shared) -> Coder:
    """The model of this name, made ready once per worker."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Coder(shared.value)
    return _READY[name]


def encoded(docs: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``ids``, ``n_ids`` and the ``text`` decoded from the ids.

    A null or empty text has no ids and decodes to the empty text; its own mark characters decode to
    spaces. Rows are independent, repeated rows alike; columns not kept don't matter, also not by
    name; an empty table gives an empty result.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(read_model(model_path)), uuid.uuid4().hex
    row = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        coder = _coder(name, shared)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                ids = coder.encode(part.column("text").to_pylist())
                counts = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(counts), pa.array([coder.decode(x.tolist()) for x in ids], pa.string())],
                    ["row", "ids", "n_ids", "text"],
                )

    kind = row.schema["row"].dataType.simpleString()
    out = row.mapInArrow(run, f"row {kind}, ids array<int>, n_ids long, text string")
    return out.select("row.*", "ids", "n_ids", "text")
