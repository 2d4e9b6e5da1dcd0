"""Word arithmetic on the byte buffers of Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D; A-Z is lower-cased. Everything is numpy over
a whole batch; intermediate arrays are cut into blocks, so one very long text costs a few bytes of
memory per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text, one row at least."""
    _, at = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def word_spans(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the index of the first word of each text (one more at the end).

    ``breaks`` says for each byte value whether it ends a word.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~breaks[data]
    full = at[:-1][at[1:] > at[:-1]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[full] = inside[full]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > at[:-1]] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWER, _INVERSE = _powers(int(_PRIME)), _powers(pow(int(_PRIME), -1, 1 << 64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and don't overlap.

    Polynomials modulo 2**64 over prefixes of a block; a span's own is a difference of two.
    """
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        b, e = start[i:j] - start[i], end[i:j] - start[i]
        total, scale = 0, 1
        for k in range(0, int(e[-1]), BLOCK):  # more than once only for a single span over a block
            part = data[start[i] + k : start[i] + min(k + BLOCK, int(e[-1]))]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], out=sums[1:])
            if j > i + 1 or e[-1] <= BLOCK:
                out[i:j] = (sums[e] - sums[b]) * _INVERSE[b]
            else:
                total = (total + int(sums[-1]) * scale) % (1 << 64)
                scale = scale * int(_POWER[BLOCK]) % (1 << 64)
                out[i] = total
        i = j
    return mix(out + (end - start).astype(np.uint64))


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of the first word of each text (one more at the end)."""
    data, at = text_buffer(texts)
    start, end, first = word_spans(data, at)
    return span_hashes(data, start, end), first


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by its first word; runs over the ends of texts included."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    total, scale = np.zeros(len(words) - width + 1, np.uint64), int(_PRIME)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * np.uint64(scale)
        scale = scale * int(_PRIME) % (1 << 64)
    return mix(total + np.uint64(width))


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; of a shorter text, the whole as one."""
    windows = window_hashes(words, width)
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - begin >= width:
            found = np.sort(windows[begin : end - width + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        else:
            yield window_hashes(words[begin:end], end - begin) if end > begin else words[:0]
