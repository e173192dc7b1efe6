"""Vectorised word and shingle hashing on Arrow string columns.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``.  All work is done on the
UTF-8 bytes of a batch, a few MB at a time, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 1 << 18
SHINGLE = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INV, n)
        return self.up, self.down


_POWERS = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain string array; null becomes the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes: first row, end row, bytes, offsets."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offset of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~space[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    full = off[:-1][off[:-1] < off[1:]]
    before[full] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[full[1:] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, heads: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each byte span (ascending, disjoint).

    With ``heads`` there is a further row for each length: the hash of the span's first
    so many bytes.
    """
    out = np.empty((1 + len(heads), len(starts)), dtype=np.uint64)
    table = _BYTE[_FOLD] if fold else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = _POWERS.to(int(hi - lo) + 1)
        total = np.empty(hi - lo + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        for row, end in zip(out, (e, *(np.minimum(e, s + h) for h in heads)), strict=True):
            row[i:j] = (total[end] - total[s]) * down[s] + (end - s).astype(np.uint64) * _STEP[0]
        i = j
    out = mix64(out)
    return out if heads else out[0]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` word hashes; shorter than the input by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 12:
        total = words[:n] * _STEP[1]
        for t in range(1, k):
            total += words[t : t + n] * _STEP[t + 1]
        return mix64(total)
    up, down = _powers(_BASE, len(words) + 1), _powers(_INV, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[:n])


def shingle_sets(column: pa.Array, fold: bool = True, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    With fewer than k words the whole sequence is the one shingle; without words
    the set is empty.
    """
    for _, _, data, off in chunks(column):
        starts, ends, rows = word_bounds(data, off)
        words = span_hashes(data, starts, ends, fold)
        grams = gram_hashes(words, k)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= k:
                h = np.sort(grams[a : b - k + 1])
                yield h[np.concatenate(([True], h[1:] != h[:-1]))]
            elif b > a:
                yield mix64((words[a:b] * _STEP[1 : b - a + 1]).sum(keepdims=True) + np.uint64(b - a) * _STEP[60])
            else:
                yield np.zeros(0, np.uint64)
