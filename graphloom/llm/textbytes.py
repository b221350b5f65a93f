"""Vectorised scans over the UTF-8 bytes of an Arrow string column.

The word rules used here only separate ASCII characters, so they can be
decided byte by byte: every byte of a multi-byte character is 0x80 or more.
Each scan covers whole texts; rows are sliced, and sums of one long text held for
a block at a time, only to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes or values whose running sums are held at once
BLOCK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Bytes of [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and what is not ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Words:
    """Words of some texts. ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of the column end to end, and where each begins; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``SLICE_BYTES`` of text, one row at least."""
    _, off = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def pieces(raw: np.ndarray, is_word: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that cover a text and cut no word; a longer word is in one range."""
    at = 0
    while at < len(raw):
        to = min(at + size, len(raw))
        while to < len(raw) and is_word[raw[to]]:
            gap = np.flatnonzero(~is_word[raw[to : to + size]])
            to = to + int(gap[0]) if len(gap) else min(to + size, len(raw))
        yield at, to
        at = to


def find_words(column: pa.Array, is_word: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Maximal runs of word bytes in each text, after mapping bytes by ``fold``."""
    return words_of(*text_bytes(column), is_word, fold)


def words_of(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """``find_words`` of texts end to end that begin at ``off``."""
    data = fold[raw]
    mask = is_word[data]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[inner] = False
    after[inner - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(size, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of ``data``: equal spans, equal hashes.

    ``start`` and ``end`` ascend. Sums are held for ``BLOCK`` bytes at a time.
    """
    power, inverse = _powers(BLOCK + 1)
    (from_start, unshift), (from_end, _) = (_powered_before(data, at, power, inverse) for at in (start, end))
    return mix((from_end - from_start) * unshift + (end - start).astype(np.uint64))


def _powered_before(data: np.ndarray, at: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position p of the ascending ``at``: the sum of (byte + 1) * base ** i over all i before p, and base ** -p."""
    sums, unshift = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    done, up, down = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
    for b in range(0, len(data) + 1, BLOCK):
        lo, hi = np.searchsorted(at, (b, b + BLOCK))
        part = data[b : b + BLOCK]
        local = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64, out=local[1:])
        here = at[lo:hi] - b
        sums[lo:hi], unshift[lo:hi] = done + up * local[here], down * inverse[here]
        done, up, down = done + up * local[-1:], up * power[BLOCK], down * inverse[BLOCK]
    return sums, unshift


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; the last k - 1 positions are padded and not meaningful."""
    padded = np.concatenate([hashes, np.zeros(k - 1, np.uint64)]) if k > 1 else hashes
    out = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + padded[j : j + len(hashes)]
    return mix(out)


def sums_before(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values[:p]`` for each p of the ascending ``at``; running sums are held for a block at a time."""
    out, done = np.zeros(len(at), np.int64), 0
    for b in range(0, len(values) + 1, BLOCK):
        lo, hi = np.searchsorted(at, (b, b + BLOCK))
        local = np.concatenate([np.zeros(1, np.int64), np.cumsum(values[b : b + BLOCK], dtype=np.int64)])
        out[lo:hi] = done + local[at[lo:hi] - b]
        done += int(local[-1])
    return out


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[d]:first[d + 1]]`` for each d."""
    return np.diff(sums_before(values, first))
