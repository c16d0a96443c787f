"""Vectorised word, hash and shingle helpers over UTF-8 byte buffers.

Every helper works on a block: the concatenated UTF-8 bytes of some rows and
their offsets. Blocks are cut to a few MB, so that memory does not grow with
the Arrow batch; a single longer text forms a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Arrow's own pools keep freed pages; workers give them back.
pa.set_memory_pool(pa.system_memory_pool())
BLOCK_BYTES = 1 << 19

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
#: Words longer than this are hashed by blake2b instead of eight bytes a step.
_LONG_WORD = 256


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def word_table(alnum: bool) -> np.ndarray:
    """True for bytes of a word: digits, letters and non-ASCII, or all but ASCII white space."""
    table = np.ones(256, dtype=bool)
    if alnum:
        table[:128] = False
        table[ord("0") : ord("9") + 1] = True
        table[ord("a") : ord("z") + 1] = True
        table[ord("A") : ord("Z") + 1] = True
    else:
        table[0x20] = False
        table[0x09:0x0E] = False
    return table


LOWER = lower_table()
SAME = np.arange(256, dtype=np.uint8)
ALNUM_WORDS = word_table(True)
SPACED_WORDS = word_table(False)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``block_bytes``."""
    buf, offs = text_buffer(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + block_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def span_hash(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:start+len] for each span, eight bytes a step."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return windows[at].view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]

    h = mix((lens.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) ^ load(starts, lens))
    live, k = np.flatnonzero((lens > 8) & (lens <= _LONG_WORD)), 8
    while live.size:
        h[live] = mix(h[live] * U64(0xD6E8FEB86659FD93) ^ load(starts[live] + k, lens[live] - k))
        k += 8
        live = live[lens[live] > k]
    for i in np.flatnonzero(lens > _LONG_WORD):
        span = codes[starts[i] : starts[i] + lens[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Words of a block: byte spans, row of each, and first word of each row (n rows + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    codes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hash(self.codes, self.starts, self.ends - self.starts)


def words_of(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    inside = is_word[buf]
    n = len(buf)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offs[:-1][offs[:-1] < n]
        begins[cut] = inside[cut]
        cut = cut[cut > 0]
        ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(starts, stops, row, first, fold[buf])


_GRAM = mix(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, rows not regarded; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    s = np.zeros(n, U64)
    for j in range(k):
        s += h[j : j + n] * _GRAM[j % 64] + U64(j // 64)
    return mix(s)


def row_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each row; fewer words give one shingle, none gives none."""
    h = words.hashes()
    g = grams(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif b > a:
            whole = np.zeros(1, U64)
            for j in range(b - a):
                whole += h[a + j : a + j + 1] * _GRAM[j] + U64((b - a) << 8)
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, U64))
    return out


def row_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i+1]]; empty rows give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]
