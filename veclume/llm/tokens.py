"""Token ids of whole texts, by the tokenizers library, with a bounded cache of pre-tokens.

A byte-level BPE acts on each pre-token alone. A block of texts is cut into
pre-tokens by vectorised rules for the vocabulary's pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and the library's model encodes each distinct pre-token once per worker; texts that
hold an added token's string, and tokenizers with another pre-tokenizer, go
through the library whole.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from veclume.llm.textnum import U64, span_hash

#: Distinct pre-tokens kept in a worker; beyond it the cache starts anew.
CACHE_KEPT = 700_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space beyond the separators that a Unicode \s takes.
_SPACES = [*range(0x09, 0x0E), 0x85]


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_UNITS = np.array([ord(_byte_chars()[b]) for b in range(256)], "<u2")


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
        elif kind == "Z":
            table[cp] = SPACE
    table[_SPACES] = SPACE
    return table


def pretokens(text: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Begins of the pre-tokens of code points text, rows at offs; rows are never joined."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[text]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    rows = offs[:-1][offs[:-1] < n]
    begin[rows] = True
    run = np.flatnonzero(begin)
    end = np.concatenate([run[1:], [n]])
    row_end = np.zeros(n + 1, bool)
    row_end[offs[1:]] = True
    space = kind[run] == SPACE
    # of white space before other text the last character stands apart: with what follows if it is a blank
    inner = space & ~row_end[end]
    last = end[inner] - 1
    begin[last] = True
    blank = text[last] == 0x20
    begin[last[blank] + 1] = False
    # an apostrophe alone, not after a blank of the same row, before one of the endings
    quote = run[(text[run] == 0x27) & (end - run == 1)]
    quote = quote[begin[quote]]
    if quote.size:
        padded = np.concatenate([text, np.zeros(2, text.dtype)])
        limit = np.concatenate([np.flatnonzero(row_end), [n]])
        stop = limit[np.searchsorted(limit, quote + 1)]
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (quote + 1 < stop)
        two = (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & (quote + 2 < stop)
        for hit, size in ((one, 1), (two & ~one, 2)):
            at = quote[hit]
            begin[at + 1] = False
            after = at + 1 + size
            letters = after[after < n]
            letters = letters[(kind[letters] == LETTER) & ~row_end[letters]]
            begin[letters] = True
    return np.flatnonzero(begin)


class Cache:
    """Ids of pre-tokens by their 64-bit hash: a table with open addressing, filled to a half at most; 0 marks a free place."""

    def __init__(self) -> None:
        self.count, self.used = 0, 0
        self.pool = np.zeros(1 << 18, np.uint32)
        self._empty(1 << 16)

    def _empty(self, places: int) -> None:
        self.keys, self.at, self.size = np.zeros(places, U64), np.zeros(places, np.uint32), np.zeros(places, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        mask = np.int64(len(self.keys) - 1)
        keys = np.maximum(keys, U64(1))
        place = keys.astype(np.int64) & mask
        out = np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        while open_.size:
            at = place[open_]
            there = self.keys[at]
            same = there == keys[open_]
            out[open_[same]] = at[same]
            open_ = open_[~same & (there != 0)]
            place[open_] = (place[open_] + 1) & mask
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct keys that are not there, with the ids of all of them one after another."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            held = np.flatnonzero(self.keys)
            keys, at, size = np.concatenate([self.keys[held], keys]), np.concatenate([self.at[held], at]), np.concatenate([self.size[held], size])
            self._empty(1 << (4 * self.count).bit_length() - 1)
        self._put(np.maximum(keys, U64(1)), at.astype(np.uint32), size.astype(np.uint32))

    def _put(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        mask = np.int64(len(self.keys) - 1)
        place = keys.astype(np.int64) & mask
        open_ = np.arange(len(keys))
        while open_.size:
            free = open_[self.keys[place[open_]] == 0]
            self.keys[place[free]] = keys[free]  # of several for a place one stays
            won = free[self.keys[place[free]] == keys[free]]
            self.at[place[won]], self.size[place[won]] = at[won], size[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            open_ = open_[lost[open_]]
            place[open_] = (place[open_] + 1) & mask


class Encoder:
    """Ids of texts for one tokenizer file; the cache lives as long as the worker."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.fast = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.model = self.tokenizer.model
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self._reset()

    def _reset(self) -> None:
        self.cache = Cache()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's."""
        plain = [not self.fast or any(a in t for a in self.added) for t in texts]
        if any(plain):
            one_by_one = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if p else self.encode([t])[0] for t, p in zip(texts, plain, strict=True)]
            return np.concatenate([*one_by_one, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in one_by_one])]).astype(np.int64)
        joined = "".join(texts)
        raw = joined.encode("utf-8", "surrogatepass")
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        begin = pretokens(cps, offs)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        buf = np.frombuffer(raw, np.uint8)
        if len(buf) == len(cps):
            starts = begin
        else:
            starts = np.flatnonzero((buf & 0xC0) != 0x80)[begin]
        lens = np.diff(np.concatenate([starts, [len(buf)]]))
        keys = span_hash(buf, starts, lens)
        found = self.cache.find(keys)
        lost = np.flatnonzero(found < 0)
        if lost.size:
            new, where = np.unique(keys[lost], return_index=True)
            if self.cache.count + len(new) > CACHE_KEPT and self.cache.count:
                self._reset()
                new, where = np.unique(keys, return_index=True)
                lost = np.arange(len(keys))
            chars = _BYTE_UNITS[buf].tobytes().decode("utf-16-le")  # a character a byte
            at = starts[lost[where]]
            tokenize = self.model.tokenize
            ids, size = array("I"), np.zeros(len(new), np.int64)
            for k, (i, j) in enumerate(zip(at.tolist(), (at + lens[lost[where]]).tolist(), strict=True)):
                tokens = tokenize(chars[i:j])
                size[k] = len(tokens)
                ids.extend([t.id for t in tokens])
            self.cache.add(new, np.frombuffer(ids, np.uint32), size)
            found = self.cache.find(keys)  # places move when the table grows
        at, size = self.cache.at[found].astype(np.int64), self.cache.size[found].astype(np.int64)
        end = np.cumsum(size)
        ids = self.cache.pool[np.repeat(at - (end - size), size) + np.arange(end[-1])]
        first = np.searchsorted(begin, offs)
        return ids, np.concatenate([[0], end])[first]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
