"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import zstandard

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    tests = {}
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        if w:
            for j in range(max(1, len(w) - window + 1)):
                tests.setdefault(tuple(w[j : j + window]), set()).add(str(item))
    sizes = {len(k) for k in tests}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text or ""))
        hit, met = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if k := tests.get(tuple(w[i : i + n])):
                    met |= k
                    hit.update(range(i, i + n))
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text: str | None) -> set:
    w = SPACED.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(docs: list[tuple], percent: int = 80) -> list[tuple]:
    sets = {d: shingles(t) for d, t in docs}
    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for own in by.values() for i, a in enumerate(own) for b in own[:i]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, len(s), find(d)) for d, s in sets.items()]


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def found(text: str | None) -> list[list[tuple]]:
    """(start, kind, end) of the matches of each base kind."""
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [a, b, c]


def spans(text: str | None) -> str:
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(sum(found(text), [])))


def secrets(docs: list[tuple]) -> list[tuple]:
    return [(doc, *map(len, found(text)), hashlib.sha256(spans(text).encode()).hexdigest()) for doc, text in docs]


def quality(docs: list[tuple]) -> list[tuple]:
    out = []
    for doc, text in docs:
        text = text or ""
        w = SPACED.findall(text)
        seen: dict = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        again = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    return out


def kept(text: str | None, bands) -> bool:
    """The verdict of the compression bands, chunk by chunk."""
    raw = (text or "").encode()
    if quality([(0, text)])[0][-1]:
        return False
    ratio = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)

    def limits(n: int) -> tuple[float, float]:
        k = math.floor(2 * math.log2(n)) - 14
        return (0.0, math.inf) if k < 0 else (bands.low[min(k, len(bands.low) - 1)], bands.high[min(k, len(bands.high) - 1)])

    low, high = limits(len(raw))
    full, rest = [raw[k : k + 4096] for k in range(0, len(raw) - 4095, 4096)], raw[len(raw) // 4096 * 4096 :]
    odd = [not bands.chunk_low <= ratio(b) <= bands.chunk_high for b in full]
    if full and len(rest) >= 128:
        odd.append(not limits(len(rest))[0] <= ratio(rest) <= limits(len(rest))[1])
    return low <= ratio(raw) <= high and 10 * sum(odd) <= len(odd) and not any(a and b for a, b in zip(odd, odd[1:]))


def crc_of_ids(ids: list[int]) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
