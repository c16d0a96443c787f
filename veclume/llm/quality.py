"""Quality rules with compression bands.

Base: words between ASCII white space, characters in words, symbols, repeated
lines and words in repeated 8-word windows. A document fails the base with
fewer than 20 words, or if over 30 % of its words lie in repeated windows.

Method: the zstandard ratio (compressed bytes / bytes, level 3) of the whole
text must lie within limits for its length, and so must its chunks: full ones of
4096 bytes within the chunk limits, what follows them, from 128 bytes on, within
the limits for its length. Over a tenth of the chunks outside, or two in a row,
reject the text, however long it is. Lower ratios mean repetitive text, higher
ones incompressible text. Ratios fall with length, so limits are given by half
octaves of the length in bytes. ``fit_bands`` takes them from all documents that
are labelled good: outside of their extremes by ``MARGIN`` and of their mean by
``SPREAD`` standard deviations. Half octaves with few such documents take their
limits from those beside them; without labels the limits are those of ``Bands``.
Texts under 128 bytes are not judged by ratio.

The query compresses every text once and stores the ratios; limits come from an
aggregate of them by half octave, and the verdicts from a pass over them.

Null text is empty text: no words, base failed. Ratios of texts without bytes
are 1. Rows keep their multiplicity; extra columns are ignored by ``measure``.
Null labels, and labels or documents without an id, are not used to fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.llm.arrow import over_arrow
from veclume.llm.scratch import Scratch
from veclume.llm.textnum import SAME, SPACED_WORDS, blocks, grams, row_sum, words_of

LEVEL = 3
CHUNK = 4096
WINDOW = 8
LEAST_TAIL = 128
#: Of its chunks a text may have this share outside, but not two in a row.
ODD_SHARE = 0.1
SYMBOLS = b"#*$%&|<>"
#: Least number of documents labelled good in a half octave, and of ratios for chunks.
LEAST_FIT = 30
MARGIN, SPREAD = 0.01, 4.0


def half_octave(size: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(size, 1))).astype(int)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by half octave (2 log2 of the bytes, rounded down), from ``first`` on; the last holds beyond."""

    first: int = 14
    low: tuple[float, ...] = (0.48, 0.48, 0.48, 0.49, 0.505, 0.488, 0.479, 0.459, 0.451, 0.444, 0.432, 0.422, 0.413, 0.409, 0.404, 0.398, 0.391, 0.388, 0.38, 0.376, 0.372, 0.36, 0.35, 0.33)
    high: tuple[float, ...] = (1.0, 0.93, 0.86, 0.8, 0.75, 0.71, 0.66, 0.62, 0.6, 0.58, 0.57, 0.56, 0.55, 0.54, 0.53, 0.52, 0.51, 0.505, 0.5, 0.495, 0.49, 0.485, 0.48, 0.475)
    chunk_low: float = 0.435
    chunk_high: float = 0.57

    def limits(self, size: int) -> tuple[float, float]:
        k = int(half_octave(size)) - self.first
        if k < 0:
            return 0.0, float("inf")
        return self.low[min(k, len(self.low) - 1)], self.high[min(k, len(self.high) - 1)]

    def odd(self, ratios: list[float], tail: float | None, tail_size: int) -> list[bool]:
        """Which chunks lie outside: the full ones, and the tail unless it is too short to judge (or the whole text)."""
        out = [not self.chunk_low <= p <= self.chunk_high for p in ratios]
        if ratios and tail is not None and tail_size >= LEAST_TAIL:
            low, high = self.limits(tail_size)
            out.append(not low <= tail <= high)
        return out


_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_words(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each row the number of words inside windows of its text that occur there twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    g = grams(h, window)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = b - a - window + 1
        if n < 2:
            continue
        own = g[a : a + n]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(b - a + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            out[r] = int((np.cumsum(edge[:-1]) > 0).sum())
    return out


def too_odd(odd: list[bool]) -> bool:
    return sum(odd) > ODD_SHARE * len(odd) or any(a and b for a, b in zip(odd, odd[1:], strict=False))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double"
#: ``parts`` are the ratios of the full chunks, ``tail`` of what follows them, if it is judged.
RATIOS = f"{BASE}, base_failed boolean, octave long, parts array<double>, tail double"
SCHEMA = f"{BASE}, chunks long, chunks_out long, chunk_low double, chunk_high double, base_failed boolean, kept boolean"
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _weigh(id_col: str) -> Run:
    """From (id, text) to the columns of RATIOS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)

        def ratio(part: memoryview) -> float:
            return len(pack.compress(part)) / len(part) if len(part) else 1.0

        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                words = words_of(buf, offs, SPACED_WORDS, SAME)
                n_words = words.counts
                chars = row_sum(SPACED_WORDS[buf] & ~_CONTINUES[buf], offs)
                symbols = row_sum(_SYMBOL[buf], offs)
                again = repeated_words(words.hashes(), words.first)
                raw, whole = memoryview(buf), buf.tobytes()
                lines, ratios, parts, tails = [], [], [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    lines.append(repeated_lines(whole[a:b]))
                    ratios.append(ratio(raw[a:b]))
                    parts.append([ratio(raw[k : k + CHUNK]) for k in range(a, b - CHUNK + 1, CHUNK)])
                    rest = (b - a) % CHUNK
                    tails.append(ratio(raw[b - rest : b]) if parts[-1] and rest >= LEAST_TAIL else None)
                failed = (n_words < 20) | (100 * again > 30 * n_words)
                values = [pa.array(n_words), pa.array(chars), pa.array(symbols), pa.array(lines, pa.int64()), pa.array(again), pa.array(np.diff(offs)), pa.array(ratios, pa.float64()), pa.array(failed), pa.array(half_octave(np.diff(offs))), pa.array(parts, pa.list_(pa.float64())), pa.array(tails, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *values], [id_col, *_names(RATIOS)])

    return run


def _judge(id_col: str, bands: Bands) -> Run:
    """From the columns of RATIOS to those of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(_names(RATIOS), batch.columns[1:], strict=True))
            chunks, out, least, most, kept = [], [], [], [], []
            for size, x, failed, parts, tail in zip(*(own[c].to_pylist() for c in ("n_bytes", "ratio", "base_failed", "parts", "tail")), strict=True):
                odd = bands.odd(parts, tail, size % CHUNK)
                low, high = bands.limits(size)
                chunks.append(len(odd))
                out.append(sum(odd))
                least.append(min(parts, default=None))
                most.append(max(parts, default=None))
                kept.append(not failed and low <= x <= high and not too_odd(odd))
            own |= {"chunks": pa.array(chunks, pa.int64()), "chunks_out": pa.array(out, pa.int64()), "chunk_low": pa.array(least, pa.float64()), "chunk_high": pa.array(most, pa.float64()), "kept": pa.array(kept, pa.bool_())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(own[c] for c in _names(SCHEMA))], [id_col, *_names(SCHEMA)])

    return run


def _typed(docs: DataFrame, id_col: str, schema: str) -> str:
    return f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {schema}"


def weigh(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and ratios, one row per document; one narrow pass."""
    return over_arrow(docs.select(id_col, text_col), _weigh(id_col), _typed(docs, id_col, RATIOS))


def judge(weighed: DataFrame, id_col: str = "doc_id", bands: Bands = Bands()) -> DataFrame:
    """The verdicts on rows of ``weigh``."""
    return over_arrow(weighed.select(id_col, *_names(RATIOS)), _judge(id_col, bands), _typed(weighed, id_col, SCHEMA))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document; one narrow pass."""
    first, then = _weigh(id_col), _judge(id_col, bands)
    return over_arrow(docs.select(id_col, text_col), lambda batches: then(first(batches)), _typed(docs, id_col, SCHEMA))


def _limits(least: float, most: float, mean: float, sd: float) -> tuple[float, float]:
    return min(least - MARGIN, mean - SPREAD * sd), max(most + MARGIN, mean + SPREAD * sd)


def bands_of(octaves: dict[int, tuple], chunks: tuple | None, held: Bands = Bands()) -> Bands:
    """Limits from least, greatest, mean and deviation of good texts' ratios by half octave, and of those of their chunks."""
    low, high = np.array(held.low), np.array(held.high)
    if octaves:
        known = sorted(octaves)
        found = np.array([_limits(*octaves[k]) for k in known])
        at = np.array(known) - held.first
        for own, new in ((low, found[:, 0]), (high, found[:, 1])):
            own += np.interp(np.arange(len(own)), at, new - own[at])  # between and beyond: as far from the held limits as beside
    pair = _limits(*chunks) if chunks else (held.chunk_low, held.chunk_high)
    # sums of doubles depend on the order of tasks in their last digits
    return Bands(held.first, *(tuple(x.round(12).tolist()) for x in (low, high)), *(round(x, 12) for x in pair))


def fit_weighed(weighed: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", held: Bands = Bands()) -> Bands:
    """Limits from all rows of ``weigh`` that are labelled 1 and pass the base; the driver gets a row per half octave."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("good")).where("good = 1").select(id_col)
    last, chunk = held.first + len(held.low) - 1, -1
    rows = weighed.where("not base_failed").select(id_col, F.least("octave", F.lit(last)).alias("k"), "ratio", F.array_min("parts").alias("lo"), F.array_max("parts").alias("hi"))
    each = F.array(F.struct("k", F.col("ratio").alias("x")), *(F.struct(F.lit(chunk).cast("long").alias("k"), F.col(c).alias("x")) for c in ("lo", "hi")))
    found = rows.join(good, id_col, "left_semi").select(F.explode(each).alias("e")).select("e.*").where(f"x is not null and (k >= {held.first} or k = {chunk})")
    stats = found.groupBy("k").agg(F.count("x").alias("n"), F.min("x"), F.max("x"), F.avg("x"), F.stddev_pop("x")).where(f"n >= {LEAST_FIT}").collect()
    octaves = {r.k: tuple(r)[2:] for r in stats}
    chunks = octaves.pop(chunk, None)
    return bands_of(octaves, chunks, held)


def fit_bands(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Bands:
    """Limits from all documents that are labelled 1 and pass the base."""
    return fit_weighed(weigh(docs, id_col, text_col), labels, id_col, label_col)


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    weighed = Scratch(spark, "quality").keep(weigh(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ratios")
    found = judge(weighed, bands=fit_weighed(weighed, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks", "chunks_out")
