"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of words holds a filter per language side by side: bit l of a cell
belongs to language l, so a look-up of an n-gram (``HASHES`` cells, joined by
AND) gives the set of all languages that hold it at once. Beyond 64 languages
there are several such tables of 64 each (``planes``). Sums of the bits over
a text give each language's count of n-grams, which is corrected for the false
positives of its filter: (count - f n) / (1 - f), f the fill of its bits to the
power of the number of hashes. The greatest corrected share decides; ties go to
the language that sorts first.

N-grams are ``GRAM`` bytes of the lower-cased (A-Z) text in UTF-8 with runs of
other ASCII than letters as one blank. A language's filter takes the n-grams
that occur in ``LEAST_DOCS`` or more of its training documents and whose share
of its documents is at least ``RIVAL`` of the greatest share in any language,
so that what other languages only quote is left out; all of these enter, and
the filters' size follows their number. Training takes documents
with a language, at most about ``SAMPLE`` a language, chosen by a hash of the
id; everything else covers all rows and whole texts.

Null text, or text without a letter, is `und` with score 0. Without a language
to learn, all are `und`. Rows keep their multiplicity; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.llm.arrow import over_arrow
from veclume.llm.scratch import Scratch
from veclume.llm.textnum import LOWER, U64, blocks, mix, row_sum

GRAM = 4
HASHES = 2
#: Cells of a filter are 2 to the power of so many: four a n-gram of the language with most, within these limits.
LEAST_BITS, MOST_BITS = 16, 22
#: Training documents of a language, about (a bound on what is fitted, not on what is judged).
SAMPLE = 1500
LEAST_DOCS = 3
RIVAL = 0.3
#: Languages of a table.
PLANE = 64

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_UNICODE_LETTER = regex.compile(r"\p{L}")


def gram_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of each row, and their offsets by row. Rows begin and end with a blank."""
    n = len(offs) - 1
    size = np.diff(offs)
    padded = np.full(len(buf) + 2 * n, 0x20, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, size)
    padded[np.arange(len(buf)) + shift] = _FOLD[buf]
    row = np.repeat(np.arange(n), size + 2)
    keep = np.ones(len(padded), bool)
    blank = padded == 0x20
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    text, row = padded[keep], row[keep]
    if len(text) < GRAM:
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    m = len(text) - GRAM + 1
    keys = np.zeros(m, np.uint32)
    for j in range(GRAM):
        keys = (keys << np.uint32(8)) | text[j : j + m]
    whole = row[:m] == row[GRAM - 1 :]
    row = row[:m][whole]
    return keys[whole].astype(U64), np.searchsorted(row, np.arange(n + 1))


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
    mask = U64((1 << bits) - 1)
    return [((h >> U64(bits * k)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """The languages, in order, and a table of their bits for each PLANE of them."""

    languages: list[str]
    planes: np.ndarray

    def __post_init__(self) -> None:
        self.bits = self.planes.shape[1].bit_length() - 1
        one = self.planes.dtype.type
        fill = [float(((self.planes[k // PLANE] >> one(k % PLANE)) & one(1)).mean()) for k in range(len(self.languages))]
        self.false_rate = np.array(fill) ** HASHES

    def masks(self, keys: np.ndarray, plane: int = 0) -> np.ndarray:
        """Bit sets of the languages of a plane that hold each n-gram."""
        table = self.planes[plane]
        a, *rest = cells(keys, self.bits)
        out = table[a]
        for b in rest:
            out &= table[b]
        return out

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, score) of each row."""
        n = len(offs) - 1
        if not self.languages:
            return np.full(n, -1), np.zeros(n)
        keys, first = gram_keys(buf, offs)
        one, sums = self.planes.dtype.type, []
        for plane in range(len(self.planes)):
            masks = self.masks(keys, plane)
            sums += [row_sum((masks >> one(k)) & one(1), first) for k in range(min(PLANE, len(self.languages) - plane * PLANE))]
        counts = np.stack(sums, axis=1)
        total = np.maximum(np.diff(first), 1)[:, None]
        share = np.clip((counts / total - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        top = share[np.arange(n), best]
        score = np.where(top > 0, top / np.maximum(share.sum(axis=1), 1e-12), 1 / len(self.languages))
        lettered = row_sum(_LETTER[LOWER[buf]], offs) > 0
        for r in np.flatnonzero(~lettered & (np.diff(offs) > 0)):
            lettered[r] = bool(_UNICODE_LETTER.search(buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace")))
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def _gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): documents of a language that hold an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def counted(lang: str) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                keys, first = gram_keys(buf, offs)
                for r, lang in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    own = np.unique(keys[first[r] : first[r + 1]])
                    held.setdefault(lang, [np.zeros(0, U64)]).append(own)
            for lang in [k for k, v in held.items() if sum(map(len, v)) > 2_000_000]:
                yield counted(lang)
        for lang in list(held):
            yield counted(lang)

    return over_arrow(docs.select(lang_col, text_col), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters of the languages in docs; the driver gets the cells that are set, at most 2^MOST_BITS a plane."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.count("*")).collect()}
    if not sizes:
        return Filters([], np.zeros((1, 1 << LEAST_BITS), np.uint8))
    whole = 1 << 40
    part = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(whole * min(1.0, sample / n)))])
    chosen = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(whole)) < F.element_at(part, F.col(lang_col))
    picked = known.where(chosen)
    held = {r[0]: r[1] for r in picked.groupBy(lang_col).agg(F.count("*")).collect()}
    languages = sorted(held)
    least = {k: min(LEAST_DOCS, max(1, v // 3)) for k, v in held.items()}
    known = docs.sparkSession.createDataFrame([(k, i, float(held[k]), least[k]) for i, k in enumerate(languages)], "lang string, number int, docs double, least int")
    counts = _gram_counts(picked, text_col, lang_col).join(F.broadcast(known), "lang")  # a row a language
    share = counts.select("gram", "number", "n", "least", (F.col("n") / F.col("docs")).alias("share"))
    top = share.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("number", "share", "n", "least")).alias("own"))  # an entry a language
    kept = Scratch(docs.sparkSession, "language").keep(top.select("gram", "most", F.explode("own").alias("x")).select("gram", "most", "x.*").where((F.col("share") >= RIVAL * F.col("most")) & (F.col("n") >= F.col("least"))).select("number", "gram"), "grams")
    most = kept.groupBy("number").count().agg(F.max("count")).first()[0] or 0
    bits = min(max((4 * most).bit_length(), LEAST_BITS), MOST_BITS)
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
    planes = np.zeros((max(1, -(-len(languages) // PLANE)), 1 << bits), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(U64)
            mask = (U64(1) << (number % PLANE).astype(U64)).view(np.int64)
            for c in cells(keys, bits):
                yield pa.RecordBatch.from_arrays([pa.array((number // PLANE).astype(np.int32)), pa.array(c), pa.array(mask)], ["plane", "cell", "mask"])

    found = over_arrow(kept, run, "plane int, cell long, mask long").groupBy("plane", "cell").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    planes[found.column("plane").to_numpy(), found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(U64).astype(kind)
    return Filters(languages, planes)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score); one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(id_col, *keep, text_col)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, *keep)) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(batch.num_columns - 1)):
                best, score = own.predict(buf, offs)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)], pa.array(names[best], pa.string()), pa.array(score)], [id_col, *keep, "lang_pred", "score"])

    return over_arrow(rows, run, schema)


def language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False)).alias("held_out")
    filters = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held_out), filters, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
