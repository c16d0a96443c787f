"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon of words and one of word
beginnings, hits near second-person words, capitals, punctuation, obfuscation
(digits or symbols inside words, hits once these are undone, drawn-out
letters), and length. The lexicons are learned: words, and first ``STEM``
bytes of longer ones, that labelled toxic documents hold far more often than
others. While the trees are trained, a document's own label is taken out of
the counts of its words, so that the trees see what an unseen text would give.
Isotonic regression is fitted on scores from folds that left the row out.

At most about ``SAMPLE`` labelled rows, chosen by a hash of the id, are used to
fit; every row is scored. Null text is empty text and is scored too. Labels: the
greatest of an id's; null labels and ids without text are not used. Without
both kinds of label, all rows get the share of label 1. Rows keep their
multiplicity, and ``filter_clean`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.llm.arrow import over_arrow
from veclume.llm.boosting import Boosted, Isotonic
from veclume.llm.scratch import Scratch
from veclume.llm.textnum import LOWER, U64, Words, blocks, row_sum, span_hash, words_of

#: Labelled rows to fit on, about.
SAMPLE = 20_000
LEXICON_KEPT = 8192
STEM = 6
NEAR = 5
FOLDS = 3
THRESHOLD = 0.7
#: Words of address in four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Common insults, a feature of their own.
INSULTS = "idiot idiots moron morons stupid dumb fool loser losers clown clowns scum trash garbage worthless pathetic disgusting vermin imbecile jerk".split()
_UNDO = LOWER.copy()
for _a, _b in zip("0134578@$!|", "oieastbasil", strict=True):
    _UNDO[ord(_a)] = ord(_b)

FEATURES = 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("@"), ord("$")]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("!"), ord("?")]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or chr(b) in ".,;:'\"()-!?")]] = True
_ODD = _DIGIT.copy()
_ODD[[ord("@"), ord("$")]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    return np.sort(span_hash(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size))


def _is_in(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


_YOU, _SEED = _hash_words(SECOND_PERSON), _hash_words(INSULTS)


def keys_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and of the beginnings of longer words (else 0)."""
    size = words.ends - words.starts
    stem = np.zeros(len(size), U64)
    long = np.flatnonzero(size > STEM)
    stem[long] = span_hash(words.codes, words.starts[long], np.full(len(long), STEM)) ^ U64(0x5BD1E995)
    return span_hash(words.codes, words.starts, size), stem


@dataclass
class Lexicon:
    """Sorted keys with the numbers of toxic and of all labelled documents that hold them."""

    keys: np.ndarray
    toxic: np.ndarray
    total: np.ndarray
    share: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.keys >> U64(46)).astype(np.int64)] = True

    def weights(self, values: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log-odds of each word that counts as toxic, else 0; own: label of the document if it was counted, else -1."""
        out = np.zeros(len(values))
        hit = np.flatnonzero(self.maybe[(values >> U64(46)).astype(np.int64)])
        if not hit.size or not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, values[hit]), len(self.keys) - 1)
        same = self.keys[at] == values[hit]
        hit, at = hit[same], at[same]
        t = self.toxic[at] - (own[hit] == 1)
        n = self.total[at] - (own[hit] >= 0)
        p = (t + self.share) / (n + 1)
        p = np.clip(p, 0.001, 0.999)
        out[hit] = np.where((n >= 2) & (p >= max(0.4, 2 * self.share)), np.log(p / (1 - p)) - np.log(self.share / (1 - self.share)), 0)
        return out


def features(buf: np.ndarray, offs: np.ndarray, lexicon: Lexicon, own: np.ndarray | None = None) -> np.ndarray:
    """rows x FEATURES. own: labels of rows that the lexicon has counted (-1: not)."""
    rows = len(offs) - 1
    words = words_of(buf, offs, _WORD)
    first, row = words.first, words.row
    n = np.maximum(words.counts, 1)
    own = np.full(rows, -1) if own is None else own
    word, stem = keys_of(words)
    w1, w2 = lexicon.weights(word, own[row]), lexicon.weights(stem, own[row])
    both = np.maximum(w1, w2)
    hit = both > 0
    size = words.ends - words.starts
    odd = np.concatenate([[0], np.cumsum(_ODD[buf])])
    alpha = np.concatenate([[0], np.cumsum(_ALPHA[buf])])
    oddly = (odd[words.ends] > odd[words.starts]) & (alpha[words.ends] > alpha[words.starts])
    undone = np.zeros(len(word))
    at = np.flatnonzero(oddly)
    if at.size:
        keys = span_hash(_UNDO[buf], words.starts[at], size[at])
        undone[at] = (lexicon.weights(keys, own[row[at]]) > 0) | _is_in(_SEED, keys)
    you = _is_in(_YOU, word)
    run = np.concatenate([[0], np.cumsum(you)])
    place = np.arange(len(word))
    near = hit & (run[np.minimum(place + NEAR + 1, first[row + 1])] > run[np.maximum(place - NEAR, first[row])]) if len(word) else hit
    drawn = np.zeros(len(buf), bool)
    if len(buf) > 2:
        drawn[2:] = (words.codes[2:] == words.codes[1:-1]) & (words.codes[1:-1] == words.codes[:-2]) & _ALPHA[buf[2:]]

    def peak(w: np.ndarray) -> np.ndarray:
        out = np.zeros(rows)
        np.maximum.at(out, row[w > 0], w[w > 0])
        return out

    def total(w: np.ndarray) -> np.ndarray:
        cum = np.concatenate([[0.0], np.cumsum(w)])
        return cum[first[1:]] - cum[first[:-1]]

    kinds = np.zeros(rows)
    if hit.any():
        pairs = np.unique(np.stack([row[hit].astype(U64), word[hit]], axis=1), axis=0)
        kinds = np.bincount(pairs[:, 0].astype(np.int64), minlength=rows).astype(float)
    letters = np.maximum(row_sum(_ALPHA[buf], offs), 1)
    chars = np.maximum(np.diff(offs), 1)
    hits = row_sum(hit, first)
    return np.stack([
        hits, hits / n, kinds, total(w1), total(w2), peak(w1), peak(w2), total(both) / n, row_sum(w1 > 0, first), row_sum(w2 > 0, first),
        row_sum(_is_in(_SEED, word), first), row_sum(near, first), row_sum(you, first) / n, row_sum(_UPPER[buf], offs) / letters, row_sum(_MARK[buf], offs) / n,
        row_sum(_SYMBOL[buf], offs) / chars, row_sum(oddly, first) / n, total(undone), row_sum(drawn, offs) / letters, np.log1p(words.counts),
    ], axis=1).astype(float)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibrated: Isotonic

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.clip(self.calibrated(self.trees.raw(features(buf, offs, self.lexicon))), 0, 1)


def _word_counts(sample: DataFrame) -> DataFrame:
    """(key, t, n) of words and beginnings: toxic and all documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                words = words_of(buf, offs, _WORD)
                word, stem = keys_of(words)
                toxic = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = np.concatenate([word, stem[stem != 0]])
                row = np.concatenate([words.row, words.row[stem != 0]])
                order = np.lexsort((row, keys))
                keys, row = keys[order], row[order]
                once = np.ones(len(keys), bool)
                once[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                keys, row = keys[once], row[once]
                uniq, at = np.unique(keys, return_index=True)
                if not len(uniq):
                    continue
                t = np.add.reduceat(toxic[row], at)
                n = np.diff(np.concatenate([at, [len(keys)]]))
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(t), pa.array(n)], ["key", "t", "n"])

    return over_arrow(sample.select("doc", "text", "toxic"), run, "key long, t long, n long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the rows of docs that have a label; at most about ``sample`` of them."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.max(label_col).cast("int").alias("toxic"))
    total = known.count()
    whole = 1 << 40
    chosen = known.where(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(whole)) < int(whole * min(1.0, sample / max(total, 1))))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    picked = Scratch(spark, "toxicity").keep(rows.join(F.broadcast(chosen), "doc"), "sample")  # bounded by sample
    size = picked.agg(F.count("*"), F.avg("toxic")).first()
    share = float(np.clip(size[1] or 0.0, 0.001, 0.999))
    words = _word_counts(picked).where((F.col("t") >= 2) & ((F.col("t") + share) / (F.col("n") + 1) >= max(0.35, 2 * share))).orderBy(F.desc("t"), "n", "key").limit(LEXICON_KEPT).toArrow()
    key, t, n = (words.column(c).to_numpy() for c in ("key", "t", "n"))
    key = key.view(U64) if len(key) else np.zeros(0, U64)
    order = np.argsort(key)
    lexicon = Lexicon(key[order], t[order].astype(np.int64), n[order].astype(np.int64), share)
    held = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                toxic = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                x = features(buf, offs, held.value, toxic)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(toxic), pa.array([r.tobytes() for r in x], pa.binary())], ["doc", "toxic", "x"])

    found = over_arrow(picked.select("doc", "text", "toxic"), run, f"doc {docs.schema[id_col].dataType.simpleString()}, toxic long, x binary").orderBy("doc", "x").toArrow()
    x = np.array([np.frombuffer(b.as_py()) for b in found.column("x")]).reshape(-1, FEATURES)
    y = found.column("toxic").to_numpy().astype(float)
    fold = np.arange(len(y)) % FOLDS
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            raw[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, Boosted().fit(x, y), Isotonic.fit(raw, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., score); one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(id_col, *keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)], pa.array(held.value.score(buf, offs))], [id_col, *keep, "score"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, *keep)) + ", score double"
    return over_arrow(rows, run, schema)


def filter_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows with a score under the threshold; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(held.value.score(buf, offs) < threshold))

    return over_arrow(docs, run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def fit_contract(docs: DataFrame, spark: SparkSession, sf_dir: str) -> Model:
    """A model from the labels of rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return fit(docs.where(~held_out()), labels)


def toxicity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs.withColumn("held_out", held_out()), fit_contract(docs, spark, sf_dir), keep=("held_out",))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
