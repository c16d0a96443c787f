"""Benchmark decontamination by stored suffix arrays of the training text.

``build`` turns the training text into shards of about ``SHARD_BYTES``. A shard
has its words as ranks in its own sorted vocabulary, and an array of the
positions of all of them, sorted by the suffixes that begin there as far as
``DEPTH`` words (ends of documents come first, ties by position). Shards know
nothing of any test set and are stored as rows of a Parquet table, so a new
benchmark needs no new pass over the texts.

``search`` looks up every test suffix in every shard by binary search, a word
at a time: the interval of the array narrows until the window of ``window``
words is met, and what is left are all its verbatim occurrences. Runs of
occurrences on one diagonal are the longest verbatim matches, with their places.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters,
compared by 64-bit hashes. Null or empty text has no words, is never
contaminated and stays. A test item without words (or null) never matches;
repeated items each count. Items without an id hit like others and stand in
``items`` as null. Rows keep their multiplicity, whatever their ids. Extra
columns are ignored by ``scan`` and pass through ``filter_clean`` untouched.

The test set is read in blocks of at most ``block_words`` words, each of which
is broadcast on its own, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.llm.arrow import over_arrow
from veclume.llm.rows import fresh, without
from veclume.llm.scratch import Scratch
from veclume.llm.textnum import ALNUM_WORDS, U64, blocks, row_sum, text_buffer, words_of

WINDOW = 10
#: Words by which suffixes are sorted, a power of two.
DEPTH = 16
BLOCK_WORDS = 500_000
SHARD_BYTES = 2 << 20


@dataclass
class TestSet:
    """The windows of some test items: word hashes, and begin, size, item and place in the item of each window."""

    words: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    item: np.ndarray
    place: np.ndarray
    items: list[str | None]


def test_set(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> TestSet:
    buf, offs = text_buffer(pa.array([t for _, t in items], pa.large_string()))
    words = words_of(buf, offs, ALNUM_WORDS)
    n = words.counts
    count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), count)
    place = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    return TestSet(words.hashes(), words.first[item] + place, np.minimum(n, window)[item], item, place, [i for i, _ in items])


def suffix_order(ranks: np.ndarray, first: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions of all words, sorted by the suffixes from there on (within their rows) as far as depth words; ties by position."""
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int32)
    end = np.repeat(first[1:], np.diff(first))
    kind, reach = ranks.astype(np.int64) + 1, 1
    while reach < depth:
        at = np.arange(n) + reach
        after = np.where(at < end, kind[np.minimum(at, n - 1)], 0)
        found, kind = np.unique(kind * (int(kind.max()) + 1) + after, return_inverse=True)
        kind, reach = kind.astype(np.int64) + 1, 2 * reach
        if len(found) == n:
            break
    return np.argsort(kind, kind="stable").astype(np.int32)


@dataclass
class Shard:
    """Words of some rows (row r: first[r] to first[r + 1]) as ranks in a sorted vocabulary, and their sorted suffixes."""

    first: np.ndarray
    vocabulary: np.ndarray
    ranks: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> Shard:
        words = words_of(buf, offs, ALNUM_WORDS)
        vocabulary, ranks = np.unique(words.hashes(), return_inverse=True)
        ranks = ranks.astype(np.int32)
        return cls(words.first, vocabulary, ranks, suffix_order(ranks, words.first, depth))

    def find(self, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of all occurrences of the windows of tests."""
        none = np.zeros(0, np.int64)
        if not len(self.ranks) or not len(tests.begin):
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, tests.words), len(self.vocabulary) - 1)
        rank = np.where(self.vocabulary[at] == tests.words, at, -1)
        lost = np.concatenate([[0], np.cumsum(rank < 0)])
        window = np.flatnonzero(lost[tests.begin + tests.size] == lost[tests.begin])
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        low, high = np.zeros(len(window), np.int64), np.full(len(window), len(self.order), np.int64)
        for k in range(int(tests.size.max(initial=0))):
            more = np.flatnonzero(tests.size[window] > k)
            key = rank[tests.begin[window[more]] + k]
            low[more], high[more] = self._narrow(low[more], high[more], key, k, row_end), self._narrow(low[more], high[more], key + 1, k, row_end)
            open_ = high > low
            window, low, high = window[open_], low[open_], high[open_]
            if not window.size:
                return none, none
        size = high - low
        begin = np.cumsum(size) - size
        return np.repeat(window, size), self.order[np.repeat(low - begin, size) + np.arange(size.sum())].astype(np.int64)

    def _narrow(self, low: np.ndarray, high: np.ndarray, key: np.ndarray, k: int, row_end: np.ndarray) -> np.ndarray:
        """First place of each interval, whose suffixes agree in k words, with a word at k of rank key or more."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not open_.size:
                return low
            mid = (low[open_] + high[open_]) >> 1
            at = self.order[mid].astype(np.int64) + k
            start = at - k
            word = np.where(at < row_end[start], self.ranks[np.minimum(at, len(self.ranks) - 1)], -1)
            less = word < key[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)


def _packed(x: np.ndarray) -> bytes:
    """Numbers by bytes of like significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpacked(data: pa.Scalar, dtype: str, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data.as_buffer(), max_output_size=max(1, n * np.dtype(dtype).itemsize))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, n).T).view(dtype)[:, 0] if n else np.zeros(0, dtype)


INDEX_COLUMNS = ["first", "vocabulary", "ranks", "suffixes"]


def build(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """The stored shards of docs: ids, first word of each row and the end, vocabulary, ranks, suffixes. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1), SHARD_BYTES):
                s = Shard.of(buf, offs, depth)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                blobs = [pa.array([x], pa.binary()) for x in (s.first.astype("<i8").tobytes(), s.vocabulary.tobytes(), _packed(s.ranks), _packed(s.order))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *blobs], ["shard", "ids", *INDEX_COLUMNS])
                number += 1

    schema = f"shard long, ids array<{docs.schema[id_col].dataType.simpleString()}>, first binary, vocabulary binary, ranks binary, suffixes binary"
    return scratch.keep(over_arrow(docs.select(id_col, text_col), run, schema), "shards")


def _shard(batch: pa.RecordBatch, r: int) -> Shard:
    first, vocabulary = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("first", "<i8"), ("vocabulary", U64)))
    n = int(first[-1])
    return Shard(first, vocabulary, _unpacked(batch.column("ranks")[r], "<i4", n), _unpacked(batch.column("suffixes")[r], "<i4", n))


def hits_of(shard: Shard, tests: TestSet) -> list[dict]:
    """Of each row with a match: place, words hit (begin, end, ...), items, longest match, where it begins and its item."""
    window, position = shard.find(tests)
    if not len(window):
        return []
    edge = np.zeros(len(shard.ranks) + 1, np.int64)
    np.add.at(edge, position, 1)
    np.add.at(edge, position + tests.size[window], -1)
    covered = np.cumsum(edge[:-1]) > 0
    row = np.searchsorted(shard.first, position, "right") - 1
    item, diagonal = tests.item[window], position - tests.place[window]
    order = np.lexsort((position, diagonal, item, row))
    row, item, diagonal, at, size = row[order], item[order], diagonal[order], position[order], tests.size[window][order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.flatnonzero(new)
    length = size[run] + np.diff(np.concatenate([run, [len(row)]])) - 1
    row, item, at = row[run], item[run], at[run]
    out = []
    for part in np.split(np.arange(len(run)), np.flatnonzero(np.diff(row)) + 1):
        r = int(row[part[0]])
        a, b = int(shard.first[r]), int(shard.first[r + 1])
        spans = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
        best = part[np.lexsort((item[part], at[part], -length[part]))[0]]
        out.append({"row": r, "spans": spans.tolist(), "items": [tests.items[k] for k in np.unique(item[part])], "longest": int(length[best]), "at": int(at[best]) - a, "of": tests.items[item[best]]})
    return out


def test_blocks(tests: DataFrame, item_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items as strings in blocks of at most about block_words words; rows stream through the driver."""
    held, n = [], 0
    for item, text in tests.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator(prefetchPartitions=False):
        size = len(text or "") // 2 + 1
        if held and n + size > block_words:
            yield held
            held, n = [], 0
        held.append((item, text))
        n += size
    yield held


FOUND_SCHEMA = "shard long, row int, block long, spans array<int>, items array<string>, longest long, at long, of string"


def search(shards: DataFrame, tests: DataFrame, scratch: Scratch, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, depth: int = DEPTH) -> DataFrame:
    """A row per row with a match: shard, row there, spans, items, longest match; what blocks of tests find is put together.

    A narrow pass over the shards a block; only rows with a match are shuffled.
    """
    if window > depth:
        raise ValueError(f"windows of {window} words in suffixes sorted by {depth}")
    found = []
    for number, block in enumerate(test_blocks(tests, item_col, item_text, block_words)):
        held = shards.sparkSession.sparkContext.broadcast(test_set(block, window))

        def run(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            own = held.value
            schema = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("block", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("at", pa.int64()), ("of", pa.string())])
            for batch in batches:
                for r, name in enumerate(batch.column("shard").to_pylist()):
                    hits = hits_of(_shard(batch, r), own)
                    if hits:
                        yield pa.RecordBatch.from_pylist([{"shard": name, "block": number, **h} for h in hits], schema)

        found.append(scratch.keep(over_arrow(shards.select("shard", *INDEX_COLUMNS), run, FOUND_SCHEMA), "found"))
        held.unpersist()
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    best = F.min_by(F.struct("longest", "at", "of"), F.struct((-F.col("longest")).alias("l"), "at", "block"))
    one = both.groupBy("shard", "row").agg(F.collect_list("spans").alias("spans"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "items"))), lambda x: x["items"])).alias("items"), best.alias("b"))  # an entry a block of tests
    return one.select("shard", "row", _merged("spans").alias("spans"), "items", "b.*")


def _merged(spans: str) -> F.Column:
    """Begins and ends of the union of lists of spans (begin, end, ...)."""
    pairs = F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(F.lit(0), (F.size(s) / 2).cast("int") - 1), lambda k: F.struct(F.get(s, 2 * k).alias("a"), F.get(s, 2 * k + 1).alias("b")))))
    one = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        joined = F.struct(acc["last"]["a"].alias("a"), F.greatest(acc["last"]["b"], x["b"]).alias("b"))
        meets = (x["a"] <= acc["last"]["b"]) & (acc["last"]["a"] >= 0)
        out = F.when(meets | (acc["last"]["a"] < 0), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]["a"], acc["last"]["b"])))
        return F.struct(F.when(meets, joined).otherwise(x).alias("last"), out.alias("out"))

    whole = F.aggregate(F.array_sort(pairs), F.struct(one.alias("last"), F.array().cast("array<int>").alias("out")), step, lambda acc: F.concat(acc["out"], F.array(acc["last"]["a"], acc["last"]["b"])))
    return F.when(F.size(spans) == 1, F.element_at(spans, 1)).otherwise(whole)


def _hit(spans: str) -> F.Column:
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda acc, x: F.struct((acc["n"] + acc["sign"] * x).alias("n"), (-acc["sign"]).alias("sign")), lambda acc: acc["n"])


def scan(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: words, words hit, items met, spans hit (word begin, end, ...) and longest match."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    depth = max(DEPTH, 1 << (window - 1).bit_length())
    shards = build(docs, scratch, id_col, text_col, depth)
    found = search(shards, tests, scratch, item_col, item_text, window, block_words, depth)
    sizes = over_arrow(shards.select("shard", "ids", "first"), _sizes, f"shard long, row int, id {docs.schema[id_col].dataType.simpleString()}, n_words long")
    out = sizes.join(found, ["shard", "row"], "left")
    hit = F.col("spans").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(hit, _hit("spans")).otherwise(0).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans"),
        F.coalesce("longest", F.lit(0).cast("long")).alias("longest_match"), F.coalesce("at", F.lit(-1).cast("long")).alias("longest_at"), F.col("of").alias("longest_item"),
    )


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, row, id, n_words) of the rows of each shard."""
    for batch in batches:
        for r in range(len(batch)):
            counts = np.diff(np.frombuffer(batch.column("first")[r].as_buffer(), "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), batch.column("shard")[r].as_py())), pa.array(np.arange(len(counts), dtype=np.int32)), batch.column("ids")[r].values, pa.array(counts)], ["shard", "row", "id", "n_words"])


def filter_clean(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs without any verbatim test window; all columns stay.

    Whether a row goes depends on its text alone, so rows are known by two
    hashes and the length of their text, and equal texts share a fate.
    """
    keys = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col), F.octet_length(text_col)]
    names = ("a", "b", "n")
    key = fresh(docs.columns, "text_key")
    found = scan(docs.select(F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).alias(key), text_col), tests, key, text_col, item_col, item_text, window, block_words)
    gone = Scratch(docs.sparkSession, "contaminated").keep(found.where("n_hit > 0").select(f"{key}.*").distinct(), "gone")
    return without(docs, gone, keys)


def decontamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.withColumn("items", F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match", "longest_at", "longest_item",
    )


def report_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of decontamination_report: windows as lists of words, joined; spans and runs by window functions."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{low}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
 b AS (SELECT item_id, {words} AS ws FROM benchmark),
 bw AS (SELECT item_id, j, list_slice(ws, j, least(len(ws), j + {window - 1})) AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - {window - 1}, 1) + 1)) AS j FROM b WHERE len(ws) > 0)),
 sizes AS (SELECT DISTINCT len(k) AS n FROM bw),
 dw AS (SELECT doc_id, p, list_slice(ws, p, p + n - 1) AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
 m AS (SELECT doc_id, item_id, p, j, len(k) AS n FROM dw JOIN bw USING (k)),
 hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY 1),
 runs AS (SELECT doc_id, item_id, min(p) - 1 AS place, max(n) + count(*) - 1 AS length FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - j ORDER BY p) AS g FROM m) GROUP BY doc_id, item_id, p - j, g),
 best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, place, item_id) = 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
 coalesce(length, 0)::BIGINT AS longest_match, coalesce(place, -1)::BIGINT AS longest_at, item_id::VARCHAR AS longest_item
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""
