"""N-gram Jaccard join, size-aware: subsets of small sets, inverted lists of large sets.

Sets: A-Z lower-cased, words between ASCII white space, distinct 5-word
shingles as 64-bit hashes; fewer words form one shingle; none, the empty set,
which links with nothing. Two documents link when 100 |A and B| >= 80 |A or B|.

1. ``profile`` (one pass) gives each document's set size and fingerprint, the
   frequent shingles, and the costs of either treatment by set size.
2. Documents of equal sets form a class; only its least id goes on.
3. Shingles have a global order, frequent ones last. With J >= t, |A and B| >=
   ceil(t max(|A|, |B|)), so linked sets share at least l shingles among the
   first |A| - ceil(t |A|) + l of each. Light sets (size <= boundary) are keyed
   by the 2-subsets of that prefix with l = 2; heavy sets, and light ones that
   could meet a heavy one, enter the inverted lists of the prefix with l = 1.
   The boundary is the one with the least total of subset rows, list rows and
   expected list scanning, as measured in the first pass. Sets so small that a
   link may rest on one shingle enter the lists too; sets that no other set can
   link with (of less than 4 at 80 %) enter none.
4. Keys travel as packed blobs by key range; the receiver keeps keys of two or
   more documents. In each such key first one, then another member (a hub) is
   compared with the rest, which is linear, and components are formed; at last
   all pairs of a key whose components still differ are compared. No link
   between different components is lost, and members of a large group of copies
   are not paired with each other. Rows of the heaviest classes and keys meet
   their class or hub by a broadcast of at most ``HOT_KEYS`` rows, and a long
   list is dealt out in blocks, so that no key is the work of one task.
5. Pairs first meet a bound: each set has a table of bits, the parity of its
   hashes by cell, about as many cells as elements; tables differ in no more
   bits than the sets in elements, so pairs that differ in too many cannot link
   (a table folds to a shorter one by XOR of its halves). What passes is
   verified on the sets themselves (64-bit hashes), which are made anew from
   the texts of these documents only. Equal sets are known by their size and
   two 64-bit sums of their hashes.

Frequency only orders the shingles, so the bound on how many frequent shingles
are known (``HOT_KEPT``) bears on cost, not on results. Nulls: null text is
empty text; a null id makes its own component (null). Rows of one id are one
document with the links of all its texts. Ids are integers; others raise. Extra
columns, whatever their names, are ignored by ``components`` and kept by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veclume.llm.arrow import over_arrow
from veclume.llm.graph import connected_components
from veclume.llm.rows import bit_table, in_table, without
from veclume.llm.scratch import Scratch, release
from veclume.llm.textnum import SPACED_WORDS, U64, blocks, mix, row_sets, words_of

K = 5
PERCENT = 80
#: Frequent shingles whose order is known everywhere: at most so many (16 bytes each).
HOT_KEPT = 1 << 18
#: A shingle is frequent from so many documents in the counts of the first pass.
HOT_LEAST = 8
#: Shingles counted together in a task.
COUNT_WINDOW = 2_000_000
#: Keys packed together in a task, and keys of a range, about.
PACK_KEYS = 1_000_000
RANGE_KEYS = 2_000_000
#: Words of 64 cells of the shortest parity table, and of the fold that the join itself tests.
PARITY_WORDS = 16
FOLD_WORDS = 8
#: Keys at most that are broadcast since they hold a greater share of all rows than one by this number.
HOT_KEYS = 4096
#: Members of a key that are compared with each other in one task; more are dealt out in blocks of so many.
BLOCK_MEMBERS = 512
#: Cost of a candidate in a list against that of a row written.
SCAN_COST = 0.5
MAX_LIGHT = 256


def overlap_least(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """ceil(t n): what a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def _size_bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, MAX_LIGHT + 1)


@dataclass
class Order:
    """Frequent shingles, sorted, with their ranks (rarer first); all others come before them by hash."""

    tokens: np.ndarray
    ranks: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.tokens >> U64(42)).astype(np.int64)] = True

    def prefixes(self, sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
        """Of each set the prefix with l = 2, in the global order."""
        if not sets:
            return []
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        hit = np.flatnonzero(self.maybe[(flat >> U64(42)).astype(np.int64)])
        rank = np.zeros(len(flat), np.int64)
        if hit.size and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, flat[hit]), len(self.tokens) - 1)
            rank[hit] = np.where(self.tokens[at] == flat[hit], self.ranks[at] + 1, 0)
        take = np.minimum(size - overlap_least(size, percent) + 2, size)
        out, end = [], np.cumsum(size)
        for s, r, p in zip(sets, np.split(rank, end[:-1]), take.tolist(), strict=True):
            if r.any():
                s = s[np.argsort(r, kind="stable")]
            out.append(s[:p])
        return out


def subsets_of_two(prefix: np.ndarray) -> np.ndarray:
    """Keys of all 2-subsets of a prefix, whatever the order of its shingles."""
    i, j = np.triu_indices(len(prefix), 1)
    a, b = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
    return mix(a * U64(0x9E3779B97F4A7C15) + mix(b + U64(0xA0761D6478BD642F)))


def parities(s: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes by cell, 64 a word: a power of two of words, as many cells as elements or more."""
    words = PARITY_WORDS
    while 64 * words < len(s):
        words *= 2
    count = np.bincount((s & U64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits(count & 1, bitorder="little").view(np.int64)


def fold(table: np.ndarray, words: int) -> np.ndarray:
    """The table of fewer cells."""
    return np.bitwise_xor.reduce(table.reshape(-1, words), axis=0)


def _profile(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Rows (kind, a, b, c, d, bits, fold): 0 a document's id, size, fingerprint, parities; 1 a shingle and its count; 2 costs of a size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n = 0

        def rows(kind: int, *cols: np.ndarray | pa.Array, bits: list[np.ndarray] | None = None) -> pa.RecordBatch:
            cols = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == U64 else c.astype(np.int64)) for c in cols]
            n = len(cols[0])
            tables = [pa.array([None] * n if bits is None else b, pa.list_(pa.int64())) for b in (bits, bits and [fold(t, FOLD_WORDS) for t in bits])]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *cols, *tables], ["kind", "a", "b", "c", "d", "bits", "fold"])

        def counted() -> Iterator[pa.RecordBatch]:
            order = np.concatenate(held)
            order.sort()
            first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
            count = np.diff(np.concatenate([first, [len(order)]]))
            many = count > 1
            known, counts = order[first[many]], count[many]
            if len(known):
                yield rows(1, known, counts, np.zeros(len(known), np.int64), np.zeros(len(known), np.int64))
            size = np.array([len(s) for s in held])
            p = np.minimum(size - overlap_least(size, percent) + 1, size)
            scan = np.zeros(len(held))
            if len(known):
                flat = np.concatenate([s[:k] for s, k in zip(held, p.tolist(), strict=True)])
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                others = np.where(known[at] == flat, np.minimum(counts[at], HOT_LEAST) - 1, 0)
                scan = np.add.reduceat(others, np.cumsum(p) - p)
            bins = _size_bin(size)
            used = np.unique(bins)
            light = (p + 1) * p // 2
            yield rows(2, used, np.bincount(bins, light)[used], np.bincount(bins, p)[used], np.bincount(bins, scan)[used])

        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                sets = row_sets(words_of(buf, offs, SPACED_WORDS), K)
                size = np.array([len(s) for s in sets], np.int64)
                one = np.array([int(s.sum(dtype=U64)) if len(s) else 0 for s in sets], U64)
                two = np.array([int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets], U64)
                yield rows(0, batch.column(0).slice(i, j - i).cast(pa.int64()), size, mix(one), two, bits=[parities(s) for s in sets])
                full = [s for s in sets if len(s)]
                held += full
                held_n += int(size.sum())
                if held_n >= COUNT_WINDOW:
                    yield from counted()
                    held, held_n = [], 0
        if held:
            yield from counted()

    return over_arrow(docs.select(id_col, text_col), run, "kind byte, a long, b long, c long, d long, bits array<long>, fold array<long>")


def can_link(n: int, percent: int) -> bool:
    """Whether a set of n can link with another set at all: with itself and one element more at best."""
    return 100 * n >= percent * (n + 1)


def choose_boundary(costs: dict[int, tuple[float, float, float]], percent: int = PERCENT) -> int:
    """Largest size of a light set: least total cost. costs: by size (subset rows, list rows, scanned)."""
    best, at = None, 0
    for x in range(3, MAX_LIGHT + 1):
        total = 0.0
        for n, (light, listed, scan) in costs.items():
            if n <= x:
                total += light
            if n > x or n * 100 >= percent * x:
                total += listed + SCAN_COST * scan
        if best is None or total < best:
            best, at = total, x
    return at


def _keys(docs: DataFrame, id_col: str, text_col: str, order, boundary: int, ranges: int, percent: int) -> DataFrame:
    """(range, keys blob, ids blob): keys of each document, packed by key range."""
    wide = U64(-(-(1 << 64) // ranges)) if ranges > 1 else None
    reach = boundary * percent  # sizes n with 100 n >= reach can meet a heavy set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Order = order.value
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        seen: set[tuple[int, int, int]] = set()  # of equal sets in this window one enters; its class stands for all
        n = 0

        def packed() -> Iterator[pa.RecordBatch]:
            k, d = np.concatenate(keys), np.concatenate(ids)
            at = np.argsort(k, kind="stable")
            k, d = k[at], d[at]
            part = (k // wide).astype(np.int64) if wide is not None else np.zeros(len(k), np.int64)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            end = np.concatenate([first[1:], [len(k)]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first]), pa.array([k[a:b].tobytes() for a, b in zip(first, end, strict=True)], pa.binary()), pa.array([_planes(d[a:b]) for a, b in zip(first, end, strict=True)], pa.binary())],
                ["part", "keys", "ids"],
            )

        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                doc = batch.column(0).slice(i, j - i)
                known = np.flatnonzero(np.asarray(doc.is_valid()))
                doc = doc.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                sets = row_sets(words_of(buf, offs, SPACED_WORDS), K)
                use = []
                for r in known.tolist():
                    s = sets[r]
                    if can_link(len(s), percent):  # others link with equal sets only
                        mark = (len(s), int(s.sum(dtype=U64)), int(np.bitwise_xor.reduce(mix(s))))
                        if mark not in seen:
                            seen.add(mark)
                            use.append(r)
                for r, prefix in zip(use, own.prefixes([sets[r] for r in use], percent), strict=True):
                    size = len(sets[r])
                    least = int(overlap_least(np.int64(size), percent))
                    mine = []
                    if size <= boundary:
                        mine.append(subsets_of_two(prefix))
                    if size * 100 >= reach or least < 2:  # sets that may share but one shingle have no subset in common
                        mine.append(prefix[: size - least + 1])
                    for m in mine:
                        keys.append(m)
                        ids.append(np.full(len(m), doc[r], np.int64))
                        n += len(m)
                if n >= PACK_KEYS:
                    yield from packed()
                    keys, ids, n = [], [], 0
                    seen.clear()
        if n:
            yield from packed()

    return over_arrow(docs.select(id_col, text_col), run, "part long, keys binary, ids binary")


def _planes(ids: np.ndarray) -> bytes:
    """Bytes of all ids by significance, which the shuffle's codec packs well."""
    return ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8")[:, 0]


def _shared(packed: DataFrame, ranges: int) -> DataFrame:
    """(key, doc) of the keys of two or more documents; a partition a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for batch in batches:
            keys += [np.frombuffer(x.as_py(), U64) for x in batch.column(0)]
            ids += [_unplanes(x.as_py()) for x in batch.column(1)]
        if not keys:
            return
        k, d = np.concatenate(keys), np.concatenate(ids)
        keys, ids = [], []
        at = np.lexsort((d, k))
        k, d = k[at], d[at]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        keep = same[1:] | same[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(k[keep].view(np.int64)), pa.array(d[keep])], ["key", "doc"])

    return over_arrow(packed.repartitionById(ranges, F.col("part").cast("int")).select("keys", "ids"), run, "key long, doc long")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(doc, n, tokens) of the documents that are wanted (doc), and some others; tokens: their hashes, sorted."""
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = bit_table(wanted.select(F.xxhash64("doc")))
    rows = (docs if found else docs.join(wanted.select("doc"), "doc", "left_semi")).withColumn("hash", F.xxhash64("doc"))
    held = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            if table is not None:
                batch = batch.filter(pa.array(in_table(*table, batch.column(2).to_numpy())))
            for i, j, buf, offs in blocks(batch.column(1)):
                sets = row_sets(words_of(buf, offs, SPACED_WORDS), K)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "n", "tokens"])

    return over_arrow(rows, run, "doc long, n long, tokens binary")


def _join_split(left: DataFrame, right: DataFrame, keys: list[str], value: str, weight: str, spread: str) -> DataFrame:
    """left with the value of right by keys, which are unique there (null: none).

    weight: rows of left by key. The keys with more than one in HOT_KEYS of all
    rows, of which there are no more than HOT_KEYS, are broadcast; the others go
    by a shuffle in which the rows of hot keys are dealt out by ``spread``.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) * HOT_KEYS > total).select(*keys, F.col(value).alias("hot_value"))
    cold = right.where(F.col(weight) * HOT_KEYS <= total).select(*[F.col(k).alias(f"cold_{k}") for k in keys], F.col(value).alias("cold_value"))
    both = left.join(F.broadcast(hot), keys, "left")
    is_cold = F.col("hot_value").isNull()
    at = [F.when(is_cold, F.col(keys[0])).otherwise(F.xxhash64(spread)) == F.col(f"cold_{keys[0]}"), *[F.col(k) == F.col(f"cold_{k}") for k in keys[1:]]]
    joined = both.join(cold, reduce(lambda x, y: x & y, at) & is_cold, "left")
    return joined.select(*left.columns, F.coalesce("hot_value", "cold_value").alias(value))


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, by their sizes and parities."""
    left = pairs.join(bits.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("pa")), "a")
    both = left.join(bits.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("pb")), "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keep = []
            for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                words = min(len(x), len(y))
                differ = int(np.bitwise_count((fold(x, words) ^ fold(y, words)).view(U64)).sum())
                keep.append(differ * (100 + percent) <= (100 - percent) * (na + nb) and min(na, nb) * 100 >= max(na, nb) * percent)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return over_arrow(both, run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b), by the sets themselves."""
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                linked = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return over_arrow(both, run, "a long, b long, linked boolean")


def _close(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


@dataclass
class Candidates:
    """What components and links start from. placed: (doc, n, rep) of each row with an id; members: the keys of two or more classes, with their hubs."""

    scratch: Scratch
    profile: DataFrame
    one: DataFrame
    placed: DataFrame
    members: DataFrame
    tested: Callable[[DataFrame], DataFrame]


def _candidates(docs: DataFrame, id_col: str, text_col: str, percent: int) -> Candidates:
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids must be integers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(id_col, text_col)
    profile = scratch.keep(_profile(docs, id_col, text_col, percent), "profile")
    one = profile.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("f1"), F.col("d").alias("f2"))
    named = one.where("doc is not null")
    costs = {int(r.a): (float(r.b), float(r.c), float(r.d)) for r in profile.where("kind = 2").groupBy("a").agg(F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("d").alias("d")).collect()}
    boundary = choose_boundary(costs, percent)
    hot = profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "a").limit(HOT_KEPT)
    table = hot.toArrow()
    tokens, counts = table.column("a").to_numpy().view(U64) if len(table) else np.zeros(0, U64), table.column("n").to_numpy() if len(table) else np.zeros(0, np.int64)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    at = np.argsort(tokens)
    order = spark.sparkContext.broadcast(Order(tokens[at], rank[at]))
    total = sum((light if n <= boundary else 0) + (listed if n * 100 >= percent * boundary else 0) for n, (light, listed, _) in costs.items())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / RANGE_KEYS), 1)
    shared = scratch.keep(_shared(_keys(docs, id_col, text_col, order, boundary, ranges, percent), ranges), "shared")

    # classes of equal sets (the empty set is no class), and each document's number of keys that it alone has
    classes = named.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    placed = _join_split(named, scratch.keep(classes, "classes"), ["f1", "f2", "n"], "rep", "copies", "doc")
    placed = scratch.keep(placed.select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "placed")
    p = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    all_keys = F.when(F.col("n") <= boundary, (p + 1) * p / 2).otherwise(0) + F.when(F.col("n") * 100 >= percent * boundary, p).otherwise(0)
    sizes = placed.groupBy("doc", "rep").agg(F.max("n").alias("n"))
    own = shared.groupBy("doc").agg(F.count("*").alias("m")).join(sizes, "doc").select("doc", "rep", "n", (all_keys - F.col("m")).alias("alone"))
    each = scratch.keep(shared.join(own, "doc").groupBy("key", F.col("rep").alias("doc"), "n").agg(F.min("alone").alias("alone")), "each")

    # hubs: two members of each key against the others, linear in the list. The first is the one with the fewest
    # keys of its own, the text that copies were made from, or near it; the second is any.
    one_of = F.struct("doc", "n")
    hubs = each.groupBy("key").agg(F.count("*").alias("m"), F.min_by(one_of, F.struct("alone", "doc")).alias("h"), F.max_by(one_of, F.xxhash64("doc")).alias("g")).where("m > 1")
    hubs = scratch.keep(hubs.select("key", "m", F.struct("h", "g", "m").alias("hub")), "hubs")
    members = _join_split(each.select("key", "doc", "n"), hubs, ["key"], "hub", "m", "doc").where("hub is not null")
    members = scratch.keep(members.select("key", "doc", "n", "hub.h", "hub.g", F.col("hub.m").alias("m")), "members")
    scratch.drop(each)
    scratch.drop(shared)
    release(docs.sparkSession)
    bits = profile.where("kind = 0 and a is not null and b > 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), "bits")

    def tested(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of those pairs that may link."""
        possible = scratch.keep(_possible(pairs, bits, percent), "possible")
        ends = scratch.keep(possible.select(F.col("a").alias("doc")).unionByName(possible.select(F.col("b").alias("doc"))).distinct(), "ends")
        sets = scratch.keep(_sets(docs, id_col, text_col, ends), "sets")
        out = scratch.keep(_verify(possible, sets, percent), "tested")
        scratch.drop(sets)
        scratch.drop(possible)
        release(docs.sparkSession)
        return out

    return Candidates(scratch, profile, one, placed, members, tested)


def _folded(profile: DataFrame) -> DataFrame:
    return profile.where("kind = 0 and a is not null and b > 0").select(F.col("a").alias("doc"), *[F.col("fold")[k].alias(f"w{k}") for k in range(FOLD_WORDS)])


def _may_link(percent: int):
    """Of columns n, w0, ... and n2, x0, ...: whether sizes and parities (folded) allow a link."""
    differ = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"x{k}"))) for k in range(FOLD_WORDS)), F.lit(0))
    return _close("n", "n2", percent) & (differ * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent))


def _met(rows: DataFrame, percent: int, apart: bool) -> DataFrame:
    """(a, b) of rows (key, m, doc, n, c, w0, ...) that share a key and may link, by sizes and parities; apart: of different c only.

    A key of many members is dealt out: its rows go in blocks, each of which
    meets all rows of the key, so no task holds more than a block against them.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("int")
    left = rows.withColumn("block", F.pmod(F.xxhash64("doc"), parts.cast("long")).cast("int"))
    other = rows.select(F.col("key").alias("key2"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("block2"), F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("c").alias("c2"), *[F.col(f"w{k}").alias(f"x{k}") for k in range(FOLD_WORDS)])
    wanted = (F.col("key") == F.col("key2")) & (F.col("block") == F.col("block2")) & (F.col("doc") < F.col("doc2")) & _may_link(percent)
    met = left.join(other, wanted & (F.col("c") != F.col("c2")) if apart else wanted)
    return met.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row; component_id: least id reachable by links (rows of one id are one document)."""
    own = _candidates(docs, id_col, text_col, percent)
    scratch, members, tested = own.scratch, own.members, own.tested
    stars = members.select("doc", "n", F.explode(F.array("h", "g")).alias("h")).where("doc <> h.doc").where(_close("n", "h.n", percent))
    stars = stars.select(F.least("doc", "h.doc").alias("a"), F.greatest("doc", "h.doc").alias("b")).distinct()
    tried = tested(stars)
    both = own.placed.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")  # an id with several texts
    same = own.placed.join(both.select("doc"), "doc", "left_semi").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    links = scratch.keep(tried.where("linked").select("a", "b").unionByName(same.where("a <> b")).distinct(), "links")
    comp = scratch.keep(connected_components(links, scratch), "comp")
    release(docs.sparkSession)

    # the rest: pairs of a key whose components differ, and whose parities (folded) allow a link
    named = members.select("key", "doc", "n", "m").join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", "m", F.coalesce("component", "doc").alias("c"))
    named = scratch.keep(named, "named")
    scratch.drop(members)
    mixed = scratch.keep(named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2").select("key", "m", F.lit(True).alias("mixed")), "mixed")
    open_ = _join_split(named, mixed, ["key"], "mixed", "m", "doc").where("mixed").join(_folded(own.profile), "doc")
    rest = _met(open_, percent, True).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    late = tested(rest).where("linked").select("a", "b")
    if late.limit(1).count():
        comp = scratch.keep(connected_components(links.unionByName(late), scratch), "comp2")

    out = own.placed.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    lost = own.one.where("doc is null").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return out.unionByName(lost)


@dataclass
class Links:
    """The whole join. pairs (a, b): linked classes, a < b, each by its least id; membership (id, n_shingles, class_id)."""

    pairs: DataFrame
    membership: DataFrame


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> Links:
    """All links between different sets, verified, as pairs of classes; documents of one class (not of the empty set) link with each other.

    Every pair of a key that sizes and parities allow is tested, so the cost
    follows the number of such pairs; copies stay in their class.
    """
    own = _candidates(docs, id_col, text_col, percent)
    listed = own.scratch.keep(own.members.select("key", "doc", "n", "m", F.col("doc").alias("c")).join(_folded(own.profile), "doc"), "listed")
    found = own.tested(_met(listed, percent, False)).where("linked").select("a", "b")
    known = own.placed.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"))
    lost = own.one.where("doc is null").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc").alias("class_id"))
    return Links(found, known.unionByName(lost))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, class_id, n_links): documents that each links with, counted by class without pairing copies."""
    own = links(docs, id_col, text_col, percent)
    sizes = own.membership.where("class_id is not null and n_shingles > 0").groupBy("class_id").agg(F.count_distinct(id_col).alias("copies"))
    ends = own.pairs.unionByName(own.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("others"))
    each = sizes.join(near, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return own.membership.join(each, "class_id", "left").select(id_col, "n_shingles", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows of docs whose id is the least of its component; all columns stay, rows without an id stay.

    Most rows are found to stay by a bit table of fixed size; only those that
    may go meet the exact list of ids to drop.
    """
    found = components(docs, id_col, text_col, percent)
    gone = Scratch(docs.sparkSession, "gone").keep(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias("doc")).distinct(), "gone")
    return without(docs, gone, [F.col(id_col).cast("long")])


def link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join itself: a row per document with its class and number of links."""
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _common_sql() -> str:
    """CTEs w (words), s (shingles), n (set sizes) and c (pairs with a common shingle) in DuckDB SQL, on the words themselves."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{low}'), '[^\x20\x09-\x0D]+')"
    return f"""w AS (SELECT doc_id, {words} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, list_slice(ws, p, p + {K - 1}) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS p FROM w WHERE len(ws) >= {K})
  UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND {K - 1})),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)"""


def links_sql(percent: int = PERCENT) -> str:
    """DuckDB SQL of link_report."""
    return f"""
WITH {_common_sql()},
 e AS (SELECT a, b, common = na.n AND common = nb.n AS same, 100 * common >= {percent} * (na.n + nb.n - common) AS linked FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(CASE WHEN same THEN b END), w.doc_id)) AS class_id, count(CASE WHEN linked THEN 1 END) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN e ON e.a = w.doc_id GROUP BY w.doc_id"""


def report_sql(percent: int = PERCENT) -> str:
    """DuckDB SQL of component_report: all pairs that share a shingle, then reachability."""
    return f"""
WITH RECURSIVE {_common_sql()},
 l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)),
 r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached)::BIGINT AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
