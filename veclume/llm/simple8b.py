"""Token-id files in Simple-8b: 64-bit words, a selector each, blocks with offsets.

A word's top four bits select how its other 60 are cut: k ids of w bits. One
selector stands for 240 zeros, one is an escape, after which a raw 64-bit word
follows. Ids come in blocks of ``BLOCK_IDS``; the last word of a block may be
part-filled, and each block's first word is known, so blocks decode
independently and all words of a selector decode in one vector operation.

File: header (8 x u64: magic, version, ids, documents, blocks, words, ids a
block, escapes), then document ids (i64), document lengths (u64), first word of
each block and the end (u64), words (u64); all little-endian.

``write_ids`` stores files as rows of a Parquet table, which any store that
Spark reaches can hold; ``read_ids`` reads it back. Documents come in ascending
id order (numeric; null first; repeats by the hash of their text). Null text is
empty text: the end id alone. Ids are integers; others raise. Extra columns are not read. An empty table gives
an empty table of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veclume.llm.arrow import over_arrow
from veclume.llm.scratch import Scratch
from veclume.llm.textnum import BLOCK_BYTES, U64, blocks
from veclume.llm.tokens import encoder, ids_crc32

TOKENIZER = "byte_bpe_50k.json"
BLOCK_IDS = 512
#: Ids of a file, about.
FILE_IDS = 500_000
#: Bytes of text in a range of ids, about, and ranges at most.
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000
MAGIC, VERSION = 0x5438_4253, 1
ZEROS, ESCAPE = 0, 1
#: Fixed values of the code: ids a word and bits an id, by selector.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _choice(v: np.ndarray, n_blocks: int, block_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the most ids that a word from there on takes within its block, and its selector.

    The greatest width in the window of each selector comes from those of two
    shorter windows; what lies beyond a block has width 0.
    """
    n, most = len(v), int(COUNTS.max())
    width = np.zeros((n_blocks, block_ids + most), np.uint8)
    flat = np.zeros(n_blocks * block_ids, np.uint8)
    flat[:n] = np.frexp(v.astype(np.float64))[1]
    width[:, :block_ids] = flat.reshape(n_blocks, block_ids)
    rest = np.full((n_blocks, 1), block_ids)
    rest[-1] = n - (n_blocks - 1) * block_ids
    left = np.maximum(rest - np.arange(block_ids)[None, :], 0).astype(np.uint16)
    windows = {1: width}

    def window(size: int) -> np.ndarray:
        if size not in windows:
            one = max(k for k in windows if 2 * k >= size) if any(2 * k >= size for k in windows) else max(windows)
            if 2 * one < size:
                window(2 * one)
                return window(size)
            wide = windows[one].copy()
            np.maximum(wide[:, : -(size - one)], windows[one][:, size - one :], out=wide[:, : -(size - one)])
            windows[size] = wide
        return windows[size]

    own = width[:, :block_ids]
    take, sel = np.ones((n_blocks, block_ids), np.uint16), np.where(own <= WIDTHS[-1], len(COUNTS) - 1, ESCAPE).astype(np.uint8)
    for s in [k for k in range(len(COUNTS) - 2, 1, -1)] + [ZEROS]:
        fits = window(int(COUNTS[s]))[:, :block_ids] <= WIDTHS[s]
        more = np.minimum(left, np.uint16(COUNTS[s]))
        fits &= more > take
        np.copyto(take, more, where=fits)
        sel[fits] = s
        for k in [k for k in windows if 2 * k < COUNTS[s] // 2]:
            del windows[k]
    return take.reshape(-1)[:n].astype(np.int64), sel.reshape(-1)[:n]


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, first word of each block and the end, number of escapes)."""
    v = np.asarray(ids, U64)
    n = len(v)
    n_blocks = -(-n // block_ids)
    if not n:
        return np.zeros(0, U64), np.zeros(1, U64), 0
    end = np.minimum((np.arange(n) // block_ids + 1) * block_ids, n)
    take, sel = _choice(v, n_blocks, block_ids)
    position = np.arange(0, n, block_ids)
    limit = end[position]
    taken = []
    while position.size:
        taken.append(position)
        position = position + take[position]
        more = position < limit
        position, limit = position[more], limit[more]
    begin = np.sort(np.concatenate(taken))
    used = sel[begin]
    escape = used == ESCAPE
    place = np.cumsum(1 + escape) - (1 + escape)
    words = np.zeros(len(begin) + int(escape.sum()), U64)
    padded = np.concatenate([v, np.zeros(int(COUNTS.max()), U64)])
    for s in np.unique(used):
        mine = np.flatnonzero(used == s)
        word = np.full(len(mine), U64(s) << U64(60))
        if s == ESCAPE:
            words[place[mine] + 1] = v[begin[mine]]
        elif s != ZEROS:
            count = take[begin[mine]]
            for j in range(COUNTS[s]):
                word |= np.where(j < count, padded[begin[mine] + j], U64(0)) << U64(WIDTHS[s] * j)
        words[place[mine]] = word
    first = np.searchsorted(begin, np.arange(n_blocks) * block_ids)
    return words, np.concatenate([place[first], [len(words)]]).astype(U64), int(escape.sum())


def decode(words: np.ndarray, first: np.ndarray, n: int, escapes: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids of ``encode``."""
    if not n:
        return np.zeros(0, U64)
    first = first.astype(np.int64)
    heads = np.ones(len(words), bool)
    if escapes:  # raw words are no selectors: step through all blocks at once
        heads[:] = False
        position, limit = first[:-1].copy(), first[1:].copy()
        while position.size:
            heads[position] = True
            position = position + 1 + ((words[position] >> U64(60)) == ESCAPE)
            more = position < limit
            position, limit = position[more], limit[more]
    at = np.flatnonzero(heads)
    sel = (words[at] >> U64(60)).astype(np.int64)
    block = np.searchsorted(first, at, "right") - 1
    total = np.cumsum(COUNTS[sel]) - COUNTS[sel]
    lead = np.searchsorted(at, first[:-1])
    inside = total - total[lead][block]
    count = np.minimum(COUNTS[sel], np.minimum((block + 1) * block_ids, n) - block * block_ids - inside)
    begin = block * block_ids + inside
    out = np.zeros(n, U64)
    for s in np.unique(sel):
        if s == ZEROS:
            continue
        mine = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[begin[mine]] = words[at[mine] + 1]
            continue
        mask = U64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            use = mine[count[mine] > j]
            out[begin[use] + j] = (words[at[use]] >> U64(WIDTHS[s] * j)) & mask
    return out


def write_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    words, first, escapes = encode(ids, block_ids)
    header = np.array([MAGIC, VERSION, len(ids), len(doc_ids), len(first) - 1, len(words), block_ids, escapes], "<u8")
    return b"".join(x.tobytes() for x in (header, doc_ids.astype("<i8"), lengths.astype("<u8"), first.astype("<u8"), words.astype("<u8")))


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a file."""
    magic, version, n, docs, n_blocks, n_words, block_ids, escapes = np.frombuffer(data, "<u8", 8).tolist()
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a Simple-8b token file")
    at = 64
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    first = np.frombuffer(data, "<u8", n_blocks + 1, at)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * (n_blocks + 1))
    return doc_ids, lengths, decode(words, first, n, escapes, block_ids)


FILE_SCHEMA = "part long, seq long, ids_before long, n_ids long, n_docs long, nulls long, data binary"


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, id, tie, packed text): part grows with the id, a partition each; texts travel compressed."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids must be integers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES), MOST_RANGES)
    levels = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    cuts = np.unique(np.array(docs.select(F.percentile_approx(F.col(id_col).cast("long"), levels, 10 * n)).first()[0] or [], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc = batch.column(0)
            part = np.searchsorted(cuts, doc.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right") if len(cuts) else np.zeros(len(doc), np.int64)
            for i, j, buf, offs in blocks(batch.column(2)):
                raw = memoryview(buf)
                packed = [pack.compress(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[i:j].astype(np.int64)), doc.slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(packed, pa.binary())], ["part", "id", "tie", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return over_arrow(rows, run, "part long, id long, tie long, packed binary").repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "id", "tie")


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None, file_ids: int = FILE_IDS) -> None:
    """Encode texts and write their files, in ascending id order, as a Parquet table at path."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unpack = encoder(tokenizer), zstandard.ZstdDecompressor()
        docs_, lens, ids, held, nulls, seq, before, part = [], [], [], 0, 0, 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs_, lens, ids, held, nulls, seq, before
            if docs_:
                flat = np.concatenate(ids)
                data = write_file(np.array(docs_, np.int64), np.array(lens, np.int64), flat)
                yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "ids_before": before, "n_ids": len(flat), "n_docs": len(docs_), "nulls": nulls, "data": data}], pa.schema([*[(c, pa.int64()) for c in ("part", "seq", "ids_before", "n_ids", "n_docs", "nulls")], ("data", pa.binary())]))
                seq, before = seq + 1, before + len(flat)
            docs_, lens, ids, held, nulls = [], [], [], 0, 0

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [unpack.decompress(x.as_buffer()).decode() for x in batch.column(3)], strict=True))
            i = 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and rows[j][0] == rows[i][0] and (j == i or size < BLOCK_BYTES):
                    size += len(rows[j][2])
                    j += 1
                if rows[i][0] != part:
                    yield from flush()
                    part, seq, before = rows[i][0], 0, 0
                flat, offs = enc.encode([r[2] for r in rows[i:j]])
                for (_, doc, _), a, b in zip(rows[i:j], offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    own = np.append(flat[a:b], np.uint32(end_id))
                    nulls += doc is None  # nulls sort first
                    docs_.append(doc or 0)
                    lens.append(len(own))
                    ids.append(own)
                    held += len(own)
                    if held >= file_ids:
                        yield from flush()
                i = j
        yield from flush()

    over_arrow(_ordered(docs, id_col, text_col), run, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files; start: ids of all documents before."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row a range of ids: as many as partitions when the files were written
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    begin, at = [], 0
    for r in totals:
        begin.append((r.part, at))
        at += r.n
    starts = dict(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                part, before, nulls = (batch.column(c)[r].as_py() for c in (0, 2, 5))
                doc_ids, lengths, ids = read_file(batch.column(6)[r].as_buffer())
                end = np.cumsum(lengths)
                low = ids.astype("<u4")
                cut = [low[a:b] for a, b in zip((end - lengths).tolist(), end.tolist(), strict=True)]
                out = [pa.array([None] * nulls + doc_ids[nulls:].tolist(), pa.int64()), pa.array(starts[part] + before + end - lengths), pa.array(lengths), pa.array([ids_crc32(c) for c in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return over_arrow(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and returns the contract's row per document, as read back."""
    path = f"{Scratch(spark, 'tokens').root}/files"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path)
