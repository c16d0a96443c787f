"""Vector bin packing of token sequences by the dot-product heuristic, for instruction data.

A sequence has room for tokens, segments and loss-bearing tokens. The tokens of
a document that belong to its prompt bear no loss: those before ``prompt_col``,
or the first ``prompt_share`` of it. A sequence is filled with the item that
fits and has the greatest dot product of its demand and the room left, both as
shares of the limits. When none fits, the same product chooses a cut: from the
beginning of an item, where the prompt is, or from its end, as much as there is
room for in both; so answers longer than the loss limit are filled up with
prompts. Work goes by windows of documents in each partition; what a window
leaves and the open sequence are carried on, so memory is bounded and nothing
is shuffled. A sequence that nothing can fill up, as at a partition's end, is
cut into sequences whose lengths are powers of two, which need no padding.

Null text is empty text: the end id alone. Rows are packed as they come, so
null or repeated ids do no harm. Null prompts are 0. Extra columns are ignored.
Sequence ids are unique: the number of the partition and that in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.llm.arrow import over_arrow
from veclume.llm.textnum import blocks
from veclume.llm.tokens import encoder, ids_crc32

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
SEGMENTS = 128
#: Of the query: loss-bearing tokens of a sequence at most, and the prompt's share of a document.
LOSS = 1792
PROMPT_SHARE = 0.25
WINDOW_DOCS = 2048
WINDOW_TOKENS = 2_000_000
#: Items that a window leaves to the next one.
CARRIED = 256


@dataclass(frozen=True)
class Limits:
    tokens: int = CAPACITY
    segments: int = SEGMENTS
    loss: int = CAPACITY  # 1 at least


@dataclass
class Item:
    """A document: ids, of which those before prompt bear no loss."""

    doc: object
    ids: np.ndarray
    prompt: int = 0


@dataclass
class Packer:
    """Takes items; gives pieces (item, start, length, sequence, offset)."""

    limits: Limits = field(default_factory=Limits)
    sequence: int = 0
    items: list[Item] = field(default_factory=list)
    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))  # of each item: begin, end, end of the prompt
    open: list[tuple[Item, int, int]] = field(default_factory=list)
    used: int = 0
    loss: int = 0
    pieces: list[tuple[Item, int, int, int, int]] = field(default_factory=list)

    def add(self, items: list[Item]) -> None:
        self.items += items
        self.left = np.concatenate([self.left, np.array([[0, len(i.ids), i.prompt] for i in items], np.int64).reshape(-1, 3)])

    def _put(self, k: int, start: int, size: int) -> None:
        item = self.items[k]
        self.open.append((item, start, size))
        self.used += size
        self.loss += max(0, start + size - max(start, item.prompt))
        self.left[k, 0 if start == self.left[k, 0] else 1] = start + size if start == self.left[k, 0] else start

    def close(self) -> None:
        """End the open sequence: whole, or as sequences whose lengths are powers of two."""
        room, offset, left = 0, 0, self.used
        for item, start, size in self.open:
            while size:
                if not room:
                    room, offset = (left if left == self.limits.tokens else 1 << (left.bit_length() - 1)), 0
                take = min(size, room)
                self.pieces.append((item, start, take, self.sequence, offset))
                start, size, room, offset, left = start + take, size - take, room - take, offset + take, left - take
                self.sequence += not room
        self.open, self.used, self.loss = [], 0, 0

    def pack(self, carried: int = 0, carried_tokens: int = WINDOW_TOKENS) -> None:
        """Fill sequences until so many items, with so many tokens, are left at most."""
        most = self.limits
        while True:
            begin, end, prompt = self.left.T
            size = end - begin
            alive = int((size > 0).sum())
            if not alive or (alive <= carried and size.sum() <= carried_tokens):
                break
            if alive * 2 < len(size):
                keep = np.flatnonzero(size > 0)
                self.items, self.left = [self.items[k] for k in keep.tolist()], self.left[keep]
                continue
            room, room_loss = most.tokens - self.used, most.loss - self.loss
            if not room or len(self.open) >= most.segments:
                self.close()
                continue
            bare = np.clip(prompt - begin, 0, size)  # tokens of the prompt
            bearing = size - bare
            value, loss_value = room / most.tokens**2, room_loss / most.loss**2
            fits = (size > 0) & (size <= room) & (bearing <= room_loss)
            if fits.any():
                k = int(np.where(fits, size * value + bearing * loss_value, -1.0).argmax())
                self._put(k, int(begin[k]), int(size[k]))
                continue
            front = np.minimum(np.minimum(size, room), bare + room_loss)
            back = np.where(bearing > room_loss, min(room, room_loss), np.minimum(size, room))
            worth = np.concatenate([front * value + np.maximum(front - bare, 0) * loss_value, back * value + np.minimum(back, bearing) * loss_value])
            k = int(worth.argmax())
            if worth[k] <= 0:
                self.close()
            elif k < len(size):
                self._put(k, int(begin[k]), int(front[k]))
            else:
                k -= len(size)
                self._put(k, int(end[k] - back[k]), int(back[k]))

    def finished(self) -> list[tuple[Item, int, int, int, int]]:
        """Pieces of closed sequences."""
        done, self.pieces = self.pieces, []
        return done


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, limits: Limits = Limits(), prompt_col: str | None = None, prompt_share: float = 0.0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    id_type = docs.schema[id_col].dataType.simpleString()
    prompt = F.greatest(F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)), F.lit(0)) if prompt_col else F.lit(-1).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, held, tokens = encoder(tokenizer), Packer(limits), [], 0
        first = TaskContext.get().partitionId() << 36
        doc_type = None

        def rows(pieces: list[tuple[Item, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
            if not pieces:
                return
            cut = [p[0].ids[p[1] : p[1] + p[2]] for p in pieces]
            values = [[p[1] for p in pieces], [p[2] for p in pieces], [ids_crc32(c) for c in cut], [len(p[0].ids) for p in pieces], [first + p[3] for p in pieces], [p[4] for p in pieces], [max(0, p[1] + p[2] - max(p[1], p[0].prompt)) for p in pieces]]
            out = [pa.array([p[0].doc for p in pieces], doc_type), *[pa.array(v, pa.int64()) for v in values]]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            if with_ids:
                out.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for i, j, buf, offs in blocks(batch.column(1)):
                text = buf.tobytes()
                flat, at = enc.encode([text[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
                for k, (doc, p) in enumerate(zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(2).slice(i, j - i).to_pylist(), strict=True)):
                    ids = np.append(flat[at[k] : at[k + 1]], np.uint32(end_id))
                    held.append(Item(doc, ids, min(p, len(ids)) if p >= 0 else int(len(ids) * prompt_share)))
                    tokens += len(ids)
                if len(held) >= WINDOW_DOCS or tokens >= WINDOW_TOKENS:
                    packer.add(held)
                    packer.pack(CARRIED)
                    held, tokens = [], 0
                    yield from rows(packer.finished())
        packer.add(held)
        packer.pack()
        packer.close()
        yield from rows(packer.finished())

    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids
    return over_arrow(docs.select(id_col, text_col, prompt.alias("__prompt")), run, schema)


def pack_instructions(docs: DataFrame) -> DataFrame:
    """Documents whose first PROMPT_SHARE is a prompt, under a limit of LOSS loss-bearing tokens."""
    return pack(docs, limits=Limits(loss=LOSS), prompt_share=PROMPT_SHARE)


def packing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per piece, of documents as instruction data."""
    return pack_instructions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
