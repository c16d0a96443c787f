"""Dropping rows by a list of keys without moving the rows that stay.

A bit table over the hashes of the keys, of bounded size, is broadcast; rows
outside it stay where they are, and only the others meet the list itself in an
exact join. A list too long for the table is joined with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.llm.arrow import over_arrow

#: Bits of the table at most; a list of more than an eighth of it in keys is joined instead.
TABLE_BITS = 27


def fresh(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bit_table(hashes: DataFrame) -> tuple[np.ndarray, int] | None:
    """(bytes, bits) of a table of the hashes in the only column, about eight bits each; none if TABLE_BITS is too few."""
    n = hashes.count()
    bits = max(16, (8 * n).bit_length())
    if bits > TABLE_BITS:
        return None
    words = hashes.toDF("h").select(F.pmod("h", F.lit(1 << bits)).alias("s")).groupBy((F.col("s") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) as int)))").alias("m"))
    found = words.toArrow()  # 2^(TABLE_BITS - 6) rows at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return table.view(np.uint8), bits


def in_table(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    slots = hashes & np.int64((1 << bits) - 1)
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def without(rows: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows whose keys are not those of a row of gone (columns in the order of keys; null equals null). All columns stay."""
    names = [fresh(rows.columns, f"gone{k}") for k in range(len(keys))]
    gone = gone.toDF(*names)
    table = bit_table(gone.select(F.xxhash64(*names)))

    def absent(some: DataFrame) -> DataFrame:
        return some.join(gone, reduce(lambda x, y: x & y, [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]), "left_anti")

    if table is None:
        return absent(rows)
    held, at = rows.sparkSession.sparkContext.broadcast(table), len(rows.columns)

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_table(*held.value, batch.column(at).to_numpy())
                yield batch.filter(pa.array(hit == wanted)).select(list(range(at)))

        return over_arrow(rows.withColumn(fresh(rows.columns, "row_hash"), F.xxhash64(*keys)), run, rows.schema)

    return part(False).unionByName(absent(part(True)))
