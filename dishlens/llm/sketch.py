"""A count-min sketch of 64-bit keys kept in parts, made per task, merged by Spark and used to find keys that may occur twice.

The sketch has one row of CELLS cells or more a key, however many keys there are, so it is as good for a large input as for a
small one.
Nobody holds it whole: a task hands out the cells its keys fall into, sorted and packed, by part of the row, and a part's lists
are merged where the part is. A part takes some PART_KEYS keys, whatever the number of tasks. A key's estimate is its cell's
count, so it is never under the true count: a key that occurs twice is always found, and a key that occurs once is found if
another one fell into its cell, one in CELLS.

What goes to every task is a bitmap of the cells that count 2 or more only, with two places for each: BITS bits a cell, at most
2 ** MAX_BITS (64 MB). Its size follows the keys that repeat, not all keys; a single key passes it by chance if both its places are
taken, one in (BITS / 2) ** 2 or less often, and more often beyond 2 ** MAX_BITS / BITS cells that repeat, which costs time in the
second pass and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm.arrays import BASE, U, mix, starts_of_runs
from dishlens.sources.sinks import materialize

#: Cells a key, and bits of the bitmap for each cell that counts twice.
CELLS, BITS = 512, 32
#: A size is given as the bits of so many times fewer cells: SIZE cells a key.
FINER = 6
SIZE = CELLS >> FINER
#: Least and most bits of a size, and of a place in the bitmap.
MIN_SIZE_BITS, MAX_SIZE_BITS, MIN_BITS, MAX_BITS, MAX_MAP_BITS = 16, 56, 22, 29, 27
#: Keys of a part; up to 2 ** PART_BITS parts, then larger parts up to MOST_KEYS, then more parts again.
PART_KEYS, PART_BITS, MOST_KEYS = 1 << 20, 12, 1 << 23
#: Keys a task counts before it hands out what it has.
KEYS_AT_ONCE = 2_000_000
SCHEMA = "part int, cells binary, counts binary"


def bits_for(keys: float) -> int:
    """The size for an expected number of keys."""
    return int(np.clip(np.ceil(np.log2(max(SIZE * keys, 1))), MIN_SIZE_BITS, MAX_SIZE_BITS))


def part_bits(bits: int) -> int:
    """Bits of a part's number."""
    keys = bits - int(np.log2(SIZE))
    return max(0, min(keys - int(np.log2(PART_KEYS)), PART_BITS), keys - int(np.log2(MOST_KEYS)))


def places(cells: np.ndarray, bits: int, width: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Both places of each cell in a bitmap of 2 ** ``width`` bits, the second one in the same stretch."""
    first = cells >> U(FINER + bits - width)
    return first, (first & ~U(stretch - 1)) | (mix(cells ^ U(BASE)) & U(stretch - 1))


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix(keys + U(BASE)) >> U(64 - FINER - bits)


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers, as compressed steps, the bytes of one place after another."""
    steps = np.diff(values, prepend=U(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(value: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(value), np.uint8)
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view("<u8").reshape(-1), dtype=U)


def _parts(keys: list[np.ndarray], bits: int, own: int) -> pa.RecordBatch:
    """Cells and whether they count more than 1 (lowest bit), ascending, one record for each part that has any, and those counts."""
    cells, count = np.unique(cells_of(np.concatenate(keys), bits), return_counts=True)
    part = (cells >> U(FINER + bits - own)).astype(np.int32)
    values = (cells << U(1)) | (count > 1).astype(U)
    heads = np.append(starts_of_runs(part), len(part))
    cuts = list(zip(heads[:-1], heads[1:], strict=True))
    packed = [pack(values[a:b]) for a, b in cuts]
    counts = [zstandard.compress(c[c > 1].astype("<u4").tobytes(), 1) for c in (count[a:b] for a, b in cuts)]
    columns = [pa.array(part[heads[:-1]]), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "cells", "counts"])


def _merging(most: int) -> Callable[[pa.Table], pa.Table]:
    def merge(group: pa.Table) -> pa.Table:
        """The cells of a part that count 2 or more over all tasks, and those that count more than ``most``."""
        values, counts = [], []
        for cells, more in zip(group.column("cells"), group.column("counts"), strict=True):
            values.append(unpack(cells.as_buffer().to_pybytes()))
            counts.append(np.ones(len(values[-1]), np.int64))
            counts[-1][(values[-1] & U(1)) > 0] = np.frombuffer(zstandard.decompress(more.as_buffer().to_pybytes()), "<u4")
        cells, count = np.concatenate(values) >> U(1), np.concatenate(counts)
        order = np.argsort(cells)
        cells, count = cells[order], count[order]
        heads = starts_of_runs(cells)
        total = np.add.reduceat(count, heads) if len(heads) else count
        found, many = cells[heads[total > 1]], cells[heads[total > most]]
        return pa.table({
            "part": group.column("part")[:1], "n": pa.array([len(found)], pa.int64()),
            "cells": pa.array([pack(found)], pa.binary()), "many": pa.array([many.view(np.int64).tolist()], pa.list_(pa.int64())),
        })

    return merge


def repeated_keys(texts: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """A bitmap of the cells that count 2 or more, over the keys that ``keys`` finds in the batches of ``texts``."""
    return counted_keys(texts, keys, bits, np.iinfo(np.int64).max)[0]


def counted_keys(texts: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, most: int) -> tuple[Broadcast, DataFrame]:
    """The same, and the cells (a column ``cell`` of longs) that count more than ``most``."""
    own = part_bits(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for found in keys(batch):
                held.append(found)
                n += len(found)
                if n >= KEYS_AT_ONCE:
                    yield _parts(held, bits, own)
                    held, n = [], 0
        if n:
            yield _parts(held, bits, own)

    parts = texts.mapInArrow(count, SCHEMA).groupBy("part").applyInArrow(_merging(most), "part int, n long, cells binary, many array<long>")
    parts = materialize(parts, "sketch")
    return spread(parts, bits, own), parts.select(F.explode("many").alias("cell"))


def spread(repeated: DataFrame, bits: int, own: int) -> Broadcast:
    """The cells as a bitmap, of the size given above, to every task; a part is a stretch of it."""
    n = repeated.agg(F.sum("n")).first()[0] or 0
    width = int(np.clip(np.ceil(np.log2(max(BITS * n, 1))), max(MIN_BITS, own + 3), max(MAX_BITS, own + 3)))
    width = min(width, bits + FINER)
    stretch = 1 << (width - own)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("cells"), strict=True):
                one = np.zeros(stretch, bool)
                for slot in places(unpack(value.as_buffer().to_pybytes()), bits, width, stretch):
                    one[(slot & U(stretch - 1)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(one, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    table = np.zeros((1 << own, stretch // 8), np.uint8)
    for row in repeated.where("n > 0").select("part", "cells").mapInArrow(flags, "part int, bits binary").toLocalIterator():
        table[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return repeated.sparkSession.sparkContext.broadcast(table.reshape(-1))


def may_repeat(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether a key's estimate may be 2 or more."""
    width = (len(table) * 8).bit_length() - 1
    taken = lambda slot: (table[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 > 0
    first, second = places(cells_of(keys, bits), bits, width, 1 << (width - part_bits(bits)))
    found = taken(first)
    at = np.flatnonzero(found)
    found[at] = taken(second[at])
    return found


def bitmap(df: DataFrame, column: str) -> tuple[int, Broadcast]:
    """A bit for the hash of each value of a column of longs: 16 bits a value, at most 2 ** MAX_MAP_BITS (16 MB)."""
    bits = int(np.clip(np.ceil(np.log2(max(16 * df.count(), 1))), 6, MAX_MAP_BITS))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(mix(batch.column(0).to_numpy().view(U)) >> U(64 - bits))
            at = slots >> U(6)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            found = np.bitwise_or.reduceat(U(1) << (slots & U(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(at[first].view(np.int64)), pa.array(found.view(np.int64))], names=["at", "bits"])

    merged = df.select(column).mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for batch in merged.toArrow().to_batches():
        table[batch.column("at").to_numpy()] = batch.column("bits").to_numpy()
    return bits, df.sparkSession.sparkContext.broadcast(table.view(U))


def in_bitmap(table: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Whether a value may be among those of the column."""
    slots = mix(values.view(U)) >> U(64 - bits)
    return (table[(slots >> U(6)).astype(np.int64)] >> (slots & U(63))) & U(1) > 0
