"""Exact duplicates by counting quotient filters.

Texts are equal when they are the same after white space is deleted. Each partition of fingerprints becomes a counting
quotient filter: a fingerprint's first bits say which block, the next which quotient of the block, the last 32 are the
remainder. A block keeps which quotients occur, a bit at the end of each quotient's run, and the remainders of
all runs in order with their counts, so two filters of a block merge by their sorted remainders and lose nothing. Quotients are
a bitmap where many occur, and a sorted list while they are few, so a filter takes bytes for its entries, not for the block,
however many tasks and blocks there are. Blocks are merged apart from each other; more fingerprints make more blocks, not
larger ones, and as fingerprints have 64 bits, shorter remainders beyond 2 ** 14 blocks.

Fingerprints with a count above one go on to byte verification: their normalised texts are grouped as they are, copies
within a task first, and only texts that really occur twice make a group. Rows of such fingerprints are summed by text before
they are shuffled, and a group with more than a thousandth of all rows, a thousand groups at most, is joined by broadcast. The
row with the most code points in the original text stays, then the smallest doc_id (null last), and of rows that repeat in both, one.

Results: null counts as empty, all empty texts are one group, an empty table gives an empty result. Very long texts are rows
like others, a text at a time. Other columns are not read. What tasks get to look up candidates is a bitmap of at most
2 ** MAP_BITS bits (16 MB); beyond some 10 ** 8 repeated fingerprints more texts are candidates, which changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm import arrays
from dishlens.llm.arrays import U
from dishlens.sources.sinks import materialize

WHITE = b" \t\n\x0b\x0c\r"
QUOTIENT_BITS, REMAINDER_BITS, MOST_BLOCK_BITS, MAP_BITS = 18, 32, 26, 27
#: Fingerprints that a block holds on average, and that a task gathers for one filter.
PER_BLOCK, AT_ONCE = 1 << 16, 1 << 20
#: A group with more than one row in so many of all is joined by broadcast.
HOT_SHARE = 1_000
FEATURES = "doc_key long, text_key long, fingerprint long, text_sha256 string, n_chars long"
FILTER = "block int, occupied binary, run_ends binary, remainders binary, counts binary"


def normalised(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes().translate(None, WHITE) if value.is_valid else b""


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalised(v) for v in batch.column("text")]
        marks = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], U)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_key"),
            batch.column("text_key"),
            pa.array(marks.view(np.int64)),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64()),
        ], names=["doc_key", "text_key", "fingerprint", "text_sha256", "n_chars"])


def encode_block(quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """A block of a filter from entries sorted by quotient and remainder."""
    ends = np.append(quotients[1:] != quotients[:-1], True)
    present = quotients[ends]
    if 4 * len(present) < 1 << QUOTIENT_BITS - 3:
        occupied = present.astype("<u4").tobytes()
    else:
        bitmap = np.zeros(1 << QUOTIENT_BITS, bool)
        bitmap[present] = True
        occupied = np.packbits(bitmap).tobytes()
    return occupied, np.packbits(ends).tobytes(), remainders.astype("<u4").tobytes(), counts.astype("<u8").tobytes()


def decode_block(occupied: bytes, run_ends: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries again: the k-th run belongs to the k-th quotient that occurs. A list is always shorter than the bitmap."""
    rest, count = np.frombuffer(remainders, "<u4"), np.frombuffer(counts, "<u8")
    ends = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=len(rest)).astype(bool)
    if len(occupied) < 1 << QUOTIENT_BITS - 3:
        present = np.frombuffer(occupied, "<u4").astype(np.int64)
    else:
        present = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    run = np.cumsum(ends) - ends
    return present[run], rest, count


def merge_blocks(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of several filters of one block: equal remainders of a quotient become one, with the sum of their counts."""
    quotient, remainder, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((remainder, quotient))
    quotient, remainder, count = quotient[order], remainder[order], count[order]
    first = arrays.starts_of_runs(quotient, remainder)
    return quotient[first], remainder[first], np.add.reduceat(count, first) if len(first) else count


def remainder_bits(block_bits: int) -> int:
    """What a fingerprint of 64 bits leaves beside block and quotient, at most REMAINDER_BITS."""
    return min(REMAINDER_BITS, 64 - QUOTIENT_BITS - block_bits)


def _cut(marks: np.ndarray, block_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, quotient and remainder of fingerprints, from their highest bits."""
    rest = remainder_bits(block_bits)
    unused = 64 - block_bits - QUOTIENT_BITS - rest
    top = marks >> U(unused)
    remainder = (top & U((1 << rest) - 1)).astype(np.uint32)
    quotient = ((top >> U(rest)) & U((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
    return (top >> U(rest + QUOTIENT_BITS)).astype(np.int64), quotient, remainder


def _slots(marks: np.ndarray, block_bits: int) -> np.ndarray:
    """The place of a fingerprint's block and quotient in the bitmap of candidates."""
    block, quotient, _ = _cut(marks, block_bits)
    return ((block << QUOTIENT_BITS) | quotient) >> max(0, block_bits + QUOTIENT_BITS - MAP_BITS)


def _marked(table: np.ndarray, marks: np.ndarray, block_bits: int) -> np.ndarray:
    slot = _slots(marks, block_bits)
    return (table[slot >> 6].view(U) >> (slot & 63).astype(U)) & U(1) > 0


def _filters(block_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fingerprint").to_numpy().view(U))
            n += batch.num_rows
            if n >= AT_ONCE:
                yield _filter(np.concatenate(held), block_bits)
                held, n = [], 0
        if n:
            yield _filter(np.concatenate(held), block_bits)

    return build


def _filter(marks: np.ndarray, block_bits: int) -> pa.RecordBatch:
    marks = np.sort(marks)
    block, quotient, remainder = _cut(marks, block_bits)
    first = arrays.starts_of_runs(block, quotient, remainder)
    count = np.diff(np.append(first, len(marks))).astype(np.uint64)
    block, quotient, remainder = block[first], quotient[first], remainder[first]
    heads = arrays.starts_of_runs(block)
    ends = np.append(heads[1:], len(block))
    coded = [encode_block(quotient[a:b], remainder[a:b], count[a:b]) for a, b in zip(heads, ends, strict=True)]
    columns = [pa.array(c, pa.binary()) for c in zip(*coded, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[heads].astype(np.int32)), *columns], names=["block", "occupied", "run_ends", "remainders", "counts"])


def _repeated(group: pa.Table) -> pa.Table:
    """The merged block's quotients with an entry that counts above one."""
    parts = [decode_block(*(group.column(c)[i].as_buffer().to_pybytes() for c in ("occupied", "run_ends", "remainders", "counts"))) for i in range(group.num_rows)]
    quotient, _, count = merge_blocks(parts)
    found = np.unique(quotient[count > 1])
    slot = (group.column("block")[0].as_py() << QUOTIENT_BITS) | found.astype(np.int64)
    return pa.table({"slot": pa.array(slot, pa.int64())})


def _quotient_map(slots: DataFrame, block_bits: int) -> np.ndarray:
    """One bit for each block and quotient with a repeated fingerprint, folded to at most MAP_BITS bits."""
    drop = max(0, block_bits + QUOTIENT_BITS - MAP_BITS)
    bits = block_bits + QUOTIENT_BITS - drop
    words = (
        slots.select(F.shiftright("slot", drop).alias("slot"))
        .select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = np.zeros(max(1, (1 << bits) // 64), np.int64)
    for batch in words.toArrow().to_batches():
        table[batch.column("at").to_numpy()] = batch.column("bits").to_numpy()
    return table


def _candidates(block_bits: int, table):
    """Normalised texts whose fingerprint may be repeated."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(v) for v in batch.column("text")]
            marks = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], U)
            at = np.flatnonzero(_marked(table.value, marks, block_bits))
            yield pa.RecordBatch.from_arrays([pa.array(marks[at].view(np.int64)), pa.array([texts[i] for i in at], pa.binary())], names=["mark", "body"])

    return find


def _candidate_rows(block_bits: int, table):
    """The features of rows whose fingerprint may be repeated."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(table.value, batch.column("fingerprint").to_numpy().view(U), block_bits)))

    return find


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_key, text_key, doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(text).alias("text"), arrays.document_key(doc_id).alias("doc_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    features = texts.select("doc_key", "text_key", "text").mapInArrow(_features, FEATURES)
    features = materialize(features.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    total = features.count()
    block_bits = min(MOST_BLOCK_BITS, max(0, int(np.ceil(np.log2(max(total, 1) / PER_BLOCK)))))
    slots = features.select("fingerprint").mapInArrow(_filters(block_bits), FILTER).groupBy("block").applyInArrow(_repeated, "slot long")
    table = docs.sparkSession.sparkContext.broadcast(_quotient_map(slots, block_bits))
    same = (
        texts.select("text")
        .mapInArrow(_candidates(block_bits, table), "mark long, body binary")
        # no join with marks: it would deal whole texts by their mark first, and a text that occurs twice has a repeated mark
        .groupBy("mark", "body")
        .count()
        .where("count > 1")
        .select(F.sha2("body", 256).alias("text_sha256"))
    )
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_key").alias("rank"), F.bitwise_not("row").alias("row"))).alias("best")
    # candidates are summed by text in their tasks, and only those that the bytes confirm are groups
    rows = features.mapInArrow(_candidate_rows(block_bits, table), features.schema)
    groups = rows.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups.join(same, "text_sha256", "left_semi"), "groups")
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > total))  # fewer than HOT_SHARE groups
    rest = features.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(groups, "text_sha256", "left")
    joined = features.join(hot, "text_sha256").unionByName(rest)
    keep_key = F.coalesce(F.bitwise_not("best.rank"), F.col("doc_key"))
    known = lambda key: F.when(key != arrays.LAST_ID, key)
    return joined.select(
        "doc_key",
        "text_key",
        known(F.col("doc_key")).alias("doc_id"),
        known(keep_key).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.bitwise_not("best.row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = materialize(decisions(docs, doc_id, text), "decisions")
    dropped = found.where("NOT kept").select("doc_key", "text_key")
    kept = found.where("kept").select("doc_key", "text_key")
    # rows that repeat in id and text have one key: one is kept, the others are dropped
    again = kept.join(dropped, ["doc_key", "text_key"], "left_semi").distinct()
    left, right = arrays.unused(docs, "doc_key"), arrays.unused(docs, "text_key")
    keyed = docs.withColumns({left: arrays.document_key(doc_id), right: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    named = lambda df: df.select(F.col("doc_key").alias(left), F.col("text_key").alias(right))
    rest = keyed.join(named(dropped.distinct()), [left, right], "left_anti")
    if not again.isEmpty():
        rest = rest.unionByName(keyed.join(named(again), [left, right], "left_semi").dropDuplicates([left, right]))
    return rest.select(docs.columns)
