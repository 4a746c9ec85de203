"""Removal of passages that an earlier document has too, by windows of words.

1. Count-min prefilter. Every window of 13 words is keyed by the least hash of the runs of 5 words in it, so that a few
   neighbouring windows have one key, and equal windows always have the same. Tasks count the keys of each document in
   sketches, Spark merges them (``sketch``). An estimate is never under the number of documents that have a window.
2. Only windows estimated repeated are grouped exactly, by key and a 64-bit hash of the whole window. A task first groups
   what it has itself: windows that it also has in an earlier document are settled there, and only those of the earliest
   document go on, so a window that a third of all documents have is sent once a task, not once a document. Windows go
   as runs; keys with very many runs are dealt anew by single windows.
3. The words covered are gathered by document.

Results: null or empty text has no words and keeps the hash of the empty string. Rows that share a doc_id do not cover each
other; a null doc_id comes after all others. Repeated rows each get a result. Very long texts are worked on by themselves, a
chunk each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm import arrays, sketch
from dishlens.llm.arrays import U
from dishlens.sources.sinks import materialize

WINDOW, GRAM = 13, 5
#: Windows a task holds before it groups them.
WINDOWS_AT_ONCE = 500_000
#: Windows of one task of the exact step, and runs of one key beyond which single windows are dealt.
WINDOWS_PER_TASK, RUNS_PER_KEY = 250_000, 50_000
RUNS = "doc_key long, text_key long, route long, position int, n int, hashes binary"
SPANS = "doc_key long, text_key long, position int, n int"
FINAL_EXTRA = "n_words long, n_removed long, kept string"


def _windows(column: pa.Array, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunk by chunk: row, position, key and hash of every window."""
    for first, data, offsets in arrays.chunks(column):
        starts, ends, doc = arrays.word_spans(data, offsets)
        words = arrays.span_hashes(data, starts, ends)
        hashes = arrays.rolling(words, width)
        if not len(hashes):
            continue
        keys = arrays.slide(arrays.rolling(words, gram), width - gram + 1)
        at = np.flatnonzero(doc[: len(hashes)] == doc[width - 1 :])
        begin = np.searchsorted(doc, np.arange(len(offsets) - 1))
        yield doc[at] + first, at - begin[doc[at]], keys[at], hashes[at]


def _keys(width: int, gram: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Each key once for each row that has it."""
        for row, _, key, _ in _windows(batch.column("text"), width, gram):
            at = arrays.starts_of_runs(row, key)
            row, key = row[at], key[at]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            yield key[arrays.starts_of_runs(row, key)]

    return keys


def _least(doc: np.ndarray, key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each window, the least document that has it."""
    order = np.lexsort((doc, hashes, key))
    heads = arrays.starts_of_runs(key[order], hashes[order])
    least = np.empty(len(doc), np.int64)
    least[order] = np.repeat(doc[order][heads], np.diff(np.append(heads, len(order))))
    return least


def _candidates(bits: int, table, width: int, gram: int) -> Callable:
    """Windows estimated repeated: those covered by a document of the same task as spans, the others as runs to ask about."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, text, row, position, key, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
        covered = doc > _least(doc, key, hashes)
        # rows come in order and positions within them too
        done = np.flatnonzero(covered)
        first, last = arrays.runs_of_positions(row[done], position[done])
        first, last = done[first], done[last]
        yield _run_batch(doc[first], text[first], None, position[first], position[last] - position[first] + 1, None)
        ask = np.flatnonzero(~covered)
        row, position, key = row[ask], position[ask], key[ask]
        new = np.ones(len(ask), bool)
        new[1:] = (row[1:] != row[:-1]) | (position[1:] != position[:-1] + 1) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(ask)))
        yield _run_batch(doc[ask][first], text[ask][first], key[first], position[first], n, hashes[ask])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, rows = [], 0, 0
        for batch in batches:
            doc = batch.column("doc_key").to_numpy()
            text = batch.column("text_key").to_numpy()
            for row, position, key, hashes in _windows(batch.column("text"), width, gram):
                at = np.flatnonzero(sketch.may_repeat(table.value, key, bits))
                if len(at):
                    held.append((doc[row[at]], text[row[at]], row[at] + rows, position[at], key[at], hashes[at]))
                    n += len(at)
                if n >= WINDOWS_AT_ONCE:
                    yield from settle(held)
                    held, n = [], 0
            rows += batch.num_rows
        if n:
            yield from settle(held)

    return find


def _run_batch(doc, text, route, position, n, hashes) -> pa.RecordBatch:
    payload = pa.nulls(len(doc), pa.binary()) if hashes is None else arrays.binaries(hashes.view(np.uint8), n * 8)
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()),
        pa.array(text, pa.int64()),
        pa.nulls(len(doc), pa.int64()) if route is None else pa.array(route.view(np.int64)),
        pa.array(position.astype(np.int32)),
        pa.array(np.asarray(n).astype(np.int32)),
        payload,
    ], names=["doc_key", "text_key", "route", "position", "n", "hashes"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs as single windows, dealt by the hash of the window."""
    for batch in batches:
        data, sizes = arrays.binary_bytes(batch.column("hashes"))
        n = sizes // 8
        each = np.repeat(np.arange(batch.num_rows), n)
        hashes = data.view(U) if len(data) else np.zeros(0, U)
        within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        position = batch.column("position").to_numpy()[each] + within
        yield _run_batch(batch.column("doc_key").to_numpy()[each], batch.column("text_key").to_numpy()[each], hashes, position, np.ones(len(each), int), hashes)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of the keys of one task: spans of windows that an earlier document has."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    data, sizes = arrays.binary_bytes(rows.column("hashes").combine_chunks() if rows.num_rows else pa.array([], pa.binary()))
    n = sizes // 8
    each = np.repeat(np.arange(rows.num_rows), n)
    doc, text = rows.column("doc_key").to_numpy(), rows.column("text_key").to_numpy()
    hashes, key = np.ascontiguousarray(data).view(U), rows.column("route").to_numpy()[each]
    at = np.flatnonzero(doc[each] > _least(doc[each], key, hashes))
    position = (rows.column("position").to_numpy()[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))[at]
    each = each[at]
    first, last = arrays.runs_of_positions(each, position)
    yield pa.RecordBatch.from_arrays([
        pa.array(doc[each[first]], pa.int64()),
        pa.array(text[each[first]], pa.int64()),
        pa.array(position[first].astype(np.int32)),
        pa.array((position[last] - position[first] + 1).astype(np.int32)),
    ], names=["doc_key", "text_key", "position", "n"])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and what stands for a row in the joins: repeated rows have the same key and the same result."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        arrays.document_key(doc_id).alias("doc_key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
    )


def partitions_for(total: int, each: int) -> int:
    return max(1, -(-int(total or 0) // each))


def covered_spans(rows: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of ``n`` windows from ``position`` on that an earlier document has: doc_key, text_key, position, n."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(total / 30)
    table = sketch.repeated_keys(rows.select("text"), _keys(width, gram), bits)
    found = materialize(rows.select("doc_key", "text_key", "text").mapInArrow(_candidates(bits, table, width, gram), RUNS), "windows")
    ask = found.where("route IS NOT NULL")
    tasks = partitions_for(ask.agg(F.sum("n")).first()[0], WINDOWS_PER_TASK)
    hot = ask.groupBy("route").count().where(F.col("count") > RUNS_PER_KEY).select("route")
    if not hot.isEmpty():
        single = ask.join(hot, "route", "left_semi").select(found.columns).mapInArrow(_split, RUNS)
        ask = ask.join(hot, "route", "left_anti").select(found.columns).unionByName(single)
    settled = ask.repartition(tasks, "route").mapInArrow(_resolve, SPANS)
    return found.where("route IS NULL").select("doc_key", "text_key", "position", "n").unionByName(settled)


def _kept(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n_words.append(len(words))
            if spans.is_valid:
                drop = np.zeros(len(words) + 1, np.int32)
                first = spans.values.field("position").to_numpy()
                np.add.at(drop, first, 1)
                np.add.at(drop, first + spans.values.field("n").to_numpy() + width - 1, -1)
                words = [w for w, d in zip(words, (np.cumsum(drop) > 0).tolist(), strict=False) if not d]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def dedupe_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, and kept, the remaining words joined by one space."""
    rows = keyed(docs, doc_id, text)
    spans = covered_spans(rows, width, gram).groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("position", "n")).alias("spans"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.join(spans, ["doc_key", "text_key"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(lambda batches: _kept(batches, width), f"doc_id {id_type}, {FINAL_EXTRA}")
    )


def digest(result: DataFrame) -> DataFrame:
    """The result with the hash of the kept words in place of the words."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


