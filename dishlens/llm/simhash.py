"""Near duplicates by SimHash fingerprints that differ in few bits, found by variants of segments with one bit deleted.

1. Fingerprint: every run of ``width`` words (A to Z count as a to z; repeats count) votes with the bits of its XXH64; a bit is
   1 if over half the runs have it. A text of fewer words votes as a whole, one without words has the fingerprint zero.
2. Two fingerprints that differ in at most two bits are cut into two segments, not three: in one of them they differ in at
   most one bit. Each distinct fingerprint is indexed under 64 keys, a segment with one of its 32 bits deleted. Fingerprints
   with one key are brought together by an equality join and verified. A pair is verified under the first of its
   keys only; a key of more than SMALL fingerprints gives the links that join its components, not all pairs.
3. Keys that very many fingerprints have are not gathered: a sample of the fingerprints tells which keys are likely such, and a
   task that meets a longer run all the same lets it through unheld. Their fingerprints are indexed under all 2,016
   deletions of two bits instead, exactly the fingerprints within two bits of each other; such a key has four at most.
4. The links make components of fingerprints; a component's least doc_id is joined back to the documents. Fingerprints and
   components with more than a thousandth of all rows, a thousand at most, are joined by broadcast.

Results: null or empty text has the fingerprint zero and is linked like any other. Rows that repeat have one fingerprint and
component. A null doc_id comes after all others. Very long texts are worked on by themselves, a chunk of a batch each. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm import arrays, sketch
from dishlens.llm.arrays import U
from dishlens.llm.components import components
from dishlens.llm.xxh import xxh64
from dishlens.sources.sinks import materialize

WIDTH, DISTANCE, SEED = 3, 2, 42
HALF = 32
#: Fingerprints of a key up to which all pairs are compared in step, and up to which they are compared one by one.
SMALL, MOST = 16, 4_096
#: One fingerprint in so many tells which keys are crowded; a key is so with this many of them.
SAMPLE, CROWD = 64, 64
#: A key with more than one row in so many of all is joined by broadcast.
HOT_SHARE = 1_000
#: Fingerprints whose keys a task makes at once.
AT_ONCE = 8_192
LOW = U((1 << HALF) - 1)


def _joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another with a space behind each, and where they begin and end."""
    size = ends - starts + 1
    to = np.cumsum(size)
    at = np.repeat(starts - (to - size), size) + np.arange(int(size.sum()))
    out = np.concatenate([data, np.zeros(1, np.uint8)])[at]
    out[to - 1] = 0x20
    return out, to - size, to - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One 64-bit number for each text."""
    n = len(offsets) - 1
    out = np.zeros(n, U)
    data = arrays.LOWER[data]
    starts, ends, doc = arrays.word_spans(data, offsets)
    if not len(starts):
        return out
    data, starts, ends = _joined_words(data, starts, ends)
    first = np.searchsorted(doc, np.arange(n + 1))
    words = np.diff(first)
    at = np.flatnonzero(doc[: max(0, len(doc) - width + 1)] == doc[width - 1 :])
    short = np.flatnonzero((words > 0) & (words < width))
    owner = np.concatenate([doc[at], short])
    begin, end = np.concatenate([starts[at], starts[first[short]]]), np.concatenate([ends[at + width - 1], ends[first[short + 1] - 1]])
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], xxh64(data, begin[order], end[order], SEED)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    heads = arrays.starts_of_runs(owner)
    votes = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    over = 2 * votes > np.diff(np.append(heads, len(owner)))[:, None]
    out[owner[heads]] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _features(width: int) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in arrays.chunks(batch.column("text")):
                found = fingerprints(data, offsets, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_key").slice(first, len(found)), pa.array(found)], names=["doc_key", "fp"])

    return find


def segment_keys(fp: np.ndarray) -> np.ndarray:
    """The 64 keys of each fingerprint: number of the deleted bit, and the segment without it."""
    bit = np.arange(HALF, dtype=U)
    halves = [fp & LOW, fp >> U(HALF)]
    keys = [(half[:, None] & ~(U(1) << bit)) | ((bit + U(s * HALF)) << U(HALF)) for s, half in enumerate(halves)]
    return np.concatenate(keys, axis=1)


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of the keys that two fingerprints share, as the number of its deleted bit; 64 if they share none."""
    differ = a ^ b
    low, high = differ & LOW, differ >> U(HALF)
    number = lambda x: np.bitwise_count((x & (~x + U(1))) - U(1))  # noqa: E731  the place of the lowest bit, 64 for none
    at = lambda x: np.where(x == 0, 0, number(x)).astype(np.int64)
    few_low, few_high = np.bitwise_count(low) <= 1, np.bitwise_count(high) <= 1
    return np.where(few_low, at(low), np.where(few_high, HALF + at(high), 2 * HALF))


def _key_rows(crowded: Callable[[np.ndarray], np.ndarray] | None) -> Callable:
    """A row for each key that is not crowded; those that are, with the key missing, once a fingerprint."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column("fp").to_numpy().view(U)
            for k in range(0, len(all_fp), AT_ONCE):
                fp = all_fp[k : k + AT_ONCE]
                keys = segment_keys(fp)
                out = crowded(keys) if crowded else np.zeros(keys.shape, bool)
                each = np.repeat(fp, 2 * HALF).reshape(keys.shape)
                some = fp[out.any(axis=1)]
                key = pa.array(np.concatenate([keys[~out], some]).view(np.int64), mask=np.arange((~out).sum() + len(some)) >= (~out).sum())
                yield pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([each[~out], some]).view(np.int64))], names=["key", "fp"])

    return find


def _forest(key: int, fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between the fingerprints of one key that join all components they make."""
    number = key >> HALF
    root = np.arange(len(fp))
    for j in range(1, len(fp)):
        linked = np.flatnonzero((np.bitwise_count(fp[:j] ^ fp[j]) <= DISTANCE) & (first_key(fp[:j], fp[j : j + 1]) == number))
        if len(linked):
            roots, first = np.unique(root[linked], return_index=True)
            yield from ((int(fp[i]), int(fp[j])) for i in linked[first])
            root[np.isin(root, np.append(roots, j))] = roots[0]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by key: a, b; fingerprints of keys with more than MOST come back with b missing."""
    def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], names=["a", "b"])

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = arrays.starts_of_runs(key)
        size = np.diff(np.append(heads, len(key)))
        each = np.repeat(size, size)
        small = np.flatnonzero((each > 1) & (each <= SMALL))
        k, x = key[small], fp[small]
        for gap in range(1, SMALL):
            at = np.flatnonzero(k[:-gap] == k[gap:]) if len(k) > gap else small[:0]
            if not len(at):
                break
            a, b = x[at], x[at + gap]
            ok = (np.bitwise_count(a ^ b) <= DISTANCE) & (first_key(a, b) == (k[at] >> U(HALF)).astype(np.int64))
            yield rows(a[ok], b[ok])
        for at in np.flatnonzero((size > SMALL) & (size <= MOST)):
            run = slice(heads[at], heads[at] + size[at])
            found = np.array(list(_forest(int(key[heads[at]]), fp[run])), U).reshape(-1, 2)
            yield rows(found[:, 0].copy(), found[:, 1].copy())
        for at in np.flatnonzero(size > MOST):
            yield rows(fp[heads[at] : heads[at] + size[at]], None)

    key, fp, long = np.zeros(0, U), np.zeros(0, U), None
    for batch in batches:
        new_key, new_fp = batch.column("key").to_numpy().view(U), batch.column("fp").to_numpy().view(U)
        if long is not None and len(new_key):
            cut = int(np.searchsorted(new_key, long, side="right"))
            yield rows(new_fp[:cut], None)
            new_key, new_fp = new_key[cut:], new_fp[cut:]
            if not len(new_key):
                continue
            long = None
        key, fp = np.concatenate([key, new_key]), np.concatenate([fp, new_fp])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], side="left"))
        yield from links(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
        if len(key) > MOST:
            yield rows(fp, None)
            key, fp, long = key[:0], fp[:0], key[-1]
    if len(key):
        yield from links(key, fp)


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under all deletions of two bits."""
    i, j = np.triu_indices(2 * HALF, 1)
    bits = (U(1) << i.astype(U)) | (U(1) << j.astype(U))
    tag = arrays.mix(np.arange(len(bits), dtype=U) + U(arrays.BASE))
    for batch in batches:
        all_fp = batch.column("fp").to_numpy().view(U)
        for k in range(0, len(all_fp), 256):
            fp = all_fp[k : k + 256]
            key = arrays.mix((fp[:, None] & ~bits) ^ tag)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, len(bits)).view(np.int64))], names=["key", "fp"])


def _links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within DISTANCE bits of each other."""
    keys = "key long, fp long"
    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(_key_rows(None), keys)
    likely = materialize(sample.groupBy("key").count().where(F.col("count") >= CROWD).select("key"), "crowded")
    crowded = None
    if not likely.isEmpty():
        bits, table = sketch.bitmap(likely, "key")
        crowded = lambda k: sketch.in_bitmap(table.value, k.reshape(-1).view(np.int64), bits).reshape(k.shape)
    rows = nodes.mapInArrow(_key_rows(crowded), keys).withColumn("deal", F.coalesce("key", "fp"))
    met = rows.repartition("deal").sortWithinPartitions("key").select("key", "fp")
    found = materialize(met.mapInArrow(_compare_or_pass, "a long, b long"), "links")
    crowd = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowd.isEmpty():
        return found
    # at most four fingerprints agree in all but two given bits
    groups = crowd.mapInArrow(_deletions, keys).groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    close = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return materialize(found.where("b IS NOT NULL").unionByName(close), "links")


def _compare_or_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a key, which come first, are fingerprints of crowded keys."""
    def with_key() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("key").null_count:
                crowd.append(batch.filter(batch.column("key").is_null()).column("fp"))
                batch = batch.filter(batch.column("key").is_valid())
            yield batch

    crowd: list[pa.Array] = []
    for found in _compare(with_key()):
        yield found
        while crowd:
            fp = crowd.pop()
            yield pa.RecordBatch.from_arrays([fp, pa.nulls(len(fp), pa.int64())], names=["a", "b"])
    while crowd:
        fp = crowd.pop()
        yield pa.RecordBatch.from_arrays([fp, pa.nulls(len(fp), pa.int64())], names=["a", "b"])


def _joined(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a key with ``n``, its rows; keys of many rows are not gathered."""
    hot = table.where(F.col("n") * HOT_SHARE > total).drop("n")  # fewer than HOT_SHARE rows
    hot_rows = rows.join(F.broadcast(hot), key)
    return hot_rows.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop("n"), key))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each document: doc_key, fp, component_key (the least doc_key it is linked with)."""
    rows = docs.select(arrays.document_key(doc_id).alias("doc_key"), F.col(text).alias("text"))
    features = materialize(rows.mapInArrow(_features(width), "doc_key long, fp long"), "fingerprints")
    nodes = materialize(features.groupBy("fp").agg(F.min("doc_key").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = components(_links(nodes.select("fp")))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_key"), F.count(F.lit(1)).alias("n"))
    rooted, least = materialize(rooted, "rooted"), materialize(least, "roots")
    placed = _joined(rooted.select("root", "fp", F.col("n").alias("rows")), least, "root", rooted.count())
    placed = materialize(placed.select("fp", "component_key", F.col("rows").alias("n")), "components")
    return _joined(features, placed, "fp", features.count()).select("doc_key", "fp", "component_key")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    known = lambda key: F.when(F.col(key) != arrays.LAST_ID, F.col(key))
    return classes(docs, doc_id, text, width).select(
        known("doc_key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), known("component_key").alias("component_id")
    )
