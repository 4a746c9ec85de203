"""How filters interact, counted by a stream that takes back what a later, smaller id makes wrong.

Five filters: A under 200 words, B fewer than half of the words distinct, C more than 3 % of the code points A to Z, D any of
``#$%&*|``, E the text of a smaller doc_id. A mask holds the filters that a document fails; all counts follow from the number
of documents by part, mask and labels.

1. The files are a stream, processed as available-now micro-batches; its checkpoint, the state and the changes lie in one
   folder, so a later run with the same folder takes only files that have come since.
2. A task marks A to D of its texts. Rows of equal texts are pre-aggregated by text, part and labels before they meet, so a
   text that a third of all rows have is a few rows a task.
3. State by text (its SHA-256): the least doc_id so far and how many rows have it, by part and labels. A batch joins the
   texts it has with the state; documents behind the least id count as failing E, and where a smaller id comes, the
   documents that had the least one before are taken back from the counter of their mask and added to that with E.
4. Each batch writes its changes of the part counters under its number. A batch that is run again writes the same again.
5. The sums of the changes, at most 32 masks by 4 labels for each part, make the rows of all 120 orders of the filters.

Results: null or empty text is an empty text (fails A); a null doc_id comes after all others; rows that repeat one doc_id and
text do not make each other fail E; a null lang is the part with the empty name. Labels of a document that has several count
as 1 if one is 1; a null label is no label. Very long texts are marked by themselves, a chunk at a time. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dishlens.config import work_dir
from dishlens.llm import arrays
from dishlens.sources.sinks import materialize

LETTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
#: Micro-batches that the files of a first run are dealt to.
BATCHES = 8
MARKS = "text_key binary, doc_key long, part string, mask int"
CHANGES = "part string, mask int, good int, toxic int, n long"
STATE = "text_key binary, part string, good int, toxic int, mask int, least long, at_least long, n long, now_least long"

UPPER, SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
SYMBOL[[ord(c) for c in "#$%&*|"]] = True


def masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Filters A to D that each text fails."""
    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, doc = arrays.word_spans(data, offsets)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    hashes = arrays.span_hashes(data, starts, ends)
    order = np.lexsort((hashes, doc))
    heads = arrays.starts_of_runs(doc[order], hashes[order])
    distinct = np.bincount(doc[order][heads], minlength=len(offsets) - 1)
    points = per_text((data & 0xC0) != 0x80)
    failed = A * (words < MIN_WORDS) | B * (100 * distinct < DISTINCT_PERCENT * words)
    return failed | C * (100 * per_text(UPPER[data]) > UPPER_PERCENT * points) | D * (per_text(SYMBOL[data]) > 0)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in arrays.chunks(batch.column("text")):
            n, view = len(offsets) - 1, memoryview(np.ascontiguousarray(data))
            keys = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()),
                batch.column("doc_key").slice(first, n),
                batch.column("part").slice(first, n),
                pa.array(masks(data, offsets).astype(np.int32)),
            ], names=["text_key", "doc_key", "part", "mask"])


def _grouped(marks: DataFrame) -> DataFrame:
    """Rows of a batch by text, part and labels: how many, the least id, and how many rows have it."""
    by = ["text_key", "part", "good", "toxic"]
    once = marks.groupBy(*by, "doc_key").agg(F.count(F.lit(1)).alias("n"), F.first("mask").alias("mask"))
    found = once.groupBy(*by).agg(F.sum("n").alias("n"), F.min(F.struct("doc_key", "n")).alias("least"), F.first("mask").alias("mask"))
    return found.select(*by, "mask", F.col("least.doc_key").alias("least"), F.col("least.n").alias("at_least"), "n")


def _moves(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state's rows (n is null) and the batch's, each with the least id of its text as of now."""
    held = state.where("least = now_least").select(*[c for c in state.columns if c not in ("n", "now_least")], F.lit(None).cast("long").alias("n"))
    # a text has a row for each part and label, before and in the batch
    return held.unionByName(batch).withColumn("now_least", F.min("least").over(Window.partitionBy("text_key")))


def _changes(moves: DataFrame) -> DataFrame:
    """What the batch adds to and takes from the counters by part, mask and labels."""
    old, first = F.col("n").isNull(), F.col("least") == F.col("now_least")
    passed = F.when(old, F.when(first, 0).otherwise(-F.col("at_least"))).otherwise(F.when(first, F.col("at_least")).otherwise(0))
    failed = F.when(old, F.when(first, 0).otherwise(F.col("at_least"))).otherwise(F.col("n") - passed)
    both = F.array(F.struct(F.col("mask").alias("mask"), passed.alias("n")), F.struct(F.col("mask").bitwiseOR(E).alias("mask"), failed.alias("n")))
    each = moves.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n <> 0")
    return each.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n")).select("part", "mask", "good", "toxic", "n")


def _flags(labels: DataFrame) -> DataFrame:
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    found = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_key")).agg(one("quality"), one("toxic"))
    return found.select("doc_key", F.col("quality").alias("good"), "toxic")


def counters(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Documents by part, mask and labels (good, toxic), after all files at ``path`` that ``folder`` does not know yet.

    ``folder`` holds the stream's checkpoint, state and changes; a fresh one is taken below ``spark.checkpoint.dir`` if none
    is named. ``files_per_batch`` is an eighth of the files unless given.
    """
    table = spark.read.parquet(path)
    names = table.inputFiles()
    files = files_per_batch or max(1, -(-len(names) // BATCHES))
    if len(names) == 1 and names[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]:
        path = f"{path[:-1]}[{path[-1]}]"  # the stream takes one file by a pattern only
    folder = folder or work_dir(spark, "audit")
    spark.createDataFrame([], CHANGES).write.mode("ignore").parquet(f"{folder}/changes/batch=-1")
    spark.createDataFrame([], STATE).write.mode("ignore").parquet(f"{folder}/state-before")
    flags = materialize(_flags(labels), "flags")

    def state_of(batch_id: int) -> str:
        """Two places in turn: a batch that is run again finds the state it began with."""
        return f"{folder}/state-{batch_id % 2}" if batch_id >= 0 else f"{folder}/state-before"

    def step(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        marks = batch.mapInArrow(_mark, MARKS).join(flags, "doc_key", "left").fillna(0, ["good", "toxic"])
        moves = _moves(own.read.parquet(state_of(batch_id - 1)), _grouped(marks))
        moves.write.mode("overwrite").parquet(state_of(batch_id))
        _changes(own.read.parquet(state_of(batch_id))).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
    rows = stream.select(arrays.document_key("doc_id").alias("doc_key"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    total = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{folder}/changes")
    return total.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(counts: DataFrame) -> DataFrame:
    """For each part, order of the filters and step, what its filter removes and what it would have removed without the others."""
    steps = []
    for order in permutations(range(5)):
        before = 0
        for k, filter_ in enumerate(order):
            steps.append(f"named_struct('filter_order', '{''.join(LETTERS[i] for i in order)}', 'step', {k + 1}, 'own', {1 << filter_}, 'before', {before})")
            before |= 1 << filter_
    each = counts.select("part", "mask", "good", "toxic", "n", F.explode(F.expr(f"array({', '.join(steps)})")).alias("s"))
    fails, earlier = F.expr("mask & s.own > 0"), F.expr("mask & s.before > 0")
    removed = fails & ~earlier
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    found = each.groupBy("part", "s.filter_order", "s.step", "s.own").agg(
        total(~fails & ~earlier, "kept"),
        total(removed, "removed"),
        total(fails & earlier, "redundant"),
        total(F.expr("mask = s.own"), "unique_fails"),
        total(removed & (F.col("good") == 1), "good_lost"),
        total(removed & (F.col("toxic") == 1), "toxic_lost"),
    )
    # 120 rows for each part and filter
    found = found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own")))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """One row for each part, order and step."""
    return interactions(counters(spark, path, labels, folder, files_per_batch))
