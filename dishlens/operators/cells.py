"""An index of vectors by cells that looks at part of the table and still finds the exact nearest rows.

Building: centroids are fitted by rounds over a bounded sample (FIT_ROWS rows a cell), then every row is written to the cell of
its nearest centroid, with its distance from it (``reach``), one folder a cell. A cell's radius is its largest reach.

Searching: for a query q and a row x of the cell of centroid m, ``q.x <= q.m + |q| |x - m|``. Each query visits its cells in
order of that bound with the cell's radius, a few in the first round and four times as many in each next one, until no bound
left can reach its k-th score. Within a cell only rows whose own reach can are scored. The bound is a proof, so the hits are
those of a search over all rows, whatever the data; how many rows it spares depends on how close the vectors of a cell lie.

Visits go to the rows: a round reads only folders of cells that are visited, and rows and queries of one cell meet by a shuffle
in blocks of at most about BLOCK_ROWS rows by BLOCK_QUERIES queries, so neither a cell with a third of the rows nor one that a
third of the queries visits is gathered in a task. Queries are never sent to tasks as a whole. What is, are the centroids: at
most MAX_NUMBERS numbers.

Results: rows without a vector, or with a number in it that is not finite, are no hits; a query without a vector has none.
Equal scores are ranked by row id; a zero vector is a row or query like others. Rows that repeat a row id are rows of their own.
An empty table or query table gives no hits. Vectors of another length than the index's raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dishlens.functions.hashing import hash32, key
from dishlens.operators.topk import SCORE_DIGITS, STEP_CELLS
from dishlens.sources.sinks import materialize

MAX_CELLS, MAX_NUMBERS = 16_384, 16_000_000
FIT_ROWS, FIT_ROUNDS, SEED = 256, 8, 42
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096
#: Cells a query visits in the first round, and how many times as many there are after each next one.
FIRST_CELLS, GROWTH = 2, 4
#: What is allowed for rounding, in parts of the lengths of query and row.
SLACK = 1e-7
FOUND = "query_id bigint, row_id bigint, score double, n_scored bigint"
VISITS = "cell int, block int, part int, query_id bigint, vector array<double>, need double, floor double"


@dataclass(frozen=True)
class Cells:
    """What is known of each cell; the numbers a search starts from."""

    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // BLOCK_ROWS))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query by cell, the product with the centroid and the most that a row of the cell can score."""
        middle, length = queries @ self.centroids.T, np.linalg.norm(queries, axis=1)
        slack = SLACK * length[:, None] * (np.linalg.norm(self.centroids, axis=1) + self.radius)[None, :]
        top = middle + length[:, None] * self.radius[None, :] + slack
        top[:, self.rows == 0] = -np.inf
        return middle, top


@dataclass(frozen=True)
class CellIndex:
    """The rows, in folders by cell, and the cells."""

    rows: DataFrame
    cells: Cells


def vectors_of(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors of one length as a matrix."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    dim = dim or (int(lengths[0]) if len(lengths) else 1)
    if (lengths != dim).any():
        raise ValueError(f"vectors of other lengths than {dim}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(-1, dim)


def _finite(df: DataFrame) -> DataFrame:
    numbers = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where((F.size("vector") > 0) & numbers)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each vector; the first of equally near ones."""
    out, square = np.zeros(len(x), np.int64), (centroids**2).sum(axis=1) / 2
    step = max(1, STEP_CELLS // max(1, len(centroids)))
    for k in range(0, len(x), step):
        out[k : k + step] = np.argmin(square[None, :] - x[k : k + step] @ centroids.T, axis=1)
    return out


def _round(sample: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of the sample's vectors by nearest centroid, a cell without any keeps its own; and how many each has."""
    shared, (n, dim) = sample.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((n, dim)), np.zeros(n, np.int64)
        for batch in batches:
            x = vectors_of(batch.column("vector"), dim)
            cell = nearest(x, shared.value)
            np.add.at(total, cell, x)
            count += np.bincount(cell, minlength=n)
        some = np.flatnonzero(count)
        numbers = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype="int32") * dim), pa.array(total[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), pa.array(count[some]), numbers], names=["cell", "n", "total"])

    def add(group: pa.Table) -> pa.Table:
        total = vectors_of(group.column("total").combine_chunks(), dim).sum(axis=0)
        return pa.table({"cell": group.column("cell")[:1], "n": pa.array([pc.sum(group.column("n")).as_py()]), "total": pa.array([total], pa.list_(pa.float64()))})

    schema = "cell int, n bigint, total array<double>"
    found = sample.select("vector").mapInArrow(sums, schema).groupBy("cell").applyInArrow(add, schema).toArrow().combine_chunks()
    out, count = centroids.copy(), np.zeros(n, np.int64)
    if found.num_rows:
        cell = found["cell"].to_numpy()
        count[cell] = found["n"].to_numpy()
        out[cell] = vectors_of(found["total"].combine_chunks(), dim) / count[cell][:, None]
    shared.unpersist()
    return out, count


def fit_centroids(corpus: DataFrame, n_cells: int | None = None, rounds: int = FIT_ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centroids, and how many rows of the corpus each is likely to get."""
    corpus = _finite(corpus).select(F.col("row_id").cast("bigint").alias("row_id"), "vector")
    n, dim = corpus.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim = dim or 1
    n_cells = max(1, min(n_cells or int(n**0.5), n, MAX_CELLS, MAX_NUMBERS // dim))
    one_in = max(1, n // (n_cells * FIT_ROWS))
    order = hash32(key(seed, "cells", F.col("row_id")))
    sample = materialize(corpus.where(order % one_in == 0), "cell-sample")
    first = sample.orderBy(order, "row_id").limit(n_cells).select("vector").toArrow().combine_chunks()
    centroids, count = vectors_of(first["vector"].combine_chunks(), dim) if first.num_rows else np.zeros((1, dim)), np.zeros(n_cells, np.int64)
    for _ in range(rounds):
        centroids, count = _round(sample, centroids)
    return centroids, count * one_in


def _at(values: np.ndarray) -> Column:
    """The value of a row's cell, out of one for each cell."""
    kind = "bigint" if values.dtype.kind == "i" else "double"
    return F.element_at(F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(f"array<{kind}>"), F.col("cell") + 1)


def build_cells(corpus: DataFrame, path: str, n_cells: int | None = None, rounds: int = FIT_ROUNDS, seed: int = SEED) -> CellIndex:
    """Write ``row_id, vector`` as an index below ``path``; the square root of the rows as number of cells unless given."""
    spark = corpus.sparkSession
    centroids, expected = fit_centroids(corpus, n_cells, rounds, seed)
    shared, dim = spark.sparkContext.broadcast(centroids), centroids.shape[1]
    vector_type = corpus.schema["vector"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column("vector"), dim)
            cell = nearest(x, shared.value)
            reach = np.sqrt(((x - shared.value[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype("int32")), pa.array(reach)], names=["row_id", "vector", "cell", "reach"])

    placed = _finite(corpus).select(F.col("row_id").cast("bigint").alias("row_id"), "vector")
    placed = placed.mapInArrow(assign, f"row_id bigint, vector {vector_type}, cell int, reach double")
    files = _at(np.maximum(1, -(-expected // BLOCK_ROWS)).astype("int64"))
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("row_id"), files))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    rows = spark.read.schema(f"row_id bigint, vector {vector_type}, reach double, cell int").parquet(f"{path}/rows")
    stats = rows.groupBy("cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n")).toArrow()
    radius, count = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    radius[stats["cell"].to_numpy()], count[stats["cell"].to_numpy()] = stats["radius"].to_numpy(), stats["n"].to_numpy()
    table = pa.table({"cell": np.arange(len(centroids)), "radius": radius, "n": count, "centroid": list(centroids)})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return CellIndex(rows, Cells(centroids, radius, count))


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    """An index written before."""
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow().combine_chunks()
    cells = Cells(vectors_of(table["centroid"].combine_chunks()), table["radius"].to_numpy(), table["n"].to_numpy())
    return CellIndex(spark.read.parquet(f"{path}/rows"), cells)


def _visiting(cells: Cells, first: int, last: int) -> Callable:
    """A row for each query, cell of places ``first`` to ``last`` in its order that can still matter, and block of the cell."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, dim = cells.blocks, cells.centroids.shape[1]
        for batch in batches:
            step = max(1, STEP_CELLS // max(len(cells.rows), dim * (last - first)))
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                q, floor = vectors_of(some.column("vector"), dim), some.column("floor").to_numpy(zero_copy_only=False)
                middle, top = cells.bounds(q)
                place = np.argsort(-top, axis=1, kind="stable")[:, first:last]
                owner = np.repeat(np.arange(len(q)), place.shape[1])
                cell = place.reshape(-1)
                able = (top[owner, cell] > -np.inf) & (top[owner, cell] >= floor[owner])
                owner, cell = owner[able], cell[able]
                length = np.linalg.norm(q, axis=1)[owner]
                slack = SLACK * length * (np.linalg.norm(cells.centroids, axis=1) + cells.radius)[cell]
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(length > 0, (floor[owner] - middle[owner, cell] - slack) / length, -np.inf)
                each = np.repeat(np.arange(len(owner)), blocks[cell])
                block = np.arange(len(each)) - np.repeat(np.cumsum(blocks[cell]) - blocks[cell], blocks[cell])
                numbers = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype="int32") * dim), pa.array(q[owner[each]].reshape(-1)))
                ids = some.column("query_id").to_numpy()[owner[each]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell[each].astype("int32")), pa.array(block.astype("int32")), pa.array(np.zeros(len(each), "int32")), pa.array(ids), numbers, pa.array(need[each]), pa.array(floor[owner[each]])
                ], names=["cell", "block", "part", "query_id", "vector", "need", "floor"])

    return visit


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each column's ``k`` best scores; equal ones by id."""
    kth = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    row, column = np.nonzero((scores >= kth[None, :]) & (scores > -np.inf))
    order = np.lexsort((ids[row], -scores[row, column], column))
    row, column = row[order], column[order]
    keep = np.arange(len(column)) - np.searchsorted(column, column) < k
    return row[keep], column[keep]


def _scoring(k: int, dim: int) -> Callable:
    """The best rows of a block for each of its queries, and how many rows were scored for it."""
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            reach = left["reach"].to_numpy()
            order = np.argsort(-reach, kind="stable")
            reach, ids = reach[order], left["row_id"].to_numpy()[order]
            x = vectors_of(left["vector"].combine_chunks(), dim)[order]
            q, query = vectors_of(right["vector"].combine_chunks(), dim), right["query_id"].to_numpy()
            floor = right["floor"].to_numpy()
            upto = np.searchsorted(-reach, -right["need"].to_numpy(), side="right")
            by_size = np.argsort(-upto, kind="stable")
            step = max(1, STEP_CELLS // len(x))
            for at in range(0, len(by_size), step):
                some = by_size[at : at + step]
                most = upto[some[0]]
                if not most:
                    break
                scores = np.round(x[:most] @ q[some].T, SCORE_DIGITS) + 0.0
                # rows under a query's k-th score so far are scored, but are no hits
                scores[(np.arange(most)[:, None] >= upto[some][None, :]) | (scores < floor[some][None, :])] = -np.inf
                row, column = best_of(scores, ids[:most], k)
                out[0].append(query[some][column])
                out[1].append(ids[row])
                out[2].append(scores[row, column])
            out[3].append(upto)
        hits = [np.concatenate(c) if c else np.zeros(0) for c in out[:3]]
        counts = out[3][0] if out[3] else np.zeros(0, np.int64)
        counted = right["query_id"].to_numpy() if len(counts) else np.zeros(0, np.int64)
        return pa.table({
            "query_id": pa.array(np.concatenate([hits[0], counted]).astype("int64")),
            "row_id": pa.concat_arrays([pa.array(hits[1].astype("int64")), pa.nulls(len(counts), pa.int64())]),
            "score": pa.concat_arrays([pa.array(hits[2].astype("float64")), pa.nulls(len(counts), pa.float64())]),
            "n_scored": pa.concat_arrays([pa.nulls(len(hits[0]), pa.int64()), pa.array(counts.astype("int64"))]),
        })

    return score


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_cells(index: CellIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits ``query_id, rank, row_id, score``, the exact ``k`` best of all rows, and ``query_id, n_scored`` of each query."""
    spark, cells, dim = queries.sparkSession, index.cells, index.cells.centroids.shape[1]
    vector = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    asked = materialize(_finite(queries).select(F.col("query_id").cast("bigint").alias("query_id"), vector), "asked")
    best, effort = spark.createDataFrame([], "query_id bigint, rank int, row_id bigint, score double"), []
    first, last = 0, FIRST_CELLS
    while first < len(cells.rows):
        floors = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        going = asked.join(floors, "query_id", "left").fillna(float("-inf"), ["floor"])
        visits = materialize(going.mapInArrow(_visiting(cells, first, last), VISITS), "visits")
        wanted = visits.where("block = 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).toArrow()
        if not wanted.num_rows:
            break
        cell = wanted["cell"].to_numpy()
        parts, need = np.ones(len(cells.rows), np.int64), np.full(len(cells.rows), np.inf)
        parts[cell], need[cell] = -(-wanted["n"].to_numpy() // BLOCK_QUERIES), wanted["need"].to_numpy()
        # folders of other cells are not read
        rows = index.rows.where(F.col("cell").isin(cell.tolist())).where(F.col("reach") >= _at(need))
        block = F.pmod(F.xxhash64("row_id"), _at(cells.blocks)).cast("int").alias("block")
        rows = rows.select("cell", block, F.explode(F.sequence(F.lit(0), (_at(parts) - 1).cast("int"))).alias("part"), "row_id", "vector", "reach")
        dealt = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), _at(parts)).cast("int"))
        keys = ("cell", "block", "part")
        found = rows.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_scoring(k, dim), FOUND)
        found = materialize(found, "found")
        effort.append(found.where("n_scored IS NOT NULL").select("query_id", "n_scored"))
        hits = found.where("row_id IS NOT NULL").select("query_id", "row_id", "score")
        best = materialize(_ranked(best.drop("rank").unionByName(hits), k).select("query_id", "rank", "row_id", "score"), "best")
        first, last = last, last * GROWTH
    looked = asked.select("query_id", F.lit(0).cast("bigint").alias("n_scored"))
    for part in effort:
        looked = looked.unionByName(part)
    return best, looked.groupBy("query_id").agg(F.sum("n_scored").alias("n_scored"))
