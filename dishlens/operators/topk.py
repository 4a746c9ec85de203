"""Exact top-k by inner product for a whole table of queries.

The corpus is read in place: every task scores its Arrow batches against the queries as one matrix product and keeps
only the best k per query, so what is shuffled is k rows per query and task, whatever the size of the corpus. They are
merged in two steps, first by query and share of the tasks, so no task gets more of a query than k rows of each share. Up to
``MAX_BLOCK_CELLS`` numbers the queries travel with the tasks; a larger query table is cut into blocks that travel one
after another, with one scan each. The corpus is never shuffled. Equal scores are ranked by row id. Queries may each have
their own k, which is also what a task keeps for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishlens.sources.sinks import Payload, materialize

MAX_BLOCK_QUERIES = 8_192
MAX_BLOCK_CELLS = 32_000_000
SCORE_DIGITS = 9
STEP_CELLS = 4_000_000
MAX_BROADCAST_HITS = 1_000_000
#: Shares of the tasks whose hits are merged first.
SHARES = 256
HITS = "query_id bigint, row_id bigint, score double, k int, share int"
HITS_ARROW = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.float64()), ("k", pa.int32()), ("share", pa.int32())])
QUERY_FILTERS = ("min_rating", "cuisine_type", "food_type", "location", "price_level")


@dataclass(frozen=True)
class Hits:
    """Ranked hits ``query_id, rank, row_id, score`` and, where it is known, how many there can be at most."""

    rows: DataFrame
    at_most: int | None

    def with_payload(self, table: DataFrame | Payload) -> DataFrame:
        """Fetch the rest of each hit's row; few hits travel to the table, so the table is not shuffled.

        Of a stored payload only the folders that hold hits are read; the hits are written first, to look at them.
        """
        hits, few = self.rows, self.at_most is not None and self.at_most <= MAX_BROADCAST_HITS
        if isinstance(table, Payload):
            hits = materialize(hits, "hits")
            table = table.near(hits) if few else table.rows.drop("shelf")
        if few:
            hits = F.broadcast(hits)
        payload = [c for c in table.columns if c not in ("space", "space_key", "vector", "features", "weights", "score", "rank", "query_id")]
        return table.select(payload).join(hits, "row_id")


class QueryBlock:
    """Some queries as one matrix, with how many rows each wants and the metadata a row must have for it."""

    def __init__(self, table: pa.Table):
        self.sparse = "features" in table.column_names
        self.vector_column = "features" if self.sparse else "vector"
        table = self._with_vector(table).combine_chunks()
        self.k = table["k"].to_numpy().astype("int64")
        self.ids = table["query_id"].to_numpy().astype("int64")
        n = len(self.ids)
        if self.sparse:
            feats, weights = (_flat(table[c]) for c in ("features", "weights"))
            counts = _lengths(table["features"])
            self.vocab = np.unique(feats)
            self.matrix = np.zeros((len(self.vocab), n))
            self.matrix[np.searchsorted(self.vocab, feats), np.repeat(np.arange(n), counts)] = weights
        else:
            lengths = _lengths(table["vector"])
            if n and lengths.min() != lengths.max():
                raise ValueError("query vectors differ in length")
            self.matrix = _flat(table["vector"]).astype("float64").reshape(n, -1).T.copy()
        self.min_rating = table["min_rating"].to_numpy() if "min_rating" in table.column_names else None
        self.needs = None
        if "needs" in table.column_names:
            wanted = [set(w or ()) for w in table["needs"].to_pylist()]
            self.keys = sorted(set().union(*wanted)) if wanted else []
            self.needs = np.array([[key in w for w in wanted] for key in self.keys], dtype="float64").reshape(len(self.keys), n)

    def _with_vector(self, batch: pa.Table | pa.RecordBatch) -> pa.Table | pa.RecordBatch:
        column = batch[self.vector_column]
        return batch.filter(column.is_valid()) if column.null_count else batch

    def scores(self, batch: pa.Table | pa.RecordBatch) -> np.ndarray:
        rows = batch.num_rows
        if self.sparse:
            feats, weights = _flat(batch["features"]), _flat(batch["weights"])
            owner = np.repeat(np.arange(rows), _lengths(batch["features"]))
            at = np.searchsorted(self.vocab, feats)
            at[at == len(self.vocab)] = 0
            known = self.vocab[at] == feats if len(self.vocab) else np.zeros(len(feats), bool)
            dense = np.zeros((rows, len(self.vocab)))
            dense[owner[known], at[known]] = weights[known]
        else:
            dense = _flat(batch["vector"]).astype("float64").reshape(rows, -1)
            if dense.shape[1] != self.matrix.shape[0]:
                raise ValueError(f"vectors of {dense.shape[1]} numbers against queries of {self.matrix.shape[0]}")
        out = np.round(dense @ self.matrix, SCORE_DIGITS) + 0.0
        out[np.isnan(out)] = -np.inf  # a row without a score is no hit, and takes no other row's place
        if self.min_rating is not None:
            # only queries with a bound are filtered; an unrated row passes none
            rating = np.nan_to_num(batch["star_rating"].to_numpy(zero_copy_only=False).astype("float64"))
            least = self.min_rating.astype("float64")
            out[~np.isnan(least)[None, :] & (rating[:, None] < least[None, :])] = -np.inf
        if self.needs is not None and len(self.keys):
            place = pc.index_in(_values(batch["has"]), value_set=pa.array(self.keys, pa.string()))
            owner = np.repeat(np.arange(rows), _lengths(batch["has"]))
            known = place.is_valid().to_numpy(zero_copy_only=False)
            held = np.zeros((rows, len(self.keys)))
            held[owner[known], place.drop_null().to_numpy()] = 1.0
            out[held @ self.needs < self.needs.sum(axis=0)[None, :]] = -np.inf
        return out

    def raised(self, floor: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The floor of each query, no lower than its k-th score among these."""
        for k in np.unique(self.k):
            if len(scores) > k:
                mine = np.flatnonzero(self.k == k)
                floor[mine] = np.maximum(floor[mine], np.partition(scores[:, mine], -k, axis=0)[-k])
        return floor

    def best(self, batches: Iterator[pa.Table | pa.RecordBatch], share: int = 0) -> pa.RecordBatch:
        n = len(self.ids)
        q, r, s = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
        floor = np.full(n, -np.inf)
        width = max(1, n, self.matrix.shape[0])
        step = max(64, STEP_CELLS // width)
        for batch in map(self._with_vector, batches):
            ids = batch["row_id"].to_numpy().astype("int64")
            for start in range(0, batch.num_rows if n else 0, step):
                part = batch.slice(start, step)
                scores = self.scores(part)
                floor = self.raised(floor, scores)
                at_row, at_query = np.nonzero((scores >= floor[None, :]) & (scores > -np.inf))
                q = np.concatenate([q, at_query])
                r = np.concatenate([r, ids[start + at_row]])
                s = np.concatenate([s, scores[at_row, at_query]])
                order = np.lexsort((r, -s, q))
                q, r, s = q[order], r[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                keep = rank < self.k[q]
                last = rank == self.k[q] - 1
                floor[q[last]] = np.maximum(floor[q[last]], s[last])
                q, r, s = q[keep], r[keep], s[keep]
        columns = [self.ids[q], r, s, self.k[q].astype("int32"), np.full(len(q), share, "int32")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=HITS_ARROW)


def _lists(col):
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _values(col) -> pa.Array:
    flat = _lists(col).flatten()
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def _flat(col) -> np.ndarray:
    return _values(col).to_numpy(zero_copy_only=False)


def _lengths(col) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(_lists(col)), 0).to_numpy(zero_copy_only=False)


def _vector_columns(df: DataFrame) -> list[str]:
    return ["features", "weights"] if "features" in df.columns else ["vector"]


def with_query_needs(queries: DataFrame) -> DataFrame:
    """Collect the optional filter columns of a query table into ``min_rating`` and ``needs``; empty means no filter."""
    facets = [c for c in QUERY_FILTERS[1:] if c in queries.columns]
    needs = [F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.lower(c))) for c in facets]
    out = queries.withColumn("needs", F.array_compact(F.array(*needs))) if needs else queries
    if "min_rating" in queries.columns:
        out = out.withColumn("min_rating", F.when(F.col("min_rating") > 0, F.col("min_rating")).cast("double"))
    return out


def has_column(facets: list[str]) -> Column:
    """All tags of a row as ``facet:value`` in lower case."""

    def named(facet: str) -> Column:
        values = F.coalesce(F.col(facet), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.concat(F.lit(f"{facet}:"), F.lower(v)))

    return F.concat(*[named(f) for f in facets])


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    max_block_queries: int = MAX_BLOCK_QUERIES,
    max_block_cells: int = MAX_BLOCK_CELLS,
    filtered: bool = False,
) -> Hits:
    """The ``k`` rows of highest inner product for each query; a column ``k`` of ``queries`` goes before the argument.

    ``corpus`` has ``row_id`` and ``vector`` (or ``features, weights``), ``queries`` likewise with ``query_id``. With
    ``filtered`` only rows that pass the filter columns of a query count for it. A query that wants no rows gets none.
    """
    vec = _vector_columns(queries)
    q_cols, c_cols = ["query_id", "k", *vec], ["row_id", *vec]
    own = F.coalesce(F.col("k").cast("int"), F.lit(k)) if "k" in queries.columns else F.lit(k)
    queries = queries.withColumn("k", own).where(F.col("k") > 0)
    if filtered:
        facets = [c for c in QUERY_FILTERS[1:] if c in queries.columns]
        queries = with_query_needs(queries)
        if facets:
            corpus = corpus.withColumn("has", has_column(facets))
            q_cols, c_cols = [*q_cols, "needs"], [*c_cols, "has"]
        if "min_rating" in queries.columns:
            q_cols, c_cols = [*q_cols, "min_rating"], [*c_cols, "star_rating"]
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), *q_cols[1:])
    corpus = corpus.select(F.col("row_id").cast("bigint").alias("row_id"), *c_cols[1:])

    head = queries.limit(max_block_queries + 1).toArrow()
    width = len(np.unique(_flat(head[vec[0]]))) if len(vec) == 2 else int(_lengths(head["vector"]).max(initial=1))
    if head.num_rows <= max_block_queries and head.num_rows * width <= max_block_cells:
        partial, at_most = _with_travelling_queries(corpus, head), int(pc.sum(head["k"]).as_py() or 0)
    else:
        at_most = None
        partial = _in_blocks(corpus, queries, max(1, min(max_block_queries, max_block_cells // width) // 2))
    return Hits(_merged(partial).select("query_id", "rank", "row_id", "score"), at_most)


def _merged(partial: DataFrame) -> DataFrame:
    """The best rows of each query, of those of each share of the tasks."""
    for by in (["query_id", "share"], ["query_id"]):
        best = Window.partitionBy(*by).orderBy(F.col("score").desc(), "row_id")
        partial = partial.withColumn("rank", F.row_number().over(best)).where("rank <= k")
    return partial


def _with_travelling_queries(corpus: DataFrame, block: pa.Table) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield QueryBlock(shared.value).best(batches, TaskContext.get().partitionId() % SHARES)

    return corpus.mapInArrow(scan, HITS)


def _in_blocks(corpus: DataFrame, queries: DataFrame, block_queries: int) -> DataFrame:
    """One scan of the corpus for each block of queries; a block's best rows are written before the next block comes."""
    blocks = max(1, -(-queries.count() // block_queries))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = []
    for i in range(blocks):
        block = queries.where(number == i).toArrow()
        if block.num_rows:
            parts.append(materialize(_merged(_with_travelling_queries(corpus, block)).drop("rank"), "hits"))
    return reduce(DataFrame.unionByName, parts)
