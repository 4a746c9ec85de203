"""Dense row numbers and exact-size samples without ever sorting a table, or a big group of it, in one task.

Rows are put in the order of a 32-bit hash of their key. The hash range is cut into chunks of about ``CHUNK_ROWS`` rows;
a small table of chunk counts gives every chunk its offset, and rows are only numbered inside their chunk. The numbers
depend on the keys alone: not on the chunk size, the partitioning or a retry.

Where only some numbers are wanted, a ``Directory`` of much smaller chunks answers which chunk holds a number, and only rows
of such chunks are shuffled and numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishlens.functions.hashing import HASH_BITS, hash32
from dishlens.sources.sinks import materialize

CHUNK_ROWS = 500_000
#: Rows of a directory's chunk, about; and its chunks that are added up together.
DIRECTORY_ROWS, SUPER_BITS = 1_024, 10
MAX_BROADCAST_IDS = 1_000_000


def _chunks_for(df: DataFrame, group_cols: list[str], chunk_rows: int) -> int:
    """Enough chunks that the biggest group is cut to about ``chunk_rows``; one number comes to the driver."""
    counts = df.groupBy(*group_cols).count() if group_cols else df.agg(F.count(F.lit(1)).alias("count"))
    biggest = counts.agg(F.max("count")).first()[0] or 0
    return max(1, -(-biggest // chunk_rows))


def _chunked(df: DataFrame, hash_text: Column, chunks: int) -> DataFrame:
    hashed = df.withColumn("_h", hash32(hash_text))
    return hashed.withColumn("_chunk", F.shiftright(F.col("_h") * F.lit(chunks).cast("bigint"), HASH_BITS).cast("int"))


def _offsets(chunked: DataFrame, group_cols: list[str]) -> DataFrame:
    """First number of every chunk; a few rows per group, whatever the size of the group."""
    counts = chunked.groupBy(*group_cols, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group_cols, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))


def with_ordinal(
    df: DataFrame,
    id_cols: list[str],
    group_cols: list[str] | None = None,
    out_col: str = "ordinal",
    hash_text: Column | None = None,
    chunks: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    below: int | None = None,
) -> DataFrame:
    """Number the rows 0.. (per group), in hash order with ``id_cols`` breaking ties.

    ``below`` keeps the numbers under it; chunks past it are dropped before anything is shuffled.
    """
    group_cols = group_cols or []
    if hash_text is None:
        hash_text = F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols])
    if chunks is None:
        chunks = _chunks_for(df, group_cols, chunk_rows)
    chunked = _chunked(df, hash_text, chunks)
    if chunks > 1:
        offsets = _offsets(chunked, group_cols)
        if below is not None:
            offsets = offsets.where(F.col("_first") < below)
        chunked = chunked.join(offsets, [*group_cols, "_chunk"])
        first = F.col("_first")
    else:
        first = F.lit(0).cast("bigint")
    local = F.row_number().over(Window.partitionBy(*group_cols, "_chunk").orderBy("_h", *id_cols))
    numbered = chunked.withColumn(out_col, first + local - 1)
    if below is not None:
        numbered = numbered.where(F.col(out_col) < below)
    return numbered.drop("_h", "_chunk", "_first")


def exact_sample(
    df: DataFrame, n: int, id_col: str, seed: int = 42, chunks: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Exactly ``n`` rows, or all if there are not more; the same rows for the same seed.

    Only ids are shuffled to choose; the rows are then picked where they are while ``n`` allows sending the ids there.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))
    chosen = with_ordinal(df.select(id_col), [id_col], hash_text=text, chunks=chunks, chunk_rows=chunk_rows, out_col="_o", below=n)
    chosen = chosen.select(id_col)
    return df.join(F.broadcast(chosen) if n <= MAX_BROADCAST_IDS else chosen, id_col, "left_semi")


@dataclass(frozen=True)
class Directory:
    """Rows by chunk of their hash, and the first number and size of each chunk (``_chunk, _first, _n``, by group)."""

    rows: DataFrame
    chunks: DataFrame
    id_cols: list[str]
    group_cols: list[str]

    def sizes(self) -> DataFrame:
        """``size`` of each group; one row if there are no groups."""
        return self.chunks.groupBy(*self.group_cols).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("size"))

    def pick(self, wanted: DataFrame, at_most: int) -> DataFrame:
        """The rows behind the numbers of ``wanted`` (group columns, ``ordinal`` and whatever else), of which there are ``at_most``.

        A number is found by its page: a chunk lies on few pages of DIRECTORY_ROWS numbers, and a page has as many chunks at most.
        """
        page = lambda c: F.floor(c / DIRECTORY_ROWS).cast("bigint")
        by = [*self.group_cols, "_page"]
        pages = self.chunks.withColumn("_page", F.explode(F.sequence(page(F.col("_first")), page(F.col("_first") + F.col("_n") - 1))))
        asked = wanted.withColumn("_page", page(F.col("ordinal")))
        small = at_most <= MAX_BROADCAST_IDS
        found = pages.join(F.broadcast(asked) if small else asked, by).where("ordinal >= _first AND ordinal < _first + _n")
        found = materialize(found.withColumn("_local", F.col("ordinal") - F.col("_first") + 1).drop("_page", "_n", "_first"), "wanted")
        place = [*self.group_cols, "_chunk"]
        chunks = found.select(*place).distinct()
        near = self.rows.join(F.broadcast(chunks) if small else chunks, place, "left_semi")
        local = F.row_number().over(Window.partitionBy(*place).orderBy("_h", *self.id_cols)).cast("bigint")
        numbered = near.withColumn("_local", local)
        return numbered.join(F.broadcast(found) if small else found, [*place, "_local"]).drop("_h", "_chunk", "_local")


def directory(df: DataFrame, id_cols: list[str], group_cols: list[str] | None = None, rows: int | None = None, chunk_rows: int = DIRECTORY_ROWS) -> Directory:
    """Number the rows as ``with_ordinal`` does, without doing it: what is shuffled and written is one row a chunk.

    ``rows`` is about how many rows the largest group has at most; they are counted if it is not given.
    """
    group_cols = group_cols or []
    count = df.count() if rows is None else rows
    bits = min(HASH_BITS - 1, max(0, (max(1, count) // chunk_rows).bit_length()))
    chunked = df.withColumn("_h", hash32(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols])))
    chunked = chunked.withColumn("_chunk", F.shiftright("_h", HASH_BITS - bits).cast("int"))
    counts = chunked.groupBy(*group_cols, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_super", F.shiftright("_chunk", SUPER_BITS))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*group_cols, "_super").agg(F.sum("_n").alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before(group_cols or [F.lit(0)], "_super")), F.lit(0))).drop("_sum")
    within = F.coalesce(F.sum("_n").over(before([*group_cols, "_super"], "_chunk")), F.lit(0))
    chunks = counts.withColumn("_within", within).join(sums, [*group_cols, "_super"])
    chunks = chunks.select(*group_cols, "_chunk", (F.col("_base") + F.col("_within")).alias("_first"), "_n")
    return Directory(chunked, materialize(chunks, "directory"), id_cols, group_cols)
