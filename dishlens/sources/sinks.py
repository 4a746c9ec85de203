"""Sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dishlens.config import work_dir
from dishlens.operators.encode import Space

SPACES = "name string, encoder string, passage_prefix string, query_prefix string, dim int, tokens string, idf array<double>"


#: Rows of a payload that share a folder, and folders at most.
SHELF_ROWS, MAX_SHELVES = 2_000, 16_384


@dataclass(frozen=True)
class Payload:
    """What belongs to the rows of an index besides vectors, once for all spaces, in folders by a hash of ``row_id``."""

    rows: DataFrame
    shelves: int

    @staticmethod
    def shelf(shelves: int) -> Column:
        return F.pmod(F.xxhash64(F.col("row_id").cast("bigint")), F.lit(shelves)).cast("int")

    def near(self, ids: DataFrame) -> DataFrame:
        """The rows in folders that hold one of ``ids``; other folders are not read. The folders' numbers come to the driver."""
        numbers = [r[0] for r in ids.select(self.shelf(self.shelves)).distinct().collect()]
        return self.rows.where(F.col("shelf").isin(numbers)).drop("shelf")


def write_payload(rows: DataFrame, path: str) -> Payload:
    """Write a table keyed by ``row_id`` so that few of its rows can be fetched without reading the rest."""
    shelves = max(1, min(MAX_SHELVES, rows.count() // SHELF_ROWS))
    dealt = rows.withColumn("shelf", Payload.shelf(shelves)).repartition("shelf").sortWithinPartitions("shelf", "row_id")
    dealt.write.mode("overwrite").partitionBy("shelf").option("compression", "zstd").parquet(path)
    rows.sparkSession.createDataFrame([(shelves,)], "shelves int").coalesce(1).write.mode("overwrite").parquet(f"{path}-shelves")
    return Payload(rows.sparkSession.read.schema(f"{_ddl(rows)}, shelf int").parquet(path), shelves)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def materialize(df: DataFrame, purpose: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write a table several later jobs read and hand back the written form; a lost executor costs nothing upstream."""
    path = work_dir(df.sparkSession, purpose)
    df.write.partitionBy(*(partition_by or [])).parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def write_index(index: DataFrame, spaces: list[Space], path: str) -> None:
    """Vectors, one folder per space, and beside them what the spaces are."""
    index.write.mode("overwrite").partitionBy("space").parquet(f"{path}/vectors")
    write_spaces(index.sparkSession, spaces, path)


def write_spaces(spark: SparkSession, spaces: list[Space], path: str) -> None:
    rows = [(s.name, s.encoder, s.passage_prefix, s.query_prefix, s.dim, s.tokens, list(s.idf) if s.idf is not None else None) for s in spaces]
    spark.createDataFrame(rows, SPACES).coalesce(1).write.mode("overwrite").parquet(f"{path}/spaces")


def write_csv(df: DataFrame, path: str, sep: str = ";", header: bool = True) -> None:
    """Export results; lists are joined with commas because CSV has no arrays. Blanks at the ends of texts stay."""
    flat = [
        F.array_join(c.name, ", ").alias(c.name) if isinstance(c.dataType, T.ArrayType) else F.col(c.name) for c in df.schema
    ]
    writer = df.select(*flat).write.mode("overwrite").option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
