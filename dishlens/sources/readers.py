"""Scans. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dishlens.functions import text as tx
from dishlens.operators.encode import Space
from dishlens.sources.sinks import Payload, materialize

# Strings that a data frame reader takes for a missing value by default.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SMALL_INPUT_BYTES = 1 << 28
#: Blocks of files whose first numbers go to every task; more are joined.
MAX_BROADCAST_BLOCKS = 1_000_000
INDEX_COLUMNS = ("space", "row_id")


def numbered(lines: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan 0.. by file name and place in the file, whatever splits and tasks the scan has.

    Blocks of files are counted in one light scan, and a small table says with which number each begins.
    """
    place = lines.withColumns({
        "_file": F.xxhash64("_metadata.file_path"),
        "_path": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_place": F.monotonically_increasing_id(),
    })
    blocks = place.groupBy("_file", "_block").agg(F.min("_path").alias("_path"), F.min("_place").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    firsts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_first"))
    firsts = materialize(firsts, "blocks")
    few = firsts.count() <= MAX_BROADCAST_BLOCKS
    joined = place.join(F.broadcast(firsts) if few else firsts, ["_file", "_block"])
    return joined.select((F.col("_place") + F.col("_first")).alias(name), *lines.columns)


def read_reviews_csv(spark: SparkSession, path: str, na_values: tuple[str, ...] = NA_VALUES) -> DataFrame:
    """``review_id, review_text, star_rating`` from ``;``-separated lines without header, quoted line breaks allowed.

    Rows without text are dropped; a rating that is not an integer fails the job. Ids are places of rows in the files, by file
    name. A file with line breaks inside quotes cannot be split, so large inputs should come as many files.
    """
    raw = (
        spark.read.schema("review_text string, star_rating string")
        .option("sep", ";")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    missing = [F.when(~F.col(c).isin(list(na_values)), F.col(c)).alias(c) for c in ("review_text", "star_rating")]
    rating = F.when(F.col("star_rating").isNull(), F.raise_error(F.lit("a review has no rating"))).otherwise(
        F.col("star_rating").cast("int")
    )
    return (
        numbered(raw, "review_id").select("review_id", *missing)
        .dropna(subset=["review_text"])
        .select("review_id", "review_text", rating.alias("star_rating"))
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``rank, term``, one term per line, in the order of the file."""
    return dictionary_lines(numbered(spark.read.text(path), "rank").withColumnRenamed("value", "line"))


def dictionary_lines(lines: DataFrame) -> DataFrame:
    return lines.select("rank", tx.strip("line").alias("term")).where(F.col("term") != "")


def prepare_dictionary(terms: DataFrame, min_chars: int = 4, max_chars: int = 50, limit: int | None = None) -> DataFrame:
    """The distinct terms of a fitting length, or the first ``limit`` of them."""
    fitting = terms.where(F.length("term").between(min_chars, max_chars))
    distinct = fitting.groupBy("term").agg(F.min("rank").alias("rank")).select("rank", "term")
    return distinct if limit is None else distinct.orderBy("rank").limit(limit)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query`` from lines whose terms are separated by pipes."""
    return query_lines(numbered(spark.read.text(path), "query_id").withColumnRenamed("value", "line"))


def query_lines(lines: DataFrame) -> DataFrame:
    """A line of white space alone is no query; one of pipes alone is a blank query, as a blank string."""
    kept = lines.where(tx.strip("line") != "")
    return kept.select("query_id", tx.normalize_query("line").alias("query"))


def read_table(spark: SparkSession, path: str, made_by: str) -> DataFrame:
    """A parquet table of an earlier step; if it is not there, say which step to run."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no table at {path}: run {made_by} first") from e


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Space]]:
    """The index table and the spaces its vectors live in."""
    index = read_table(spark, f"{path}/vectors", "write_index")
    missing = [c for c in INDEX_COLUMNS if c not in index.columns]
    if missing or not ({"vector"} <= set(index.columns) or {"features", "weights"} <= set(index.columns)):
        raise ValueError(f"{path} is not an index: it lacks {missing or ['vector']}")
    spaces = read_table(spark, f"{path}/spaces", "write_index")
    return index, {
        r.name: Space(r.name, r.encoder, r.passage_prefix, r.query_prefix, r.dim, r.tokens, tuple(r.idf) if r.idf is not None else None)
        for r in spaces.collect()
    }


def read_payload(spark: SparkSession, path: str) -> Payload:
    """The payload table that spaces share."""
    rows = read_table(spark, path, "write_payload")
    return Payload(rows, read_table(spark, f"{path}-shelves", "write_payload").first()["shelves"])


def spread(df: DataFrame, key: str, small_bytes: int = SMALL_INPUT_BYTES) -> DataFrame:
    """Share a small input out over all cores by its key; one that is large or comes in a file for each core stays put."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > small_bytes or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)


