"""Cleaning and tagging on a stream. Both are stateless, so no watermark or state is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dishlens.functions import lexicon as lx
from dishlens.functions import text as tx
from dishlens.operators.tagging import tag_columns
from dishlens.plans.preprocess import SEARCH_FACETS, clean_reviews


def tagged_stream(reviews: DataFrame, entries: tuple[lx.Entry, ...] | None = None, search_chars: int | None = None) -> DataFrame:
    """Clean, tag and build the search text with native expressions."""
    tagged = tag_columns(clean_reviews(reviews), lx.shipped_entries() if entries is None else entries)
    return tagged.withColumn("search_text", tx.search_text("review_text", list(SEARCH_FACETS), search_chars))


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now to parquet, exactly once, and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
