"""Tag reviews with the lexicon categories whose keywords they contain.

Few keywords are compiled into native expressions, which also run on streams. For a wide lexicon every extra keyword
would be another pass over the text, so from ``SCAN_FROM`` keywords on one pass finds all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.functions import lexicon as lx
from dishlens.functions import text as tx
from dishlens.operators.terms import Dictionary, Listing, mentions_listing, scan

SCAN_FROM = 30


def tag_columns(
    df: DataFrame,
    entries: tuple[lx.Entry, ...],
    columns: dict[str, tuple[str, ...]] | None = None,
    text_col: str = "review_text",
    fold_keywords: bool = True,
) -> DataFrame:
    """Add one array column per review facet with native expressions only."""
    columns = columns or lx.REVIEW_FACETS
    lowered = df.withColumn("_lowered", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    tags = {
        out: lx.categories_in(F.col("_lowered"), lx.keywords_by_category(entries, facets, fold_keywords))
        for out, facets in columns.items()
    }
    return lowered.withColumns(tags).drop("_lowered")


def tag_reviews(
    df: DataFrame,
    entries: tuple[lx.Entry, ...],
    columns: dict[str, tuple[str, ...]] | None = None,
    dictionary: Dictionary | None = None,
    text_col: str = "review_text",
    fold_keywords: bool = True,
    max_mentions: int = 5,
    scan_from: int = SCAN_FROM,
) -> DataFrame:
    """Add the facet columns and, given a dictionary, ``mentioned_foods``, reading each text once."""
    columns = columns or lx.REVIEW_FACETS
    tables = {out: lx.keywords_by_category(entries, facets, fold_keywords) for out, facets in columns.items()}
    if dictionary is None and count_keywords(tables) < scan_from:
        return tag_columns(df, entries, columns, text_col, fold_keywords)
    return _scan(df, F.lower(F.coalesce(F.col(text_col), F.lit(""))), tables, dictionary, max_mentions)


def tag_whole_words(
    df: DataFrame,
    entries: tuple[lx.Entry, ...],
    columns: dict[str, tuple[str, ...]] | None = None,
    text_col: str = "review_text",
) -> DataFrame:
    """Like ``tag_reviews`` but a keyword only counts as a run of whole words (scripts that put spaces)."""
    columns = columns or lx.REVIEW_FACETS
    folded = {out: lx.keywords_by_category(entries, facets) for out, facets in columns.items()}
    tables = {out: {c: [f" {as_words(w)} " for w in ws] for c, ws in table.items()} for out, table in folded.items()}
    return _scan(df, tx.padded_words(F.coalesce(F.col(text_col), F.lit(""))), tables)


def count_keywords(tables: dict[str, dict[str, list[str]]]) -> int:
    return len({w for table in tables.values() for ws in table.values() for w in ws})


def _scan(
    df: DataFrame,
    lowered: Column,
    tables: dict[str, dict[str, list[str]]],
    dictionary: Dictionary | None = None,
    max_mentions: int = 5,
) -> DataFrame:
    listings = [Listing(name, tuple((c, tuple(ws)) for c, ws in table.items())) for name, table in tables.items()]
    if dictionary is not None:
        listings.append(mentions_listing(dictionary, "mentioned_foods", max_mentions))
    scanned = df.withColumn("_scan", scan(lowered, listings))
    return scanned.withColumns({x.name: F.col(f"_scan.{x.name}") for x in listings}).drop("_scan")


def as_words(keyword: str) -> str:
    """A keyword in the form ``padded_words`` gives a text: letters, marks and digits, single spaces."""
    import regex

    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", keyword.lower()).strip()
