"""From raw reviews to the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dishlens.config import Settings
from dishlens.functions import lexicon as lx
from dishlens.functions import text as tx
from dishlens.operators import metrics
from dishlens.operators.ordinals import exact_sample
from dishlens.operators.tagging import tag_reviews
from dishlens.operators.terms import fetch_dictionary, with_mentions
from dishlens.sources import readers, sinks

SEARCH_FACETS = ("cuisine_type", "food_type", "atmosphere", "price_level", "location")
PROCESSED = ["review_id", "review_text", "star_rating", *SEARCH_FACETS, "mentioned_foods", "search_text"]


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Drop reviews without text or with too little of it; the text left is cleaned.

    A plain filter on the cleaned text would be pushed below it and clean every text twice, so short texts are dropped
    by exploding a list of none or one.
    """
    kept = F.filter(F.array(tx.collapse("review_text")), lambda t: F.length(t) >= tx.MIN_REVIEW_CHARS)
    others = [c for c in reviews.columns if c != "review_text"]
    return reviews.where(F.col("review_text").isNotNull()).select(*others, F.explode(kept).alias("review_text")).select(reviews.columns)


def process_reviews(
    reviews: DataFrame,
    dictionary: DataFrame | None,
    entries: tuple[lx.Entry, ...] | None = None,
    max_reviews: int | None = None,
    seed: int = 42,
    search_chars: int | None = None,
) -> DataFrame:
    """Clean, sample down to ``max_reviews`` if asked to, tag, find mentions, build the search text.

    The search text holds the whole review, or its first ``search_chars`` characters.
    """
    out = clean_reviews(reviews)
    if max_reviews is not None:
        out = exact_sample(out, max_reviews, "review_id", seed)
    return tagged_reviews(out, dictionary, entries, search_chars)


def tagged_reviews(cleaned: DataFrame, dictionary: DataFrame | None, entries: tuple[lx.Entry, ...] | None = None, search_chars: int | None = None) -> DataFrame:
    """What ``process_reviews`` makes of reviews that are clean and chosen."""
    entries = lx.shipped_entries() if entries is None else entries
    small = fetch_dictionary(dictionary) if dictionary is not None else None
    tagged = tag_reviews(cleaned, entries, dictionary=small)
    if dictionary is None:
        tagged = tagged.withColumn("mentioned_foods", F.array().cast("array<string>"))
    elif small is None:
        tagged = with_mentions(tagged, dictionary)
    return tagged.withColumn("search_text", tx.search_text("review_text", list(SEARCH_FACETS), search_chars)).select(PROCESSED)


STAGES = ("loaded", "cleaned", "sampled")


def counted_cleaning(reviews: DataFrame, max_reviews: int | None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The cleaned reviews, sampled if asked to, as a written table, and ``stage_rank, stage, n`` of the rows at each stage.

    Rows are counted in passing while they are written; a count costs no scan of its own.
    """
    seen = {stage: Observation(stage) for stage in STAGES}
    count = lambda df, stage: df.observe(seen[stage], F.count(F.lit(1)).alias("n"))
    cleaned = count(clean_reviews(count(reviews.where(F.col("review_text").isNotNull()), "loaded")), "cleaned")
    if max_reviews is None:
        out = sinks.materialize(count(cleaned, "sampled"), "cleaned")
    else:
        # a sample reads its input twice, so that is written first
        sampled = exact_sample(sinks.materialize(cleaned, "cleaned"), max_reviews, "review_id", seed)
        out = sinks.materialize(count(sampled, "sampled"), "sampled")
    rows = [(i, stage, seen[stage].get["n"]) for i, stage in enumerate(STAGES)]
    return out, reviews.sparkSession.createDataFrame(rows, "stage_rank int, stage string, n bigint")


def pipeline_counts(reviews: DataFrame, max_reviews: int | None, seed: int = 42) -> DataFrame:
    """``stage_rank, stage, n`` after loading, cleaning and sampling."""
    return counted_cleaning(reviews, max_reviews, seed)[1]


def run_preprocessing(spark: SparkSession, settings: Settings) -> dict[str, DataFrame]:
    """Read the inputs, write the processed table, and return it with its inputs and statistics."""
    reviews = readers.read_reviews_csv(spark, settings.reviews_path)
    dictionary = readers.prepare_dictionary(readers.read_dictionary(spark, settings.dictionary_path))
    judges = readers.read_queries(spark, settings.judge_queries_path)
    algo = readers.read_queries(spark, settings.algo_queries_path)
    cleaned, counts = counted_cleaning(reviews, settings.max_reviews, settings.seed)
    sinks.write_table(tagged_reviews(cleaned, dictionary), settings.processed_path)
    written = readers.read_table(spark, settings.processed_path, "run_preprocessing")
    return {
        "processed": written,
        "dictionary": dictionary,
        "judge_queries": judges,
        "algo_queries": algo,
        "counts": counts,
        "ratings": metrics.rating_distribution(written),
    }
