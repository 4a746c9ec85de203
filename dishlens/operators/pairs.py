"""Contrastive training pairs, mined with seeded draws.

Instead of a loop that picks and rejects, the picks are a table: ``j = 0 .. attempts-1`` with a position drawn for each
slot. A directory of the groups' chunks says where a position lies, and only rows of chunks that were drawn are shuffled and
numbered; rejected picks drop out, and the lowest ``j`` fill the quota. The work follows the number of reviews (one scan) and
of draws, never the number of possible pairs, and no group is gathered in a task.

All functions read a processed review table (``review_id, review_text, star_rating``, tags, ``search_text``) more than
once; give them a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dishlens.functions.hashing import draw
from dishlens.operators.metrics import facet_members
from dishlens.operators.ordinals import DIRECTORY_ROWS, directory, with_ordinal
from dishlens.operators.query_match import draw_matches
from dishlens.sources.sinks import materialize

# The share of each strategy, and how many picks it may take per pair wanted.
SHARES = {"query": 0.3, "similar": 0.4, "rating": 0.3}
ATTEMPTS = {"query": 10, "similar": 5, "rating": 5}
HIGH_RATING = 4
MAX_BROADCAST_DRAWS = 1_000_000
PAIR_COLUMNS = ["strategy", "j", "left_id", "right_id", "text_a", "text_b"]


def quota(strategy: str, num_pairs: int) -> int:
    return int(num_pairs * SHARES[strategy])


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only a table whose row count is bounded by a parameter, and only within a fixed bound."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_DRAWS else df


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def union_queries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct query texts of both lists."""
    return a.select("query").union(b.select("query")).distinct()


def _draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "j")


def _two_distinct(seed: int, strategy: str, n: Column) -> tuple[Column, Column]:
    """Two different positions below ``n``: the second is a step of 1..n-1 from the first."""
    first = draw(seed, strategy, F.col("j"), "first", n)
    step = draw(seed, strategy, F.col("j"), "step", n - 1)
    return first, F.pmod(first + 1 + step, F.when(n > 0, n))


def _ends(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Both ends of each draw as rows ``j, side, ordinal``, so that one join finds the reviews of both."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("ordinal")) for s, c in ((0, "p1"), (1, "p2"))])
    return draws.select("j", *keys, F.explode(sides).alias("e")).select("j", *keys, "e.side", "e.ordinal")


def _sides(found: DataFrame, columns: list[str]) -> DataFrame:
    """Back from two rows to one per draw; draws with a missing end drop out."""
    picks = []
    for side, name in ((0, "left"), (1, "right")):
        picks += [F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{name}_{c}") for c in columns]
    return found.groupBy("j").agg(F.count(F.lit(1)).alias("_n"), *picks).where(F.col("_n") == 2).drop("_n")


def _with_texts(pairs: DataFrame, reviews: DataFrame, strategy: str, rows: int) -> DataFrame:
    """Fetch ``search_text`` for both ids; the pairs go to the reviews, not the other way round."""
    ends = pairs.select("j", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("left_review_id").alias("review_id")),
        F.struct(F.lit(1).alias("side"), F.col("right_review_id").alias("review_id")),
    )).alias("e")).select("j", "e.side", "e.review_id")
    found = reviews.select("review_id", "search_text").join(_small(ends, 2 * rows), "review_id")
    return _sides(found, ["review_id", "search_text"]).select(
        F.lit(strategy).alias("strategy"),
        "j",
        F.col("left_review_id").alias("left_id"),
        F.col("right_review_id").alias("right_id"),
        F.col("left_search_text").alias("text_a"),
        F.col("right_search_text").alias("text_b"),
    )


def query_pairs(reviews: DataFrame, queries: DataFrame, num_pairs: int, seed: int = 42) -> DataFrame:
    """A query with a review that contains one of its terms; both picked evenly, repeats allowed.

    A pick whose query matches nothing is rejected. As most queries match, the first ``want`` picks are tried alone and
    the rest of the attempts only if some of them failed.
    """
    want, spark = quota("query", num_pairs), reviews.sparkSession
    numbered = with_ordinal(queries.select("query").distinct(), ["query"], out_col="query_id").select("query_id", "query")
    n_queries = numbered.count()
    picks = _draws(spark, want * ATTEMPTS["query"]).select(
        "j", draw(seed, "query", F.col("j"), "query", F.lit(n_queries)).alias("query_id")
    )
    drawn = materialize(draw_matches(reviews, numbered, picks.where(F.col("j") < want), seed, "query"), "drawn")
    short = want - drawn.count()
    if short:
        later = draw_matches(reviews, numbered, picks.where(F.col("j") >= want), seed, "query")
        drawn = drawn.union(later.orderBy("j").limit(short))
    found = reviews.select("review_id", "search_text").join(_small(drawn, want), "review_id")
    named = picks.join(numbered, "query_id")
    return found.join(named, "j").select(
        F.lit("query").alias("strategy"),
        "j",
        F.col("query_id").alias("left_id"),
        F.col("review_id").alias("right_id"),
        F.col("query").alias("text_a"),
        F.col("search_text").alias("text_b"),
    )


def similar_pairs(reviews: DataFrame, num_pairs: int, seed: int = 42, chunk_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """Two different reviews with a tag in common: first a tag, all equally likely, then two of its reviews."""
    want, spark = quota("similar", num_pairs), reviews.sparkSession
    members = directory(facet_members(reviews), ["review_id"], ["facet", "value"], rows=reviews.count(), chunk_rows=chunk_rows)
    sizes = materialize(members.sizes().where(F.col("size") >= 2), "sizes")
    groups = with_ordinal(sizes, ["facet", "value"], out_col="group_ord")
    picks = _draws(spark, want).select("j", draw(seed, "similar", F.col("j"), "group", _count(sizes)).alias("group_ord"))
    p1, p2 = _two_distinct(seed, "similar", F.col("size"))
    drawn = picks.join(groups, "group_ord").select("j", "facet", "value", p1.alias("p1"), p2.alias("p2"))
    found = members.pick(_ends(drawn, ["facet", "value"]), 2 * want)
    return _with_texts(_sides(found, ["review_id"]), reviews, "similar", want)


def rating_pairs(reviews: DataFrame, num_pairs: int, seed: int = 42, chunk_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """Two different well-rated reviews that share a food type."""
    want, spark = quota("rating", num_pairs), reviews.sparkSession
    attempts = want * ATTEMPTS["rating"]
    high = reviews.where(F.coalesce("star_rating", F.lit(0)) >= HIGH_RATING).select("review_id", "food_type")
    high = directory(high, ["review_id"], rows=reviews.count(), chunk_rows=chunk_rows)
    n = high.sizes().select("size").scalar()
    picks = _draws(spark, attempts).select(
        "j", draw(seed, "rating", F.col("j"), "first", n).alias("p1"), draw(seed, "rating", F.col("j"), "second", n).alias("p2")
    )
    different = picks.where(F.col("p1") != F.col("p2"))
    both = _sides(high.pick(_ends(different, []), 2 * attempts), ["review_id", "food_type"])
    kept = both.where(F.arrays_overlap("left_food_type", "right_food_type")).orderBy("j").limit(want)
    return _with_texts(kept, reviews, "rating", want)


def fill_pairs(reviews: DataFrame, mined: DataFrame, num_pairs: int, seed: int = 42, chunk_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """Random pairs of different reviews, as many as ``mined`` falls short of ``num_pairs``."""
    ids = directory(reviews.select("review_id"), ["review_id"], chunk_rows=chunk_rows)
    p1, p2 = _two_distinct(seed, "fill", ids.sizes().select("size").scalar())
    drawn = _draws(reviews.sparkSession, num_pairs).where(F.col("j") < num_pairs - _count(mined)).select("j", p1.alias("p1"), p2.alias("p2"))
    found = ids.pick(_ends(drawn, []), 2 * num_pairs)
    return _with_texts(_sides(found, ["review_id"]), reviews, "fill", num_pairs)


def shuffled(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Give the pairs a random order: ``pair_id`` 0.. in the order of a seeded hash."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit("shuffle"), F.col("strategy"), F.col("j").cast("string"))
    return with_ordinal(pairs, ["strategy", "j"], hash_text=text, out_col="pair_id")


def batches(pairs: DataFrame, batch_size: int = 16) -> DataFrame:
    return pairs.withColumn("batch", F.floor(F.col("pair_id") / batch_size))


def batch_plan(pairs: DataFrame, batch_size: int = 16, epochs: int = 3) -> DataFrame:
    """Size of every batch, with the number of steps a training run of ``epochs`` takes; the pairs are read once."""
    sizes = materialize(batches(pairs, batch_size).groupBy("batch").agg(F.count(F.lit(1)).alias("n_pairs")), "batches")
    steps = F.ceil(sizes.agg(F.sum("n_pairs")).scalar() / F.lit(batch_size)) * epochs
    return sizes.withColumn("total_steps", steps)


