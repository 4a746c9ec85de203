"""Retrieval metrics per query, over all hits, per category, and between two spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishlens.functions import text as tx
from dishlens.sources import catalog

# The wording of the report, and the bounds (percent) of its verdicts.
BETTER, WORSE, UNCHANGED = "ดีขึ้น", "ลดลง", "ไม่มีการเปลี่ยนแปลง"
VERDICTS = (
    (5.0, "มีการปรับปรุงอย่างมีนัยสำคัญ", "แนะนำให้ใช้โมเดลที่ Finetuned"),
    (0.0, "มีการปรับปรุงเล็กน้อย", "สามารถใช้โมเดลที่ Finetuned ได้"),
    (-5.0, "ไม่มีการเปลี่ยนแปลงที่สำคัญ", "อาจใช้โมเดล Baseline ก็ได้"),
)
VERDICT_ELSE = ("ประสิทธิภาพลดลง", "ควรใช้โมเดล Baseline")
FACET_FLAGS = ("cuisine_type", "food_type", "location")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def per_query(queries: DataFrame, hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``num_results, avg_score, avg_rating, metadata_coverage`` (0..1); zero for a query without hits."""
    keys = ["query_id", *(by or [])]
    means = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("score").alias("_score"),
        F.avg("star_rating").alias("_rating"),
        F.avg(tx.has_metadata(*FACET_FLAGS)).alias("_coverage"),
    )
    return queries.join(means, keys, "left").select(
        *queries.columns,
        F.coalesce("_n", F.lit(0)).alias("num_results"),
        _or_zero(F.col("_score")).alias("avg_score"),
        _or_zero(F.col("_rating")).alias("avg_rating"),
        _or_zero(F.col("_coverage")).alias("metadata_coverage"),
    )


def over_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Means over all hits at once, so a query with more hits weighs more; coverage in percent."""
    return hits.agg(
        _or_zero(F.avg("score")).alias("avg_retrieval_score"),
        _or_zero(F.avg("star_rating")).alias("avg_star_rating"),
        _or_zero(F.avg(tx.has_metadata(*FACET_FLAGS)) * 100).alias("metadata_coverage"),
        F.count(F.lit(1)).alias("total_results"),
    ).withColumn("num_queries", queries.agg(F.count(F.lit(1))).scalar())


def compare(queries: DataFrame, hits: DataFrame, base: str, tuned: str) -> DataFrame:
    """Two spaces side by side, one row per query, from one pass over the hits of both."""

    def mean(space: str, col: str) -> Column:
        return F.avg(F.when(F.col("space") == space, F.col(col)))

    sides = hits.groupBy("query_id").agg(
        mean(base, "score").alias("_bs"),
        mean(tuned, "score").alias("_ts"),
        mean(base, "star_rating").alias("_br"),
        mean(tuned, "star_rating").alias("_tr"),
    )
    out = queries.join(sides, "query_id", "left").select(
        *queries.columns,
        _or_zero(F.col("_bs")).alias("baseline_avg_score"),
        _or_zero(F.col("_ts")).alias("finetuned_avg_score"),
        _or_zero(F.col("_br")).alias("baseline_avg_rating"),
        _or_zero(F.col("_tr")).alias("finetuned_avg_rating"),
    )
    return out.withColumn("score_improvement", tx.improvement_pct("finetuned_avg_score", "baseline_avg_score"))


MEANS = ("baseline_avg_score", "finetuned_avg_score", "baseline_avg_rating", "finetuned_avg_rating")


def _means() -> list[Column]:
    return [F.avg(c).alias(c) for c in MEANS] + [F.avg("score_improvement").alias("avg_improvement")]


def by_category(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("category").agg(F.count(F.lit(1)).alias("count"), *_means())


def over_queries(comparison: DataFrame) -> DataFrame:
    """Means in which every query weighs the same."""
    return comparison.agg(*[_or_zero(F.avg(c)).alias(c) for c in MEANS], _or_zero(F.avg("score_improvement")).alias("avg_improvement"))


def direction(c: Column) -> Column:
    return F.when(c > 0, F.lit(BETTER)).when(c < 0, F.lit(WORSE)).otherwise(F.lit(UNCHANGED))


def verdict(c: Column, which: int) -> Column:
    out = F.when(c > VERDICTS[0][0], F.lit(VERDICTS[0][which]))
    for row in VERDICTS[1:]:
        out = out.when(c > row[0], F.lit(row[which]))
    return out.otherwise(F.lit(VERDICT_ELSE[which - 1]))


def report(comparison: DataFrame) -> DataFrame:
    """The rows of the evaluation report: known categories in report order, then the overall row with its verdict.

    Both levels come from one rollup over the per-query rows.
    """
    rolled = comparison.rollup("category").agg(
        F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("count"), *_means()
    )
    titled = rolled.join(F.broadcast(catalog.category_titles(comparison.sparkSession)), "category", "left")
    overall = F.col("_all") == 1
    change = F.col("avg_improvement")
    return titled.where(overall | F.col("title").isNotNull()).select(
        F.when(overall, F.lit(len(catalog.CATEGORY_TITLES))).otherwise(F.col("title_rank")).alias("row_rank"),
        F.when(overall, F.lit("overall")).otherwise(F.col("category")).alias("section"),
        "title",
        "count",
        *MEANS,
        "avg_improvement",
        direction(change).alias("direction"),
        F.when(overall, verdict(change, 1)).alias("status"),
        F.when(overall, verdict(change, 2)).alias("recommendation"),
    )


def ir_metrics(queries: DataFrame, hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG at ``k`` per query against a table of relevant ``query_id, row_id``."""
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    judged = hits.where(F.col("rank") <= k).join(relevant.withColumn("_rel", F.lit(1)), ["query_id", "row_id"], "left")
    found = F.col("_rel").isNotNull()
    gained = judged.groupBy("query_id").agg(
        F.sum(found.cast("int")).alias("_found"),
        F.min(F.when(found, F.col("rank"))).alias("_first"),
        F.sum(F.when(found, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
    )
    joined = queries.select("query_id").join(totals, "query_id", "left").join(gained, "query_id", "left")
    n_rel = F.coalesce(F.col("relevant"), F.lit(0))
    n_found = F.coalesce(F.col("_found"), F.lit(0))
    best = F.when(n_rel > 0, F.least(n_rel, F.lit(k)))
    ideal = F.aggregate(F.sequence(F.lit(1), best.cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return joined.select(
        "query_id",
        n_rel.cast("bigint").alias("num_relevant"),
        n_found.cast("bigint").alias("num_found"),
        (n_found / F.lit(float(k))).alias("precision_at_k"),
        _or_zero(n_found / F.when(n_rel > 0, n_rel)).alias("recall_at_k"),
        _or_zero(1.0 / F.col("_first")).alias("reciprocal_rank"),
        _or_zero(F.col("_dcg") / ideal).alias("ndcg_at_k"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Count and share (percent) of each rating."""
    counts = reviews.groupBy("star_rating").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # over one row per rating
    return counts.select("star_rating", "n", (F.col("n") / F.sum("n").over(everything) * 100).alias("share_pct")).orderBy("star_rating")


def facet_groups(reviews: DataFrame, min_members: int = 1) -> DataFrame:
    """``facet, value, n`` for the facets that training pairs are grouped by."""
    members = facet_members(reviews)
    return members.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_members)


def facet_values(facets: list[str]) -> Column:
    """All tags of a review as one list of ``(facet, value)``."""

    def named(facet: str) -> Column:
        return F.transform(facet, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    return F.flatten(F.array(*[named(f) for f in facets]))


def facet_members(reviews: DataFrame, id_col: str = "review_id") -> DataFrame:
    """One row per review and tag of the facets that training pairs are grouped by."""
    tagged = facet_values(list(FACET_FLAGS))
    return reviews.select(id_col, F.explode(tagged).alias("t")).select(id_col, "t.facet", "t.value")
