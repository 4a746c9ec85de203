"""Text answers, prompts and display records from ranked hits.

All aggregates are over the k hits of a query, so a group is never larger than k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.functions import text as tx

# The wording of answers and prompts.
NOT_FOUND = "ไม่พบข้อมูลที่ตรงกับคำถามของคุณ"
TUNED_MISSING = "(โมเดล Fine-tuned ไม่พร้อมใช้งาน)"
ANSWER_HEAD = 'จากการค้นหา "%s" พบ %d ร้านที่เกี่ยวข้อง:\n'
ANSWER_HIT = "\nร้านที่ %d (Rating: %d/5 %s, ความเกี่ยวข้อง: %s)"
ANSWER_REVIEW = "รีวิว: "
ANSWER_RULE = "-" * 50
PROMPT_SYSTEM = (
    "คุณเป็นผู้เชี่ยวชาญแนะนำร้านอาหาร ตอบคำถามจากข้อมูลรีวิวที่ให้มา "
    "ตอบเป็นภาษาไทย กระชับ ให้ข้อมูลครบ ระบุ star rating ของแต่ละร้านด้วย"
)
PROMPT_USER = "คำถาม: %s\n\nข้อมูลรีวิว:\n%s"
PROMPT_REVIEW = "รีวิว %d (Rating: %d/5): %s"


def _rating() -> Column:
    return F.coalesce(F.col("star_rating"), F.lit(0))


def answer_block() -> Column:
    """The lines of one hit."""
    head = F.format_string(ANSWER_HIT, F.col("rank"), _rating(), tx.stars(_rating()), tx.percent("score", 0))
    labels = tx.label_line("cuisine_type", "food_type", "location")
    review = F.concat(F.lit(ANSWER_REVIEW), tx.excerpt(F.coalesce(F.col("review_text"), F.lit("")), tx.ANSWER_EXCERPT_CHARS))
    return F.concat_ws("\n", head, F.nullif(labels, F.lit("")), review, F.lit(ANSWER_RULE))


def prompt_block() -> Column:
    text = tx.excerpt(F.coalesce(F.col("review_text"), F.lit("")), tx.PROMPT_EXCERPT_CHARS, stripped=False, ellipsis=False)
    return F.format_string(PROMPT_REVIEW, F.col("rank"), _rating(), text)


def in_rank_order(block: Column, sep: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return F.array_join(F.transform(ordered, lambda x: x["block"]), sep)


def template_answers(queries: DataFrame, hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``query_id, query, num_results, answer``; queries without hits get the not-found text.

    ``by`` adds columns both sides share, such as the space searched.
    """
    keys = ["query_id", *(by or [])]
    blocks = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), in_rank_order(answer_block(), "\n").alias("_body"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    answer = F.when(n == 0, F.lit(NOT_FOUND)).otherwise(
        F.concat(F.format_string(ANSWER_HEAD, F.col("query"), n), F.lit("\n"), F.col("_body"))
    )
    return queries.join(blocks, keys, "left").select(*keys, "query", n.alias("num_results"), answer.alias("answer"))


def answer_prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, messages``: the chat messages a model outside would answer; null where nothing was found."""
    context = hits.groupBy("query_id").agg(in_rank_order(prompt_block(), "\n\n").alias("_context"))
    user = F.format_string(PROMPT_USER, F.col("query"), F.col("_context"))
    message = [F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(PROMPT_SYSTEM)), ("user", user))]
    found = F.col("_context").isNotNull()
    return queries.join(context, "query_id", "left").select("query_id", F.when(found, F.array(*message)).alias("messages"))


def routed_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, answer, messages``: queries with ``use_model`` and hits get messages for a model, all others a text."""
    for_model = F.coalesce(F.col("use_model"), F.lit(False))
    blocks = hits.join(queries.select("query_id", for_model.alias("_m")), "query_id")
    texts = template_answers(queries, blocks.where(~F.col("_m"))).select("query_id", "answer")
    prompts = answer_prompts(queries, blocks.where("_m"))
    both = texts.join(prompts, "query_id")
    return both.select("query_id", F.when(F.col("messages").isNull(), F.col("answer")).alias("answer"), "messages")


def answer_preview(answer: Column | str) -> Column:
    return tx.excerpt(answer, tx.PREVIEW_CHARS, stripped=False)


def display_rows(hits: DataFrame) -> DataFrame:
    """One row per hit with what a result card shows."""

    def first(facet: str, n: int) -> Column:
        return F.slice(F.coalesce(F.col(facet), F.array().cast("array<string>")), 1, n).alias(f"{facet}_shown")

    text = F.coalesce(F.col("review_text"), F.lit(""))
    return hits.select(
        "query_id",
        "rank",
        "row_id",
        _rating().alias("star_rating"),
        tx.stars(_rating()).alias("star_display"),
        tx.star_slots(_rating()).alias("star_slots"),
        "score",
        tx.percent("score", 1).alias("relevance"),
        first("cuisine_type", 3),
        first("food_type", 3),
        first("location", 2),
        tx.excerpt(text, tx.CARD_EXCERPT_CHARS, stripped=False).alias("review_shown"),
    )


RECORD_LISTS = ("cuisine_type", "food_type", "atmosphere", "price_level", "location", "mentioned_foods")


def nested_results(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, query, answer, num_results, results``: the hits of a query as one ordered list of records."""
    record = F.struct(
        "rank",
        F.coalesce(F.col("review_text"), F.lit("")).alias("review_text"),
        _rating().alias("star_rating"),
        tx.stars(_rating()).alias("star_display"),
        F.col("score").alias("relevance_score"),
        *[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in RECORD_LISTS if c in hits.columns],
    )
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(record)).alias("results"))
    return answers.join(lists, "query_id", "left").select("query_id", "query", "answer", "num_results", "results")
