import re

import pytest
from pyspark.sql import functions as F

from dishlens.functions import text as tx
from dishlens.plans.preprocess import clean_reviews

CASES = [
    None,
    "",
    "a" * 19,
    "a" * 20,
    "a" * 21,
    " \t\n\r ",
    " one　two\u001cthree four five six ",
    "zero width​space is no white space",
    "ก๋วยเตี๋ยวเส้นเล็ก อร่อย  มาก",
    "emoji 😀😀 count as one character each",
    "  two  runs \n of   space in here  ",
    "x" * 500,
    "x" * 299 + " y",
    "line\x0bfeed\x0cform\x85next sep sep sep",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "id int, t string")


def expected_clean(text):
    if text is None:
        return ""
    out = re.sub(r"\s+", " ", text).strip()
    return out if len(out) >= 20 else ""


def test_clean_equals_python(spark):
    got = {r.id: r.c for r in frame(spark).select("id", tx.clean_review("t").alias("c")).collect()}
    assert got == {i: expected_clean(t) for i, t in enumerate(CASES)}


def test_cleaning_twice_changes_nothing(spark):
    once = tx.clean_review("t")
    rows = frame(spark).select(once.alias("a"), tx.clean_review(once).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_clean_reviews_drops_null_and_short(spark):
    df = frame(spark).select(F.col("id").alias("review_id"), F.col("t").alias("review_text"), F.lit(3).alias("star_rating"))
    got = {r.review_id: r.review_text for r in clean_reviews(df).collect()}
    assert got == {i: expected_clean(t) for i, t in enumerate(CASES) if expected_clean(t)}


def test_strip_and_excerpt_equal_python(spark):
    rows = frame(spark).where("t is not null").select("id", tx.strip("t").alias("s"), tx.excerpt("t", 30).alias("e"), tx.excerpt("t", 30, stripped=False, ellipsis=False).alias("p")).collect()
    for r in rows:
        t = CASES[r.id]
        assert r.s == t.strip()
        assert r.e == t[:30].strip() + ("..." if len(t) > 30 else "")
        assert r.p == t[:30]


def test_query_line(spark):
    df = spark.createDataFrame([("  a|b |  c　d ",)], "t string")
    assert df.select(tx.normalize_query("t").alias("q")).first().q == "a b c d"
    terms = spark.createDataFrame([("Thai thai ab　noodle",)], "t string").select(tx.query_terms("t").alias("x")).first().x
    assert terms == ["thai", "noodle"]


def test_stars_and_percent(spark):
    rows = spark.createDataFrame([(3, 0.885), (0, 0.125), (5, 0.5)], "r int, s double").select(
        tx.stars("r").alias("a"), tx.star_slots("r").alias("b"), tx.percent("s").alias("p"), tx.percent("s", 1).alias("p1"), tx.signed_percent("s").alias("sp")
    ).collect()
    assert [(r.a, r.b) for r in rows] == [("***", "★★★☆☆"), ("", "☆☆☆☆☆"), ("*****", "★★★★★")]
    assert [r.p for r in rows] == [f"{v:.0%}" for v in (0.885, 0.125, 0.5)]
    assert rows[0].p1 == "88.5%" and rows[2].sp == "+0.5%"


def test_search_text_skips_empty_facets(spark):
    df = spark.createDataFrame(
        [("r" * 501, ["thai"], [], ["cafe", "cozy"]), ("plain", [], [], [])],
        "t string, a array<string>, b array<string>, c array<string>",
    )
    got = [r.s for r in df.select(tx.search_text("t", ["a", "b", "c"]).alias("s")).collect()]
    assert got == ["thai cafe, cozy: " + "r" * 501, "plain"]
    opening = df.select(tx.search_text("t", ["a", "b", "c"], tx.SEARCH_TEXT_CHARS).alias("s")).collect()
    assert [r.s for r in opening] == ["thai cafe, cozy: " + "r" * 500, "plain"]


def test_label_line(spark):
    df = spark.createDataFrame([(["thai", "isan"], [], ["nan"]), ([], [], [])], "a array<string>, b array<string>, c array<string>")
    got = [r.s for r in df.select(tx.label_line("a", "b", "c").alias("s")).collect()]
    assert got == [tx.LABEL_CUISINE + "thai, isan | " + tx.LABEL_LOCATION + "nan", ""]


@pytest.mark.parametrize("base,tuned,want", [(0.5, 0.6, 20.0), (0.0, 0.0, 0.0), (0.0, 0.3, 100.0), (-0.2, -0.1, 100.0), (0.4, 0.2, -50.0)])
def test_improvement(spark, base, tuned, want):
    df = spark.createDataFrame([(base, tuned)], "b double, t double")
    assert df.select(tx.improvement_pct("t", "b").alias("x")).first().x == pytest.approx(want)
