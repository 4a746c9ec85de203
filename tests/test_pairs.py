import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from dishlens.operators import pairs as pr
from dishlens.operators.encode import Space, encode
from dishlens.operators.loss import in_batch_loss
from dishlens.operators.ordinals import directory, with_ordinal
from dishlens.operators.query_match import draw_matches, match_counts
from dishlens.plans.training import training_pairs

WORDS = ["steak", "tea", "soup", "thai", "nan", "plain", "room"]


@pytest.fixture(scope="module")
def table(spark):
    """Six of ten reviews share one tag, one tag has a single review, one has two."""
    rows = []
    for i in range(120):
        food = ["tea"] if i % 10 < 6 else ["soup"] if i < 20 and i % 10 == 7 else []
        cuisine = ["thai"] if i == 9 else []
        rows.append((i, f"review {i} with {WORDS[i % 7]} and {WORDS[(i * 3) % 7]}", 1 + i % 5, cuisine, food, [], f"search {i}"))
    schema = "review_id bigint, review_text string, star_rating int, cuisine_type array<string>, food_type array<string>, location array<string>, search_text string"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("steak house",), ("tea",), ("of a",), ("missing words",), ("plain room",)], "query string").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_pairs(table, queries):
    got = pr.query_pairs(table, queries, 100, seed=3).collect()
    texts = {r.review_id: r for r in table.collect()}
    assert len(got) == 30
    for r in got:
        assert any(len(t) >= 3 and t in texts[r.right_id].review_text for t in r.text_a.lower().split())
        assert r.text_b == texts[r.right_id].search_text
    assert {r.text_a for r in got} == {"steak house", "tea", "plain room"}


def test_no_query_matches(spark, table):
    none = spark.createDataFrame([("of",), ("zzz",)], "query string")
    assert pr.query_pairs(table, none, 100).count() == 0
    assert pr.query_pairs(table, none.where("false"), 100).count() == 0


def test_draws_cover_the_matches_evenly(spark, table):
    q = spark.createDataFrame([(0, "steak")], "query_id bigint, query string")
    draws = spark.range(4000).select(F.col("id").alias("j"), F.lit(0).cast("bigint").alias("query_id"))
    got = draw_matches(table, q, draws, 1, "query").groupBy("review_id").count().collect()
    matching = table.where(F.contains("review_text", F.lit("steak"))).count()
    assert len(got) == matching and max(r["count"] for r in got) < 3 * 4000 / matching


def test_counts_equal_brute_force_in_one_or_many_blocks(spark, table, queries):
    numbered = queries.withColumn("query_id", F.length("query").cast("bigint") * 10 + F.ascii("query"))
    texts = [r.review_text for r in table.collect()]
    want = {}
    for r in numbered.collect():
        n = sum(any(len(t) >= 3 and t in x.lower() for t in r.query.lower().split()) for x in texts)
        if n:
            want[r.query_id] = n
    assert dict(rows(match_counts(table, numbered))) == want
    assert dict(rows(match_counts(table, numbered, max_bytes=64))) == want
    draws = numbered.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("n")).select(
        (F.col("n") * 1000 + F.col("query_id")).alias("j"), "query_id"
    )
    whole = rows(draw_matches(table, numbered, draws, 5, "query"))
    assert whole == rows(draw_matches(table, numbered, draws, 5, "query", max_bytes=64, max_draws=60)) and whole


def test_more_queries_than_a_list_of_flags_would_take(spark, table):
    """70,000 queries at one scan, of which every tenth matches."""
    many = spark.range(70_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 10 == 0, F.lit("steak tea")).otherwise(F.concat(F.lit("none"), F.col("id").cast("string"))).alias("query"))
    counts = match_counts(table, many)
    matching = table.where("review_text LIKE '%steak%' OR review_text LIKE '%tea%'").count()
    found = counts.agg(F.count("*").alias("n"), F.min("n_matches").alias("lo"), F.max("n_matches").alias("hi")).first()
    assert (found.n, found.lo, found.hi) == (7_000, matching, matching)


def test_steps_of_places_rows_and_draws_change_nothing(spark, table, queries, monkeypatch):
    from dishlens.operators import query_match as qm

    numbered = queries.withColumn("query_id", F.length("query").cast("bigint") * 10 + F.ascii("query"))
    draws = numbered.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).select((F.col("n") * 1000 + F.col("query_id")).alias("j"), "query_id")
    want = rows(match_counts(table, numbered)), rows(draw_matches(table, numbered, draws, 5, "query"))
    for name in ("STEP_PLACES", "STEP_DRAWS", "BITMAP_ROWS"):
        monkeypatch.setattr(qm, name, 3)
    assert (rows(match_counts(table, numbered)), rows(draw_matches(table, numbered, draws, 5, "query"))) == want


def test_similar_pairs(table):
    got = pr.similar_pairs(table, 200, seed=3).collect()
    food = {r.review_id: set(r.food_type) for r in table.collect()}
    assert len(got) == 80
    assert all(r.left_id != r.right_id and food[r.left_id] & food[r.right_id] for r in got)
    soups = sum("soup" in food[r.left_id] for r in got)
    assert 20 < soups < 60  # tags are drawn evenly, not by size


def test_rating_pairs(table):
    got = pr.rating_pairs(table, 100, seed=3).collect()
    by_id = {r.review_id: r for r in table.collect()}
    assert len(got) == 30
    for r in got:
        a, b = by_id[r.left_id], by_id[r.right_id]
        assert a.star_rating >= 4 and b.star_rating >= 4 and r.left_id != r.right_id and set(a.food_type) & set(b.food_type)


def test_chunks_and_partitions_do_not_matter(table):
    want = rows(pr.similar_pairs(table, 50))
    assert rows(pr.similar_pairs(table.repartition(9), 50, chunk_rows=7)) == want
    assert rows(pr.rating_pairs(table.repartition(2), 50, chunk_rows=5)) == rows(pr.rating_pairs(table, 50))
    assert rows(pr.similar_pairs(table, 50, seed=1)) != want


def test_only_chunks_that_were_drawn_are_numbered(spark):
    """A directory finds the numbers that numbering all rows gives, and drops rows of other chunks before the shuffle."""
    df = spark.range(5_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("g"), (F.col("id") % 400).cast("string"))).alias("grp"))
    every = {(r.grp, r.ordinal): r.id for r in with_ordinal(df, ["id"], ["grp"]).collect()}
    wanted = spark.createDataFrame([("a", 0), ("a", 1_666), ("a", 700), ("a", 9_999), ("g1", 0), ("g1", 5), ("none", 0)], "grp string, ordinal long")
    for chunk_rows in (1, 16, 1_000):
        found = directory(df, ["id"], ["grp"], chunk_rows=chunk_rows)
        got = {(r.grp, r.ordinal): r.id for r in found.pick(wanted, 7).collect()}
        assert got == {k: every[k] for k in [("a", 0), ("a", 1_666), ("a", 700), ("g1", 0), ("g1", 5)] if k in every}
        assert {r.grp: r["size"] for r in found.sizes().collect()} == {g: sum(k[0] == g for k in every) for g in {k[0] for k in every}}
    plan = directory(df, ["id"], ["grp"], chunk_rows=16).pick(wanted, 7)._jdf.queryExecution().executedPlan().toString()
    window, semi = plan.index("Window"), plan.index("LeftSemi")
    assert window < semi and "Exchange hashpartitioning(grp" in plan[window:semi]  # printed from the top: the join is below the shuffle
    assert directory(df.limit(0), ["id"]).sizes().first()["size"] == 0


def test_all_pairs_fill_the_shortfall(spark, table, queries):
    none = spark.createDataFrame([("zzz",)], "query string")
    got = training_pairs(table, none, 50)
    counts = {r.strategy: r["count"] for r in got.groupBy("strategy").count().collect()}
    assert counts == {"similar": 20, "rating": 15, "fill": 15}
    assert sorted(r.pair_id for r in got.collect()) == list(range(50))
    assert got.where("left_id = right_id").count() == 0
    plan = pr.batch_plan(got)
    assert sorted(r.n_pairs for r in plan.collect()) == [2, 16, 16, 16] and plan.first().total_steps == 12


def test_too_few_reviews(table, queries):
    one = table.where("review_id = 3")
    assert pr.similar_pairs(one, 20).count() == 0
    assert pr.rating_pairs(one, 20).count() == 0
    assert pr.fill_pairs(one, one.limit(0), 20).count() == 0


def test_loss_equals_numpy(spark, table):
    space = Space("s", dim=50)
    df = table.where("review_id < 40").select(F.col("review_id").alias("pair_id"), F.col("review_text").alias("text_a"), F.col("search_text").alias("text_b"))

    def dense(col):
        out = np.zeros((40, 50))
        for r in encode(df, col, space, "query").collect():
            out[r.pair_id, r.features] = r.weights
        return out

    a, b = dense("text_a"), dense("text_b")
    got = {r.batch: (r.n_pairs, r.loss) for r in in_batch_loss(df, space).collect()}
    for batch, start in enumerate(range(0, 40, 16)):
        s = 20 * a[start : start + 16] @ b[start : start + 16].T
        want = np.mean(np.log(np.exp(s).sum(axis=1)) - np.diag(s))
        assert got[batch] == (len(s), pytest.approx(want))


def test_counts_by_bitmaps_and_by_pairs_are_the_same(spark, table, queries, monkeypatch):
    """Whichever terms have bitmaps, however many reviews and places are worked on at once, and a piece of texts at a time."""
    from dishlens.operators import query_match as qm

    numbered = queries.withColumn("query_id", F.length("query").cast("bigint") * 10 + F.ascii("query"))
    texts = [r.review_text for r in table.collect()]
    terms = {r.query_id: {t for t in r.query.lower().split() if len(t) >= 3} for r in numbered.collect()}
    want = {q: n for q, ts in terms.items() if (n := sum(any(t in x.lower() for t in ts) for x in texts))}
    for few, n_rows, places in ((1, 7, 2), (3, 70, 5), (1_000_000, 64, 1 << 15), (8, 4_096, 1)):
        for name, value in (("FEW_ROWS", few), ("COUNT_ROWS", n_rows), ("COUNT_PLACES", places)):
            monkeypatch.setattr(qm, name, value)
        block = next(qm.term_blocks(numbered, max_piece_bytes=200))
        found = dict(zip(block.query_ids.tolist(), block.count([pa.array([x.lower() for x in texts])]).tolist()))
        assert {q: n for q, n in found.items() if n} == want


def test_a_list_of_few_distinct_terms_is_one_block_however_long(spark):
    """A block holds numbers of terms; terms that many queries share are in it once."""
    from dishlens.operators.query_match import term_blocks

    words = " ".join(f"a-rather-long-term-number-{i}" for i in range(20))
    many = spark.range(2_000).select(F.col("id").alias("query_id"), F.lit(words).alias("query"))
    blocks = list(term_blocks(many, max_bytes=400_000, max_piece_bytes=200_000))
    assert len(blocks) == 1 and len(blocks[0].terms) == 20 and len(blocks[0].query_ids) == 2_000
    assert blocks[0].count([pa.array(["one a-rather-long-term-number-3", None, "none"])]).tolist() == [1] * 2_000
