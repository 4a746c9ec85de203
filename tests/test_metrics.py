import math

import pytest

from dishlens.operators import metrics

HITS = [  # query, space, rank, row, score, rating, cuisine, food, location
    (1, "base", 1, 10, 0.8, 5, ["thai"], [], []),
    (1, "base", 2, 11, 0.4, 4, [], [], []),
    (1, "tuned", 1, 11, 0.9, 4, [], ["tea"], []),
    (2, "base", 1, 12, -0.2, 1, [], [], ["nan"]),
    (2, "tuned", 1, 12, -0.1, 1, [], [], ["nan"]),
    (4, "tuned", 1, 13, 0.3, 2, [], [], []),
]
SCHEMA = "query_id bigint, space string, rank int, row_id bigint, score double, star_rating int, cuisine_type array<string>, food_type array<string>, location array<string>"


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(HITS, SCHEMA).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "cuisine", "a"), (2, "location", "b"), (3, "location", "c"), (4, "other", "d")]
    return spark.createDataFrame(rows, "query_id bigint, category string, query string").cache()


def test_per_query(queries, hits):
    got = {r.query_id: r for r in metrics.per_query(queries, hits.where("space = 'base'")).collect()}
    assert (got[1].num_results, got[1].avg_score, got[1].avg_rating, got[1].metadata_coverage) == (2, pytest.approx(0.6), 4.5, 0.5)
    assert (got[3].num_results, got[3].avg_score, got[3].avg_rating, got[3].metadata_coverage) == (0, 0.0, 0.0, 0.0)


def test_over_hits_weighs_hits(queries, hits):
    got = metrics.over_hits(queries, hits.where("space = 'base'")).first()
    assert got.avg_retrieval_score == pytest.approx((0.8 + 0.4 - 0.2) / 3)
    assert got.metadata_coverage == pytest.approx(200 / 3) and (got.num_queries, got.total_results) == (4, 3)
    none = metrics.over_hits(queries, hits.where("space = 'x'")).first()
    assert (none.avg_retrieval_score, none.total_results) == (0.0, 0)


def test_comparison(queries, hits):
    got = {r.query_id: r.score_improvement for r in metrics.compare(queries, hits, "base", "tuned").collect()}
    assert got == {1: pytest.approx(50.0), 2: 100.0, 3: 0.0, 4: 100.0}


def test_report(queries, hits):
    rows = metrics.report(metrics.compare(queries, hits, "base", "tuned")).orderBy("row_rank").collect()
    assert [(r.row_rank, r.section, r["count"]) for r in rows] == [(0, "cuisine", 1), (3, "location", 2), (5, "overall", 4)]
    assert rows[-1].avg_improvement == pytest.approx(62.5) and rows[-1].status == metrics.VERDICTS[0][1]
    assert rows[0].status is None and rows[0].direction == metrics.BETTER


@pytest.mark.parametrize("change,which", [(5.1, 0), (5.0, 1), (0.0, 2), (-4.9, 2), (-5.0, 3)])
def test_verdict_bounds(spark, change, which):
    texts = [v[1] for v in metrics.VERDICTS] + [metrics.VERDICT_ELSE[0]]
    df = spark.createDataFrame([(change,)], "x double")
    assert df.select(metrics.verdict(df.x, 1)).first()[0] == texts[which]


def test_ir_metrics(spark, queries, hits):
    relevant = spark.createDataFrame([(1, 11), (1, 99), (2, 77)], "query_id bigint, row_id bigint")
    got = {r.query_id: r for r in metrics.ir_metrics(queries, hits.where("space = 'base'"), relevant, 2).collect()}
    assert got[1].precision_at_k == 0.5 and got[1].recall_at_k == 0.5 and got[1].reciprocal_rank == 0.5
    assert got[1].ndcg_at_k == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[2].ndcg_at_k, got[2].recall_at_k, got[3].ndcg_at_k, got[3].num_relevant) == (0.0, 0.0, 0.0, 0)


def test_distribution_and_groups(processed):
    got = {r.star_rating: (r.n, r.share_pct) for r in metrics.rating_distribution(processed).collect()}
    assert got[4] == (3, 37.5) and sum(n for n, _ in got.values()) == 8
    groups = {(r.facet, r.value): r.n for r in metrics.facet_groups(processed, 2).collect()}
    assert groups[("food_type", "seafood")] == 3 and all(n >= 2 for n in groups.values())
