import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishlens.operators import topk
from dishlens.operators.encode import Space, check_same_space, e5_prefixes, encode, encode_with, fit_idf, normalized, refitted
from dishlens.operators.filters import Filters
from dishlens.operators.lsh import approximate_top_k, recall
from dishlens.operators.topk import top_k
from dishlens.plans import retrieval as rt
from dishlens.sources import sinks

RNG = np.random.default_rng(7)
VECTORS = RNG.normal(size=(400, 8))
VECTORS[5] = VECTORS[6] = VECTORS[300]  # equal scores
VECTORS[7] = 0.0
QUERIES = np.vstack([RNG.normal(size=(9, 8)), VECTORS[300]])


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (i, [float(x) for x in v], 1 + i % 5, ["Thai", "isan"] if i % 3 == 0 else [], ["tea"] if i % 2 == 0 else ["coffee"], ["nan"] if i % 7 == 0 else [], [])
        for i, v in enumerate(VECTORS)
    ]
    schema = "row_id bigint, vector array<double>, star_rating int, cuisine_type array<string>, food_type array<string>, location array<string>, price_level array<string>"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(QUERIES)], "query_id bigint, vector array<double>").cache()


def brute(k, keep=lambda q, i: True):
    scores = np.round(QUERIES @ VECTORS.T, 9) + 0.0
    out = set()
    for q in range(len(QUERIES)):
        order = sorted((i for i in range(len(VECTORS)) if keep(q, i)), key=lambda i: (-scores[q, i], i))[:k]
        out |= {(q, r + 1, i, round(float(scores[q, i]), 6)) for r, i in enumerate(order)}
    return out


def hits(df):
    return {(r.query_id, r["rank"], r.row_id, round(r.score, 6)) for r in df.collect()}


def test_dense_equals_brute_force(corpus, asked):
    assert hits(top_k(corpus, asked, 5).rows) == brute(5)
    assert hits(top_k(corpus.repartition(1), asked, 3).rows) == brute(3)


def test_more_than_there_are(corpus, asked):
    assert hits(top_k(corpus, asked, 1000).rows) == brute(1000)


def test_large_query_table_goes_in_blocks(corpus, asked):
    found = top_k(corpus, asked, 5, max_block_queries=4)
    assert found.at_most is None
    assert hits(found.rows) == brute(5)
    assert found.with_payload(corpus).count() == 50


def test_float_vectors(corpus, asked):
    single = corpus.withColumn("vector", F.col("vector").cast("array<float>"))
    assert top_k(single, asked, 5).rows.count() == 50


def filtered_queries(asked):
    n = F.col("query_id")
    return asked.select(
        "*",
        (n % 6).cast("int").alias("min_rating"),
        F.when(n % 2 == 0, F.lit("THAI")).otherwise(F.lit("")).alias("cuisine_type"),
        F.when(n % 3 == 0, F.lit("tea")).alias("food_type"),
        F.when(n == 9, F.lit("nowhere")).alias("location"),
    )


def passes(q, i):
    return (
        (q % 6 == 0 or 1 + i % 5 >= q % 6) and (q % 2 or i % 3 == 0) and (q % 3 or i % 2 == 0) and q != 9
    )


def test_filter_before_search(corpus, asked):
    want = brute(5, passes)
    assert hits(rt.search_filtered(corpus, filtered_queries(asked), 5, "pre")) == want
    assert hits(top_k(corpus, filtered_queries(asked), 5, max_block_queries=4, filtered=True).rows) == want


def test_filter_after_search_finds_no_more(corpus, asked):
    pre = rt.search_filtered(corpus, filtered_queries(asked), 5, "pre").groupBy("query_id").count()
    post = rt.search_filtered(corpus, filtered_queries(asked), 5, "post")
    wide = {(q, i) for q, _, i, _ in brute(15)}
    rows = post.collect()
    assert rows and all((r.query_id, r.row_id) in wide and passes(r.query_id, r.row_id) for r in rows)
    most = {r.query_id: r["count"] for r in pre.collect()}
    assert all(n <= most[q] for q, n in Counter(r.query_id for r in rows).items())
    for q in {r.query_id for r in rows}:
        assert sorted(r["rank"] for r in rows if r.query_id == q) == list(range(1, sum(r.query_id == q for r in rows) + 1))


def test_one_filter_for_all(corpus, asked):
    got = rt.search_filtered(corpus, asked, 5, "pre", Filters(min_rating=4, food_type="TEA", location=""))
    assert hits(got) == brute(5, lambda q, i: 1 + i % 5 >= 4 and i % 2 == 0)
    assert Filters().conditions() == [] and Filters(min_rating=0, cuisine_type="").conditions() == []


def test_own_k_per_query(corpus, asked):
    own = asked.withColumn("k", (1 + F.col("query_id") % 3).cast("int"))
    for mode in ("pre", "post"):
        got = Counter(r.query_id for r in rt.search_filtered(corpus, own, 3, mode).collect())
        assert got == {q: 1 + q % 3 for q in range(10)}


def test_each_task_keeps_what_a_query_wants(spark, corpus, asked):
    """One query that wants very many rows leaves the others' shares as small as they are."""
    own = asked.withColumn("k", F.when(F.col("query_id") == 0, F.lit(300)).otherwise((F.col("query_id") % 3).cast("int")))
    got = Counter(r.query_id for r in top_k(corpus, own, 5).rows.collect())
    assert got == {q: 300 if q == 0 else q % 3 for q in range(10) if q == 0 or q % 3}
    columns = own.where("k > 0").select("query_id", "k", "vector").toArrow()
    rows = [b for b in corpus.select("row_id", "vector").toArrow().to_batches()]
    kept = Counter(topk.QueryBlock(columns).best(iter(rows))["query_id"].to_pylist())
    assert kept == got


def test_hits_are_merged_by_share_first(spark, corpus, asked, monkeypatch):
    want = sorted(map(tuple, top_k(corpus, asked, 4).rows.collect()))
    monkeypatch.setattr(topk, "SHARES", 3)
    found = top_k(corpus.repartition(12), asked, 4).rows
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "query_id#" in plan and "share#" in plan


def test_only_folders_that_hold_hits_are_read(spark, corpus, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHELF_ROWS", 10)
    payload = sinks.write_payload(corpus.drop("vector"), str(tmp_path / "payload"))
    assert payload.shelves == 40 and payload.rows.select(F.input_file_name()).distinct().count() > 35
    few = top_k(corpus, asked.where("query_id < 2"), 3)
    ids = [r.row_id for r in few.rows.select("row_id").distinct().collect()]
    near = payload.near(few.rows)
    assert near.select(F.input_file_name()).distinct().count() <= len(ids)
    assert "PartitionFilters: [" in near._jdf.queryExecution().toString() and "shelf" in near._jdf.queryExecution().toString()
    want = {(r.query_id, r.row_id, r["rank"], r.star_rating, tuple(r.food_type)) for r in few.with_payload(corpus).collect()}
    assert {(r.query_id, r.row_id, r["rank"], r.star_rating, tuple(r.food_type)) for r in few.with_payload(payload).collect()} == want


def test_lsh_recall_is_bounded(corpus, asked):
    a, b = normalized(corpus.where("row_id <> 7")), normalized(asked)
    got = recall(top_k(a, b, 5).rows, approximate_top_k(a, b, 5)).collect()
    assert len(got) == 10 and all(0 <= r.recall <= 1 and r.n_exact == 5 for r in got)
    assert sum(r.n_candidates for r in got) / (10 * 399) < 0.6  # 8 numbers a vector: planes tell little apart
    assert next(r for r in got if r.query_id == 9).n_found >= 3  # its own vector and the two equal ones


def test_lsh_prunes_and_finds_close_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2_000, 64))
    near = base[:20] + 0.2 * rng.normal(size=(20, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "row_id bigint, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "query_id bigint, vector array<double>")
    got = approximate_top_k(normalized(rows), normalized(asked), 1).collect()
    assert {r.query_id: r.row_id for r in got} == {i: i for i in range(20)}
    assert max(r.n_candidates for r in got) < 0.2 * 2_000


def test_lsh_recall_of_rows(spark):
    """On the given vectors, against brute force; the row itself, which every search finds, is left out as well."""
    import __spark_entry__ as entry

    got = entry.queries()["lsh_recall"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) > 20 and all(r.query_id % 20 == 0 and r.n_exact == 5 for r in got)
    assert sum(r.n_found for r in got) >= 0.9 * 5 * len(got)
    assert sum(r.n_found - 1 for r in got) >= 0.9 * 4 * len(got)


SPACE = Space("base", passage_prefix="passage: ", query_prefix="query: ", dim=97)
TEXTS = ["The cat, the hat & the café!", "", "ร้าน อาหาร ร้าน", "cat cat dog 2024"]


def expected(text, dim, idf=None):
    words = [w for w in re.sub(r"[\W_]+(?<![฀-๿])", " ", text.lower()).split(" ") if w]
    tf = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words)
    raw = {f: n * (idf[f] if idf else 1.0) for f, n in tf.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {f: v / norm for f, v in raw.items()}


def vectors(df):
    return {r.id: dict(zip(r.features, r.weights)) for r in df.collect()}


def test_hashed_vectors(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, t string")
    got = vectors(encode(df, "t", SPACE, "passage"))
    for i, text in enumerate(TEXTS):
        assert got[i] == pytest.approx(expected("passage: " + text, SPACE.dim))
    bare = Space("bare", dim=97)
    assert vectors(encode(df, "t", bare, "query"))[1] == {}


def test_fitted_space(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, t string")
    plain = encode(df, "t", SPACE, "passage")
    fitted = fit_idf(plain, SPACE, "tuned")
    again = vectors(encode(df, "t", fitted, "passage"))
    for i, v in vectors(refitted(plain, fitted)).items():
        assert v == pytest.approx(again[i])
        assert v == pytest.approx(expected("passage: " + TEXTS[i], SPACE.dim, fitted.idf))
    passage = int(hashlib.md5(b"passage").hexdigest()[:8], 16) % SPACE.dim
    assert fitted.idf[passage] == pytest.approx(1.0)


def test_trigrams_for_scripts_without_spaces(spark):
    df = spark.createDataFrame([(0, "ชาบู"), (1, "ab")], "id bigint, t string")
    got = vectors(encode(df, "t", Space("tri", dim=1000, tokens="trigrams"), "passage"))
    assert len(got[0]) == 2 and got[1] == {}


def test_spaces_must_agree():
    assert e5_prefixes("a", "x/multilingual-E5-base").query_prefix == "query: "
    assert e5_prefixes("a", "my/model").passage_prefix == ""
    with pytest.raises(ValueError, match="cannot search"):
        check_same_space(SPACE, Space("base"))


def test_model_of_the_caller(spark):
    def load():
        return lambda texts: np.array([[len(t), 0.0] if "zero" not in t else [0.0, 0.0] for t in texts])

    df = spark.createDataFrame([(i, f"text {i}" if i else "zero") for i in range(10)], "id bigint, t string")
    got = {r.id: r.vector for r in encode_with(df, "id", "t", load, SPACE, "query", batch_size=3).collect()}
    assert got[0] == [0.0, 0.0] and got[4] == [1.0, 0.0] and len(got) == 10


def test_requests_with_modes(spark, processed, tmp_path):
    index, spaces = rt.build_two_spaces(processed, SPACE, str(tmp_path / "i"))
    q = spark.createDataFrame(
        [(1, "steak", 2, "base", 0, "", ""), (2, "coffee tea", 3, "compare", 4, "", ""), (3, "sea", 3, "finetuned", 0, "ไทย", ""), (4, "  ", 3, "base", 0, "", "")],
        "query_id bigint, query string, k int, mode string, min_rating int, cuisine_type string, food_type string",
    )
    payload = rt.payload_rows(processed)
    texts, found = rt.search_and_answer(index, spaces, q, payload=payload)
    rows = {(r.query_id, r.side): r for r in texts.collect()}
    assert set(rows) == {(1, "base"), (2, "base"), (2, "tuned"), (3, "tuned")}
    assert rows[(1, "base")].num_results == 2 and rows[(3, "tuned")].num_results == 1
    assert {r.row_id for r in found.where("query_id = 3").collect()} == {3}
    only_base = {"base": spaces["base"]}
    texts, found = rt.search_and_answer(rt.in_space(index, "base"), only_base, q, payload=payload)
    rows = {(r.query_id, r.side): r.answer for r in texts.collect()}
    assert "Fine-tuned" in rows[(2, "tuned")] and rows[(3, "tuned")].startswith("จากการค้นหา")


def test_missing_space_falls_back(spark):
    asked = spark.createDataFrame([(1, "base"), (2, "tuned"), (3, None)], "query_id bigint, space string")
    assert {r.query_id: r.used_space for r in rt.resolve_spaces(asked, ["base"]).collect()} == {1: "base", 2: "base", 3: "base"}
    assert {r.query_id: r.used_space for r in rt.resolve_spaces(asked, {"base": 0, "tuned": 0}).collect()} == {1: "base", 2: "tuned", 3: "base"}


def test_rerank_by_coverage(spark, processed):
    index = processed.withColumnRenamed("review_id", "row_id")
    q = spark.createDataFrame([(1, "great steak staff")], "query_id bigint, query string")
    h = spark.createDataFrame([(1, 1, 4, 0.9), (1, 2, 1, 0.5), (1, 3, 2, 0.4)], "query_id bigint, rank int, row_id bigint, score double")
    got = rt.rerank(q, index.join(h, "row_id"), 2).orderBy("rank").collect()
    assert [(r.row_id, r.first_rank, r.coverage) for r in got] == [(1, 2, 1.0), (4, 1, 0.0)]


def test_unrated_rows_stay_for_queries_without_a_bound(spark):
    rows = [(i, [1.0, i / 10], None if i % 2 else 4) for i in range(8)]
    corpus = spark.createDataFrame(rows, "row_id bigint, vector array<double>, star_rating int")
    q = spark.createDataFrame([(1, [0.0, 1.0], None), (2, [0.0, 1.0], 3), (3, [0.0, 1.0], 0)], "query_id bigint, vector array<double>, min_rating int")
    for mode in ("pre", "post"):
        found = rt.search_filtered(corpus, q, 8, mode).collect()
        assert {i: sorted(r.row_id for r in found if r.query_id == i) for i in (1, 2, 3)} == {1: list(range(8)), 2: [0, 2, 4, 6], 3: list(range(8))}


@pytest.mark.parametrize("broken", [1, 5, 30])
def test_vectors_that_are_no_numbers_take_no_places(spark, broken):
    rows = [(i, [float("nan"), 1.0] if i < broken else [float(i), 1.0]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "row_id bigint, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(n, [1.0, float(n)]) for n in range(3)], "query_id bigint, vector array<double>")
    got = top_k(corpus, q, 5).rows.collect()
    assert {n: sorted(r.row_id for r in got if r.query_id == n) for n in range(3)} == {n: [55, 56, 57, 58, 59] for n in range(3)}


def test_queries_without_overlap_get_the_first_rows(spark, processed):
    index = rt.build_index(processed, SPACE)
    q = spark.createDataFrame([(1, "zzzz")], "query_id bigint, query string")
    bare = Space("base", passage_prefix=SPACE.passage_prefix)
    got = top_k(index, encode(q, "query", bare, "query"), 3).rows.orderBy("rank").collect()
    assert [(r.row_id, r.score) for r in got] == [(i, 0.0) for i in sorted(r.review_id for r in processed.collect())[:3]]


@pytest.mark.parametrize("mode", ["pre", "post"])
def test_every_request_gets_its_own_k(spark, processed, tmp_path, mode):
    index, spaces = rt.build_two_spaces(processed, SPACE, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "good food", 1, "base"), (2, "good food", 7, "base")], "query_id bigint, query string, k int, mode string")
    payload = sinks.write_payload(rt.payload_rows(processed), str(tmp_path / "payload"))
    texts, _ = rt.search_and_answer(index, spaces, q, mode, payload)
    assert {r.query_id: r.num_results for r in texts.collect()} == {1: 1, 2: 7}


def test_an_index_of_another_space_is_refused(spark, processed):
    index = rt.build_index(processed, Space("base"))
    q = spark.createDataFrame([(1, "good food", 1, "base")], "query_id bigint, query string, k int, mode string")
    with pytest.raises(ValueError, match="not made in space"):
        rt.search_and_answer(index, {"base": SPACE}, q)


def test_lsh_candidates_are_counted_and_ranked_without_listing_them(spark):
    """Against pairs listed one by one, whatever the blocks: rows of two lengths, empty, null and repeated ones."""
    from dishlens.operators import lsh

    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=8).tolist() for _ in range(300)] + [rng.normal(size=5).tolist() for _ in range(20)] + [[], None, [float("nan")] * 8]
    table = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[4])]
    rows = spark.createDataFrame(table, "row_id bigint, vector array<double>")
    asked = rows.where("row_id % 7 = 0").selectExpr("row_id AS query_id", "vector")
    want = {}
    for query, v in ((i, v) for i, v in table if i % 7 == 0 and v):
        mine = []
        for i, x in table:
            if x and len(x) == len(v):
                sides = [(np.array(y) @ lsh.planes(len(v), 6, 3) > 0).reshape(6, 3) for y in (v, x)]
                if (sides[0] == sides[1]).all(axis=1).any():
                    mine.append((-round(float(np.dot(v, x)), 9), i))
        hits = sorted(h for h in mine if h[0] == h[0])[:4]
        want[query] = len(mine), [i for _, i in hits]
    for cells in (lsh.MAX_BLOCK_CELLS, 200):
        got = {}
        for r in sorted(approximate_top_k(rows, asked, 4, bands=6, bits=3, max_block_cells=cells).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, (r.n_candidates, []))[1].append(r.row_id)
        assert got == {q: w for q, w in want.items() if w[1]}
    empty = approximate_top_k(rows, asked.where("query_id < 0"), 4)
    assert empty.count() == 0


def test_rows_are_encoded_some_at_a_time(spark):
    """What a task holds does not follow the size of a batch, and the vectors are those of one row at a time."""
    import pyarrow as pa

    from dishlens.operators import encode as en

    buckets = pa.array([[i % 7, i % 5, i % 7] if i % 4 else [] for i in range(1_000)], pa.list_(pa.int32()))
    pieces = list(en._counted(None)(iter([buckets])))
    assert max(len(p) for p in pieces) <= en.STEP_ROWS and sum(len(p) for p in pieces) == 1_000
    assert pa.concat_arrays(pieces).to_pylist() == [p.to_pylist()[0] for i in range(1_000) for p in en._counted(None)(iter([buckets.slice(i, 1)]))]
