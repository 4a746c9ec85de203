import os

import pytest
from pyspark.sql import functions as F

from dishlens.config import Settings
from dishlens.functions import text as tx
from dishlens.operators.encode import Space
from dishlens.plans import jobs
from dishlens.plans import retrieval as rt
from dishlens.plans.preprocess import counted_cleaning, run_preprocessing
from dishlens.sources import catalog, readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_reviews_csv(spark, tmp_path):
    path = write(tmp_path / "r.csv", '"two\nlines; and ""quotes""";4\nplain text;5\nNA;3\n;2\n')
    rows = readers.read_reviews_csv(spark, path).orderBy("review_id").collect()
    assert [(r.review_text, r.star_rating) for r in rows] == [('two\nlines; and "quotes"', 4), ("plain text", 5)]
    assert len({r.review_id for r in rows}) == 2


@pytest.mark.parametrize("line", ["fine text;4.5\n", "fine text;x\n", "fine text;\n", "fine text;NA\n"])
def test_bad_rating_fails(spark, tmp_path, line):
    with pytest.raises(Exception):
        readers.read_reviews_csv(spark, write(tmp_path / "r.csv", line)).collect()


def test_dictionary(spark, tmp_path):
    path = write(tmp_path / "d.txt", " rice \n\n　\nabc\nnoodle\nrice\n" + "x" * 51 + "\nข้าวผัด\n")
    terms = readers.read_dictionary(spark, path)
    assert [r.term for r in terms.orderBy("rank").collect()] == ["rice", "abc", "noodle", "rice", "x" * 51, "ข้าวผัด"]
    assert [r.term for r in readers.prepare_dictionary(terms).orderBy("rank").collect()] == ["rice", "noodle", "ข้าวผัด"]
    assert [r.term for r in readers.prepare_dictionary(terms, limit=1).collect()] == ["rice"]


def test_queries(spark, tmp_path):
    path = write(tmp_path / "q.txt", "a|b  c\n\n   \n||\n")
    queries = readers.read_queries(spark, path)
    assert [r.query for r in queries.orderBy("query_id").collect()] == ["a b c", ""]
    assert rt.asked(queries).count() == 1


def test_ids_do_not_follow_splits(spark, tmp_path):
    """Many files and lines, read in large and in small splits: ids are places in the files, by file name."""
    folder = tmp_path / "lines"
    folder.mkdir()
    for f in range(5):
        write(folder / f"part-{f}.txt", "".join(f"line {f} {i} {'x' * (i % 50)}\n" for i in range(400 if f == 2 else 37)))
    want = [f"line {f} {i} {'x' * (i % 50)}".strip() for f in range(5) for i in range(400 if f == 2 else 37)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "1k", "333b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10b")
            rows = readers.read_queries(spark, str(folder)).collect()
            assert [r.query for r in sorted(rows, key=lambda r: r.query_id)] == want
            assert sorted(r.query_id for r in rows) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_stages_are_counted_while_they_are_written(spark, tmp_path):
    """One read of the reviews, whatever is counted."""
    rows = [(i, None if i % 10 == 0 else "short" if i % 10 == 1 else f"a review that is long enough {i}", 3) for i in range(100)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    reviews = spark.createDataFrame(rows, "review_id bigint, review_text string, star_rating int")
    reviews = reviews.mapInArrow(counted, reviews.schema)
    for most, sampled in ((None, 80), (30, 30)):
        before = reads.value
        cleaned, counts = counted_cleaning(reviews, most)
        assert [(r.stage, r.n) for r in counts.orderBy("stage_rank").collect()] == [("loaded", 90), ("cleaned", 80), ("sampled", sampled)]
        assert cleaned.count() == sampled and reads.value - before == 100


def test_all_steps_of_a_deployment(spark, tmp_path):
    texts = [f"The {w} soup and {w} tea were good, a fine place number {i}" for i in range(60) for w in ("thai", "steak")]
    settings = Settings(
        reviews_path=write(tmp_path / "r.csv", "".join(f'"{t}";{1 + i % 5}\n' for i, t in enumerate(texts))),
        dictionary_path=write(tmp_path / "d.txt", "soup\nsteak\n"),
        judge_queries_path=write(tmp_path / "j.txt", "thai|soup\n"),
        algo_queries_path=write(tmp_path / "a.txt", "good tea\n"),
        processed_path=str(tmp_path / "processed"),
        index_path=str(tmp_path / "index"),
        pairs_path=str(tmp_path / "pairs"),
        num_pairs=40,
        batch_size=8,
        epochs=2,
        top_k=3,
    )
    run_preprocessing(spark, settings)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    index, spaces, payload = jobs.run_indexing(spark, settings)
    mined, plan = jobs.run_training_set(spark, settings)
    assert set(os.listdir(shared)) - before == {x for x in os.listdir(shared) if x.startswith("batches-")} - before  # only the plan's table is left
    assert set(spaces) == {"base", "tuned"} and spaces["base"].query_prefix == "query: "
    assert index.count() == 240 and payload.rows.count() == 120
    assert mined.count() == 40 and plan.first().total_steps == 10
    report = jobs.run_evaluation(spark, settings).report().collect()
    assert [r["count"] for r in report if r.section == "overall"] == [26]
    queries = spark.createDataFrame([(1, "thai soup"), (2, "steak")], "query_id bigint, query string")
    got = {r.query_id: r for r in jobs.run_answers(spark, settings, queries).collect()}
    assert set(got) == {1, 2} and got[1].model == settings.answer_model and len(got[1].messages) == 2 and "thai" in got[1].answer


def test_constants(spark):
    assert catalog.evaluation_queries(spark).groupBy("category").count().orderBy("count").collect()[-1]["count"] == 6
    assert catalog.evaluation_queries(spark).count() == 26
    samples = catalog.sample_queries(spark)
    assert samples.count() == 15 and samples.where("k = 5 and mode = 'compare' and cuisine_type = '' and food_type = ''").count() == 15
    assert catalog.rating_labels(spark).where("min_rating is null").count() == 1


def test_filter_labels_resolve(spark):
    q = spark.createDataFrame([(1, "ไทย", ""), (2, "thai", "สเต๊ก")], "query_id bigint, cuisine_type string, food_type string")
    got = {r.query_id: (r.cuisine_type, r.food_type) for r in catalog.resolve_filter_labels(q).collect()}
    assert got == {1: ("thai", ""), 2: ("thai", "steak")}


def test_missing_table_says_what_to_run(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run_preprocessing"):
        readers.read_table(spark, str(tmp_path / "none"), "run_preprocessing")
    with pytest.raises(FileNotFoundError, match="write_index"):
        readers.read_index(spark, str(tmp_path / "none"))


def test_index_round_trip_keeps_spaces(spark, processed, tmp_path):
    index, spaces = rt.build_two_spaces(processed, Space("base", passage_prefix="passage: ", query_prefix="query: ", dim=64), str(tmp_path / "two"))
    sinks.write_index(index, list(spaces.values()), str(tmp_path / "i"))
    back, found = readers.read_index(spark, str(tmp_path / "i"))
    assert found == spaces
    assert {(r.space, r["count"]) for r in back.groupBy("space").count().collect()} == {("base", 8), ("tuned", 8)}
    processed.select("review_id").write.parquet(str(tmp_path / "bad" / "vectors"))
    with pytest.raises(ValueError, match="not an index"):
        readers.read_index(spark, str(tmp_path / "bad"))


def test_csv_export(spark, processed, tmp_path):
    sinks.write_csv(processed, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(str(tmp_path / "out"))
    assert back.where(F.col("review_id") == 6).first().food_type == "coffee, tea"
    assert back.count() == processed.count()


def test_whole_preprocessing(spark, tmp_path):
    reviews = "".join(f"review number {i} about steak and rice;{1 + i % 5}\n" for i in range(30)) + "short;3\n"
    settings = Settings(
        reviews_path=write(tmp_path / "r.csv", reviews),
        dictionary_path=write(tmp_path / "d.txt", "steak\nrice\nsoup\n"),
        judge_queries_path=write(tmp_path / "j.txt", "steak|rice\n"),
        algo_queries_path=write(tmp_path / "a.txt", "soup\n"),
        processed_path=str(tmp_path / "processed"),
        max_reviews=20,
    )
    out = run_preprocessing(spark, settings)
    assert out["processed"].count() == 20
    assert [r.n for r in out["counts"].orderBy("stage_rank").collect()] == [31, 30, 20]
    assert out["ratings"].agg(F.sum("n")).first()[0] == 20
    assert out["processed"].first().mentioned_foods == ["steak", "rice"]


def test_spread_keeps_rows(spark, reviews):
    assert readers.spread(reviews, "review_id").select(tx.stars("star_rating")).count() == 8


def test_spread_leaves_files_for_every_core_where_they_are(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    shuffles = lambda df: "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    for files in (1, cores):
        spark.range(100).repartition(files).write.parquet(str(tmp_path / str(files)))
    one, many = (readers.spread(spark.read.parquet(str(tmp_path / str(n))), "id") for n in (1, cores))
    assert shuffles(one) and not shuffles(many)
    assert one.count() == many.count() == 100
