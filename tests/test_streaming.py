from dishlens.plans.preprocess import process_reviews
from dishlens.streaming.tagging import append_to_table, tagged_stream


def test_stream_gives_the_batch_result(spark, reviews, tmp_path):
    source = str(tmp_path / "in")
    reviews.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = append_to_table(tagged_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    want = process_reviews(reviews, None).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
