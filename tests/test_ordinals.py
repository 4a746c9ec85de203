import pytest
from pyspark.sql import functions as F

from dishlens.operators.ordinals import exact_sample, with_ordinal


def groups(spark):
    # one group holds most of the rows
    return spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("grp"))


def numbered(df, **kw):
    return {r.id: r.ordinal for r in with_ordinal(df, ["id"], ["grp"], **kw).collect()}


def test_dense_per_group(spark):
    rows = with_ordinal(groups(spark), ["id"], ["grp"], chunk_rows=50).groupBy("grp").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d")
    )
    assert all(r.lo == 0 and r.hi == r.n - 1 == r.d - 1 for r in rows.collect())


def test_chunks_and_partitions_do_not_matter(spark):
    want = numbered(groups(spark), chunks=1)
    assert numbered(groups(spark), chunk_rows=13) == want
    assert numbered(groups(spark).repartition(7), chunks=64) == want


def test_below_is_a_prefix(spark):
    df = spark.range(500)
    everything = {r.id: r.ordinal for r in with_ordinal(df, ["id"]).collect()}
    some = {r.id: r.ordinal for r in with_ordinal(df, ["id"], below=37, chunks=20).collect()}
    assert some == {k: v for k, v in everything.items() if v < 37}


@pytest.mark.parametrize("n,want", [(0, 0), (100, 100), (500, 500), (600, 500)])
def test_exact_size(spark, n, want):
    assert exact_sample(spark.range(500), n, "id", chunk_rows=40).count() == want


def test_sample_is_seeded(spark):
    def ids(seed, parts, **kw):
        return sorted(r.id for r in exact_sample(spark.range(500).repartition(parts), 50, "id", seed, **kw).collect())

    assert ids(1, 3) == ids(1, 9, chunk_rows=10)
    assert ids(1, 3) != ids(2, 3)
