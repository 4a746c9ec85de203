import collections

import pytest
from pyspark.sql import functions as F

from dishlens.llm import mixing as op


def wanted(sizes):
    """Targets by filling: share by weight, cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(order)}
    rest, left, out = sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * rest / total > 3 * sizes[s]]
        if not over:
            return out | {s: weight[s] * rest / total for s in left}
        for s in over:
            out[s] = 3 * sizes[s]
            left.remove(s)
        rest = sum(sizes.values()) - sum(out[s] for s in out)


@pytest.mark.parametrize("per_range", [op.ROWS_PER_RANGE, 3])
def test_targets_are_met_as_near_as_documents_allow(both, rows, monkeypatch, per_range):
    monkeypatch.setattr(op, "ROWS_PER_RANGE", per_range)
    rows = [r for r in rows]
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    got = op.mix(both.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))).collect()
    assert len(got) == len(rows)
    source = {r.doc_id if r.doc_id is not None else -1: r.source for r in rows}
    target, taken, longest = wanted(sizes), collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sizes)


def test_ranges_change_nothing(both, monkeypatch):
    whole = {(r.doc_id, r.copies) for r in op.mix(both).collect() if r.doc_id is not None}
    monkeypatch.setattr(op, "ROWS_PER_RANGE", 2)
    assert {(r.doc_id, r.copies) for r in op.mix(both).collect() if r.doc_id is not None} == whole


def test_capped_sources_share_again(spark):
    rows = [(i, "w " * 10, "abc"[i % 3] if i < 90 else "d") for i in range(1_000)]
    got = op.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = {r.source_size: r.target for r in got.select("source_size", "target").distinct().collect()}
    assert by[300] == 900 and by[9_100] == pytest.approx(10_000 - 3 * 900)


def test_higher_priority_is_taken_more_often(spark):
    rows = [(i, "w " * (2_000 if i % 2 else 50), "ab"[i // 2 % 2]) for i in range(2_000)]
    got = op.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("size").agg(F.avg("copies").alias("copies"))
    mean = {r["size"]: r["copies"] for r in got.collect()}
    assert mean[2_000] > mean[50]


def repeated_rows():
    """30 sources, each with long documents and equal short rows, some of them without an id."""
    rows = []
    for s in range(30):
        rows += [(1_000 * s + i, "w " * (30 + i), f"s{s:02}") for i in range(20)]
        rows += [(1_000 * s + 500, "a b c d", f"s{s:02}")] * 50 + [(None, "e f g", f"s{s:02}")] * 7
    return rows


@pytest.mark.parametrize("per_range", [op.ROWS_PER_RANGE, 8])
def test_rows_that_repeat(spark, monkeypatch, per_range):
    """The draw and the mend change one row of a group, not all: sources miss their target by half a document at most."""
    monkeypatch.setattr(op, "ROWS_PER_RANGE", per_range)
    rows = repeated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = op.mix(docs)
    assert got.count() == len(rows)
    sums = op.decided(docs).groupBy("source").agg(F.sum((F.col("whole") * F.col("n") + F.col("more")) * F.col("size")).alias("taken"), F.max("target").alias("target"))
    taken = {r.source: (r.taken, r.target) for r in sums.collect()}
    assert all(abs(a - b) <= 25 for a, b in taken.values())
    whole = collections.Counter()
    for r in op.mixed(docs).collect():
        whole[r.source] += len(r.text.split())
    assert whole == {s: a for s, (a, _) in taken.items()}
    assert got.agg(F.sum("taken")).first()[0] == sum(a for a, _ in taken.values())


def test_rows_that_repeat_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from dishlens.llm.oracle import SQL

    docs = spark.createDataFrame(repeated_rows(), "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken, copies FROM ({SQL['op5_mixing']})").fetchall()
    got = op.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6), "taken", "copies").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_a_source_of_equal_rows(spark):
    """``mixed`` takes as many as ``mix`` says, not the same number of each row."""
    rows = [(1, "a b c d e f g", "a")] * 100 + [(i, "w " * 20, "b") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = {r.doc_id: r.taken for r in op.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    done = collections.Counter()
    for r in op.mixed(docs).collect():
        done[r.doc_id] += len(r.text.split())
    assert done == {k: v for k, v in said.items() if v}


def test_mixed_rows(odd):
    got = op.mixed(odd)
    assert got.columns == odd.columns
    copies = {r.doc_id: r.copies for r in op.mix(odd).collect() if r.doc_id is not None and r["size"]}
    count = collections.Counter(r.doc_id for r in got.collect())
    assert all(count[i] == n * (2 if i == 1 else 1) for i, n in copies.items())


def test_no_python_in_the_plan(both):
    plan = op.mix(both)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_table(odd):
    assert op.mix(odd.limit(0)).count() == 0
