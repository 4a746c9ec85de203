import re

import numpy as np
import pytest

from dishlens.operators import cells as op


def table(spark, vectors, name="row_id", kind="float"):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in vectors]
    return spark.createDataFrame(rows, f"{name} long, vector array<{kind}>")


def clustered(n=6_000, dim=32, clusters=60, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    # one cluster has a third of all rows
    at = np.where(rng.random(n) < 0.33, 0, rng.integers(0, clusters, n))
    x = centers[at] + 0.05 * rng.normal(size=(n, dim))
    return np.float32(x / np.linalg.norm(x, axis=1)[:, None])


def exact(x, q, k):
    scores = np.round(x.astype("float64") @ np.asarray(q, "float64"), 9)
    order = np.lexsort((np.arange(len(x)), -scores))[:k]
    return [(int(i), float(scores[i])) for i in order]


def found(best):
    out = {}
    for r in sorted(best.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.row_id, round(r.score, 9)))
    return out


@pytest.mark.parametrize(("rows", "queries"), [(op.BLOCK_ROWS, op.BLOCK_QUERIES), (200, 16)])
def test_finds_what_a_search_over_all_rows_finds(spark, tmp_path, monkeypatch, rows, queries):
    monkeypatch.setattr(op, "BLOCK_ROWS", rows)
    monkeypatch.setattr(op, "BLOCK_QUERIES", queries)
    x = clustered()
    index = op.build_cells(table(spark, enumerate(x)), str(tmp_path / "cells"))
    assert index.rows.count() == len(x) and index.cells.rows.sum() == len(x)
    every = list(range(0, len(x), 20))
    best, effort = op.search_cells(index, table(spark, [(i, x[i]) for i in every], "query_id"), 5)
    got = found(best)
    assert {i: [r for r, _ in got[i]] for i in every} == {i: [r for r, _ in exact(x, x[i], 5)] for i in every}
    looked = {r.query_id: r.n_scored for r in effort.collect()}
    small = [looked[i] for i in every if exact(x, x[i], 40)[39][1] < 0.9]
    assert len(looked) == len(every) and np.mean(list(looked.values())) < 0.2 * len(x)
    assert not small or np.mean(small) < 0.1 * len(x)


def test_reads_only_cells_that_are_visited(spark, tmp_path):
    x = clustered()
    index = op.build_cells(table(spark, enumerate(x)), str(tmp_path / "cells"))
    cell = index.rows.where("row_id = 7").first().cell
    plan = index.rows.where(op.F.col("cell").isin([cell]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(cell#\d+ = ", plan)
    assert len(index.rows.inputFiles()) >= len(np.flatnonzero(index.cells.rows))


def test_scattered_vectors_ties_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = [None if i % 17 == 0 else np.zeros(8) if i % 19 == 0 else rng.integers(-2, 3, 8) for i in range(400)]
    x[5] = [float("nan")] * 8
    x[6] = [float("inf")] + [0.0] * 7
    good = np.array([v if v is not None and np.isfinite(v).all() else np.full(8, -1e9) for v in x], "float64")
    able = np.array([v is not None and bool(np.isfinite(v).all()) for v in x])
    index = op.build_cells(table(spark, enumerate(x), kind="double"), str(tmp_path / "cells"), n_cells=12)
    queries = [(i, None if i == 3 else np.zeros(8) if i == 4 else rng.integers(-2, 3, 8)) for i in range(30)]
    best, effort = op.search_cells(index, table(spark, queries, "query_id", "double"), 7)
    got = found(best)
    for i, q in queries:
        if q is None:
            assert i not in got
            continue
        scores = good @ q
        order = [int(r) for r in np.lexsort((np.arange(400), -scores)) if able[r]][:7]
        assert [r for r, _ in got[i]] == order
    assert effort.count() == 29


def test_more_wanted_than_there_is(spark, tmp_path):
    x = np.eye(6)
    index = op.build_cells(table(spark, enumerate(x)), str(tmp_path / "cells"), n_cells=3)
    best, _ = op.search_cells(index, table(spark, [(1, x[1])], "query_id"), 50)
    assert [r for r, _ in found(best)[1]] == [1, 0, 2, 3, 4, 5]


def test_empty_tables(spark, tmp_path):
    none = table(spark, [])
    index = op.build_cells(none, str(tmp_path / "none"))
    assert op.search_cells(index, table(spark, [(0, [1.0])], "query_id"), 3)[0].count() == 0
    index = op.build_cells(table(spark, enumerate(np.eye(4))), str(tmp_path / "some"))
    best, effort = op.search_cells(index, table(spark, [], "query_id"), 3)
    assert best.count() == 0 and effort.count() == 0


def test_written_and_read_again(spark, tmp_path):
    x = clustered(600, 8, 12)
    op.build_cells(table(spark, enumerate(x)), str(tmp_path / "cells"))
    index = op.read_cells(spark, str(tmp_path / "cells"))
    best, _ = op.search_cells(index, table(spark, [(0, x[0])], "query_id"), 4)
    assert [r for r, _ in found(best)[0]] == [r for r, _ in exact(x, x[0], 4)]


def test_vectors_of_another_length(spark, tmp_path):
    index = op.build_cells(table(spark, enumerate(np.eye(4))), str(tmp_path / "cells"))
    with pytest.raises(Exception, match="other lengths"):
        op.search_cells(index, table(spark, [(0, [1.0, 2.0])], "query_id"), 3)[0].count()


def test_only_hits_that_reach_the_floor_leave_a_block():
    """Ties with the k-th score stay, as a lower id goes first; every row is still counted as scored."""
    import pyarrow as pa

    from dishlens.operators.cells import _scoring

    left = pa.table({"row_id": [1, 2, 3, 4], "vector": pa.array([[1.0], [0.5], [0.25], [0.5]], pa.list_(pa.float64())), "reach": [0.0] * 4})
    right = pa.table({"query_id": [7, 8], "vector": pa.array([[1.0], [1.0]], pa.list_(pa.float64())), "need": [-np.inf] * 2, "floor": [0.5, -np.inf]})
    got = _scoring(3, 1)(left, right).to_pylist()
    assert [r["row_id"] for r in got if r["query_id"] == 7 and r["row_id"]] == [1, 2, 4]
    right = right.set_column(3, "floor", pa.array([0.75, -np.inf]))
    got = _scoring(3, 1)(left, right).to_pylist()
    assert [r["row_id"] for r in got if r["query_id"] == 7 and r["row_id"]] == [1]
    assert [r["n_scored"] for r in got if r["n_scored"]] == [4, 4]
