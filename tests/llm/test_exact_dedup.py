import hashlib
import re

import numpy as np

from dishlens.llm import exact_dedup as op


def expected(rows):
    groups = {}
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        groups.setdefault(body, []).append((-len(r.text or ""), float("inf") if r.doc_id is None else r.doc_id, r.doc_id))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: m[:2])
        sha = hashlib.sha256(body.encode()).hexdigest()
        for i, m in enumerate(sorted(members, key=lambda m: m[:2])):
            out.append((m[2], keep[2], len(members), i == 0, sha))
    return out


def test_equals_brute_force(both, rows):
    got = [tuple(r) for r in op.decisions(both).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


def test_kept_rows_have_all_columns(odd):
    kept = op.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, None, 6, 5, 7, 8, 9, 10]))


def test_empty_table(odd):
    assert op.decisions(odd.limit(0)).count() == 0
    assert op.keep_first(odd.limit(0)).count() == 0


def test_blocks_come_back_as_they_were():
    quotient, remainder = np.array([0, 5, 5, 5, 200_000]), np.array([7, 1, 2, 9, 0], np.uint32)
    count = np.array([1, 2, 3, 2**40, 1], np.uint64)
    back = op.decode_block(*op.encode_block(quotient, remainder, count))
    for a, b in zip(back, (quotient, remainder, count), strict=True):
        assert a.tolist() == b.tolist()


def test_bytes_follow_the_entries_not_the_blocks():
    """As many fingerprints take about as many bytes in 8 blocks as in 2 ** 20."""
    marks = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2)
    size = []
    for bits in (3, 8, 11, 14, 20):
        batch = op._filter(marks, bits)
        size.append(sum(len(v.as_buffer()) for name in ("occupied", "run_ends", "remainders", "counts") for v in batch.column(name)) / len(marks))
        parts = [op.decode_block(*(batch.column(c)[i].as_buffer().to_pybytes() for c in ("occupied", "run_ends", "remainders", "counts"))) for i in range(min(20, batch.num_rows))]
        assert all((np.diff(q) >= 0).all() for q, _, _ in parts)
    assert max(size) < 18 and max(size) < 1.3 * min(size)


def test_many_blocks_give_the_same_groups(both, rows, monkeypatch):
    """Blocks of a few fingerprints, so that a block's bits eat into the remainder's, and hot groups of any size."""
    monkeypatch.setattr(op, "PER_BLOCK", 1 / 2**11)
    monkeypatch.setattr(op, "HOT_SHARE", 20)
    got = [tuple(r) for r in op.decisions(both).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


def test_merging_filters_adds_counts():
    a = (np.array([1, 1, 3]), np.array([5, 6, 1], np.uint32), np.array([1, 1, 2], np.uint64))
    b = (np.array([1, 2]), np.array([6, 6], np.uint32), np.array([4, 1], np.uint64))
    merged = op.merge_blocks([a, b])
    assert list(zip(*(x.tolist() for x in merged), strict=True)) == [(1, 5, 1), (1, 6, 5), (2, 6, 1), (3, 1, 2)]


def test_fingerprints_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(op.xxhash, "xxh3_64_intdigest", lambda body: 42)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", " a", "c", "b"])], "doc_id long, text string")
    groups = op.decisions(docs).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(tuple, groups)) == [(0, 2, 2), (1, 1, 2), (2, 2, 2), (3, 3, 1), (4, 1, 2)]


def test_copies_are_counted_within_tasks_first(spark, documents, monkeypatch):
    """Whole texts are not dealt before they are grouped, also where no table is small enough to be broadcast."""
    plans, kept = {}, op.materialize

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return kept(df, name)

    monkeypatch.setattr(op, "materialize", written)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        op.decisions(documents)
        plan = plans["groups"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    made = next(i for i, line in enumerate(plan) if "MapInArrow" in line and "body" in line)
    above = [line for line in reversed(plan[:made]) if "Exchange" in line or "partial_count" in line]
    assert "partial_count" in above[0]
