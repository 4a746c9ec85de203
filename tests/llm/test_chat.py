import collections
import hashlib
import time

from pyspark.sql import functions as F

from dishlens.llm import chat as op

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_come_back(spark):
    odd = ["", None, "\\", "\\\\h", "### x", "a</turn>\nb", "\\t:", "####", "< /turn></turn", "日本 😀", "x" * 5_000]
    turns = [(i, t, "user" if t % 2 == 0 else "assistant", odd[(i + t) % len(odd)]) for i in range(22) for t in range(1 + i)]
    turns += [(100, 0, None, "a: b"), (100, 1, "we:ird\\ ###", "c"), (None, 0, "assistant", "d"), (5, 2, "user", "same turn")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {r.conv_id: r for r in op.digest(op.formatted(op.branches(op.replies(op.probe(spark, table))))).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in [*turns, *op.PROBE]:
        by[c].append((t, r is not None, r or "", x is not None, x or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        learned = "".join(x for _, _, r, _, x in rows if r == "assistant")
        want = (len(rows), sha("".join(f"{r}\n{x}\n" for _, _, r, _, x in rows)), len(learned), sha(learned))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want


def test_best_branches_of_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a1", 1.0), (1, 3, 1, "assistant", "a2", 3.0), (1, 4, 2, "user", "x", 9.0),
        (1, 5, 99, "user", "orphan", None), (None, 1, None, None, None, None), (2, 1, 2, "user", "c", 0.0), (2, 2, 1, "user", "c", 0.0),
    ]
    tree = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.tree), r.branch, r.position, r.text) for r in op.branches(tree, 2).collect())
    assert got == [("1", 1, 1, "q"), ("1", 1, 2, "a1"), ("1", 1, 3, "x"), ("1", 2, 1, "q"), ("1", 2, 2, "a2"), ("None", 1, 1, "")]
    assert op.branches(tree.limit(0)).count() == 0


def test_deep_paths(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), float(i)) for i in range(150)]
    got = op.branches(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.position, r.text) for r in got) == [(i + 1, str(i)) for i in range(150)]


def test_very_long_conversations(spark):
    """60,000 turns of one conversation; the ranges are those of the texts, in order."""
    n = 60_000
    paths = spark.range(n).select(
        F.lit("t").alias("tree_key"), F.lit(1).alias("branch"), F.lit(1).alias("tree"), (F.col("id") + 1).alias("position"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
    )
    begin = time.perf_counter()
    row = op.formatted(paths).first()
    assert time.perf_counter() - begin < 20
    assert len(row.learned) == n // 2
    assert [row.formatted[s.start : s.end] for s in row.learned] == [f"text {i}" for i in range(1, n, 2)]


def test_mask_covers_the_answers_alone(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "a\\b", 0.0)]
    row = op.formatted(op.branches(spark.createDataFrame(rows, SCHEMA))).first()
    assert row.formatted == "### user: q</turn>\n### assistant: a\\\\b</turn>\n"
    assert [row.formatted[s.start : s.end] for s in row.learned] == ["a\\\\b"]
