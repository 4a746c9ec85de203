import hashlib

import numpy as np
import pytest

from dishlens.llm import sketch
from dishlens.llm import substring_dedup as op


def expected(rows):
    docs = sorted(((float("inf") if r.doc_id is None else r.doc_id, (r.text or "").encode().split(), r.doc_id) for r in rows), key=lambda d: d[0])
    seen, out = {}, []
    for key, words, _ in docs:
        for k in range(len(words) - 12):
            seen.setdefault(tuple(words[k : k + 13]), key)
    for key, words, doc_id in docs:
        drop = set()
        for k in range(len(words) - 12):
            if seen[tuple(words[k : k + 13])] < key:
                drop.update(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        out.append((doc_id, len(words), len(drop), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("per_key", [op.RUNS_PER_KEY, 2])
def test_equals_brute_force(both, rows, monkeypatch, per_key):
    monkeypatch.setattr(op, "RUNS_PER_KEY", per_key)
    got = [tuple(r) for r in op.digest(op.dedupe_passages(both)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


def test_small_batches_of_a_task_change_nothing(both, rows, monkeypatch):
    monkeypatch.setattr(op, "WINDOWS_PER_TASK", 100)
    got = [tuple(r) for r in op.digest(op.dedupe_passages(both)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


def test_kept_words(spark):
    line = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"a {line}"), (2, f"b  {line}\nc"), (3, line[:-4])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in op.dedupe_passages(docs).collect()}
    assert got == {1: (0, f"a {line}"), 2: (13, "b c"), 3: (0, line[:-4])}


def test_empty_table(odd):
    assert op.dedupe_passages(odd.limit(0)).count() == 0


def test_sketch_never_misses_a_repeated_key(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5_000).astype(np.uint64)
    both = np.concatenate([keys, keys[:500]])

    def found(batch):
        yield batch.column(0).to_numpy().view(np.uint64)

    rows = spark.createDataFrame([(int(k),) for k in both], "key long").repartition(7)
    for bits in (16, 22):
        table = sketch.repeated_keys(rows, found, bits)
        hits = sketch.may_repeat(table.value, keys, bits)
        assert hits[:500].all()
        assert hits[500:].mean() < (0.2 if bits == 16 else 0.001)


def test_sketch_grows_with_the_keys(spark, monkeypatch):
    """Many more keys than the bitmap has room for: what passes follows the keys that repeat, in parts of any size."""
    rng = np.random.default_rng(2)
    n = 120_000
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    monkeypatch.setattr(sketch, "MIN_BITS", 6)
    monkeypatch.setattr(sketch, "MAX_BITS", 12)  # 4,096 places for 30 times the keys
    rows = spark.createDataFrame([(int(k),) for k in np.concatenate([keys, keys[:50]])], "key long").repartition(9)

    def found(batch):
        yield batch.column(0).to_numpy().view(np.uint64)

    for part_keys in (1 << 20, 1 << 12):
        monkeypatch.setattr(sketch, "PART_KEYS", part_keys)
        bits = sketch.bits_for(n)
        table = sketch.repeated_keys(rows, found, bits).value
        assert len(table) * 8 <= 1 << max(12, sketch.part_bits(bits) + 3)
        hits = sketch.may_repeat(table, keys, bits)
        assert hits[:50].all() and hits[50:].mean() < 0.05


def test_parts_do_not_grow_with_the_keys():
    for keys in (10, 10**6, 10**9, 10**12):
        bits = sketch.bits_for(keys)
        assert keys / 2 ** sketch.part_bits(bits) <= 2 * sketch.MOST_KEYS


def test_bitmap_names_all_values(spark):
    bits, table = sketch.bitmap(spark.range(1_000), "id")
    assert sketch.in_bitmap(table.value, np.arange(1_000), bits).all()
    assert sketch.in_bitmap(table.value, np.arange(10_000, 20_000), bits).mean() < 0.2
