import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from dishlens.llm import collocations as op

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (r.text or "").translate(FOLD)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def expected(rows, least, top):
    f, n = counts(rows)
    out = []
    for lang, mine in f.items():
        candidates = {p: a for p, a in mine.items() if a >= least and " " in p}
        longer = Counter()
        for p, a in candidates.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    part = " ".join(w[i : i + size])
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] >= 80 * a:
                continue
            w = p.split(" ")
            cuts = [(2_000_000 * a // (mine[" ".join(w[:k])] + mine[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), mine[" ".join(w[:k])], mine[" ".join(w[k:])]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "shards"), [(30, 2_000, 4), (4, 50, 4), (3, 2_000, 3), (30, 2_000, 1)])
def test_equals_brute_force(both, rows, monkeypatch, least, top, shards):
    monkeypatch.setattr(op, "MIN_COUNT", least)
    monkeypatch.setattr(op, "SHARDS", shards)
    monkeypatch.setattr(op, "RANGE_BYTES", 1 << 15)
    got = sorted(tuple(r) for r in op.collocations(both, top=top).collect())
    assert got and got == expected(rows, least, top)


def test_false_hits_and_small_lists_change_nothing(both, rows, monkeypatch):
    monkeypatch.setattr(op, "MAX_BITS", 8)
    monkeypatch.setattr(op, "HELD", 500)
    monkeypatch.setattr(op, "MIN_COUNT", 5)
    assert sorted(tuple(r) for r in op.collocations(both).collect()) == expected(rows, 5, 2_000)


def test_phrases_that_reach_the_count_late(spark, monkeypatch):
    """Words, pairs and longer phrases that become frequent in the last shard only, so that all four cycles are needed."""
    monkeypatch.setattr(op, "MIN_COUNT", 6)
    random.seed(2)
    texts = []
    for i in range(120):
        texts.append((i, f"Left{i // 20}\tright  up down{i // 20}. " * (i % 3) + " ".join(random.choice("abcde") for _ in range(30)), ["en", "de", None, "und"][i % 4]))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(1)
    assert sorted(tuple(r) for r in op.collocations(docs).collect()) == expected(docs.collect(), 6, 2_000)


def test_a_phrase_counts_each_shard_once(spark, monkeypatch):
    monkeypatch.setattr(op, "MIN_COUNT", 8)
    docs = spark.createDataFrame([(i, "x y z w", "en") for i in range(40)], "doc_id long, text string, lang string")
    got = op.frequent_phrases(docs).collect()
    assert {(r.phrase, r.f) for r in got} == {(p, 40) for p in ("x", "y", "z", "w", "x y", "y z", "z w", "x y z", "y z w", "x y z w")} | {("", 160)}


def test_score_of_counts_beyond_64_bits(spark):
    big = 4 * 10**18
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1), ("en", "", 0, big)]
    got = op.best_phrases(spark.createDataFrame(rows, op.FOUND)).first()
    assert got.score == 2_000_000 * (big - 1) // (2 * big + 1)


def test_odd_rows_and_empty_table(odd, monkeypatch):
    monkeypatch.setattr(op, "MIN_COUNT", 3)
    assert sorted(tuple(r) for r in op.collocations(odd).collect()) == expected(odd.collect(), 3, 2_000)
    assert op.collocations(odd.limit(0)).count() == 0


def test_packed_numbers():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1_000).astype(np.uint64))

    class Value:
        def __init__(self, data):
            self.data = data

        def as_buffer(self):
            return self.data

    assert (op.unpack_keys(Value(op.pack_keys(keys))) == keys).all()
    assert not len(op.unpack(Value(op.pack(keys[:0]))))


def lists_of(rows, ranges, shards=1):
    """What the last scan hands out for texts of which every phrase is known."""
    batch = pa.RecordBatch.from_pydict({"lang": [r.lang for r in rows], "text": [r.text for r in rows]})
    cut = list(op._cut(shards)([batch]))
    return list(op._texts(6, ranges, SimpleNamespace(value=np.full(1, 2**64 - 1, np.uint64)))(iter(cut)))


def test_the_last_scan_hands_out_lists_by_range_and_reads_no_texts(monkeypatch):
    """A row for each range of hashes, not one for each phrase; texts are cut into words when they are written, and only then."""
    monkeypatch.setattr(op, "MIN_COUNT", 1)
    random.seed(4)
    words = [f"W{i}é" for i in range(60)]
    texts = [". ".join("  ".join(random.choices(words, k=9)) for _ in range(40)) for _ in range(30)]
    rows = [SimpleNamespace(lang=["en", "de"][i % 2], text=t) for i, t in enumerate(texts)]
    halves = [lists_of(part, 3) for part in (rows[:11], rows[11:])]
    assert all(sum(b.num_rows for b in half) <= 8 for half in halves)
    buckets = defaultdict(list)
    for batch in halves[0] + halves[1]:
        for i in range(batch.num_rows):
            buckets[batch.column("bucket")[i].as_py()].append(batch.slice(i, 1))
    got = Counter()
    for group in buckets.values():
        for r in op._sums()(pa.Table.from_batches(group)).to_pylist():
            assert r["n_words"] == len(r["phrase"].split(" "))
            got[r["lang"], r["phrase"]] += r["f"]
    f, _ = counts(rows)
    assert len(got) > 10_000 and got == {(lang, p): a for lang in f for p, a in f[lang].items()}


def test_texts_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op, "MIN_COUNT", 2)
    monkeypatch.setattr(op, "key_of", lambda sums, n: np.full(len(sums), 4 * n + n - 1, np.uint64))
    parts = [lists_of([SimpleNamespace(lang=lang, text=t)], 0) for lang, t in (("en", "a a"), ("en", "b b b"), ("de", "a a"), ("en", "a"))]
    got = op._sums()(pa.Table.from_batches([b for part in parts for b in part])).to_pylist()
    assert {(r["lang"], r["phrase"], r["f"]) for r in got} == {("en", "a", 3), ("en", "b", 3), ("en", "b b", 2), ("de", "a", 2)}


@pytest.mark.parametrize("met", [(5, 7, 8, 9, 10), (3, 4, 5, 7, 8, 9, 10), (2, 4, 5, 7, 8, 9, 10), (1, 2, 7, 8, 9, 10)])
def test_a_phrase_begun_by_a_false_hit_keeps_the_shards_it_has_seen(met):
    """Its own steps are 7 to 10; what was met before, in some of the shards, neither counts twice nor makes it forgotten meanwhile."""
    names, state = ["bucket", "keys", "counts", "seen", "last", "reached"], []
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names[1:])])
    for step in range(1, 11):
        found = [dict(zip(names, (0, op.pack_keys(np.array([8], np.uint64)), op.pack(np.array([9])), None, None, None), strict=True))] if step in met else []
        if state or found:
            state = op._merge(step, 6)(pa.Table.from_pylist(state + found, schema)).select(names).to_pylist()
    total, reached = (op.unpack(pa.scalar(state[0][c], pa.binary())).tolist() for c in ("counts", "reached"))
    assert total == [36] and reached[0] in range(7, 11)
