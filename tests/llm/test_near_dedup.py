import random

import numpy as np
import pytest

from dishlens.llm import near_dedup as op
from dishlens.llm.components import components

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, width):
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def expected(rows, width):
    """doc_id, set size and least linked id, by comparing all pairs that share anything."""
    sets = [(float("inf") if r.doc_id is None else r.doc_id, shingles(r.text, width), r.doc_id) for r in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a, _) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 80 * (len(a) + len(b) - shared):
                    parent[root(i)] = root(j)
    least = {}
    for i, (key, a, doc_id) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), (float("inf"), None)), (key, doc_id), key=lambda x: x[0])
    return [(doc_id, len(a), (least[root(i)][1] if a else doc_id)) for i, (_, a, doc_id) in enumerate(sets)]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(both, rows, width):
    got = op.near_duplicates(both, width=width).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, expected(rows, width)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Chains, members linked with few others, and blocks smaller than the group."""
    monkeypatch.setattr(op, "BLOCK", 16)
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for k in random.sample(range(120), random.choice([1, 3, 6, 9, 13])):
            words[k] = f"x{i}_{k}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = op.near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(expected(docs.collect(), 2))


def test_linked_only_to_an_inner_member_of_a_component(spark):
    """R-M, M-H and M-B are linked, R-B and H-B are not; B is proposed the ends of its buckets only, often R and H."""
    texts = []
    for g in range(40):
        m = [f"g{g}m{i}" for i in range(100)]
        r, h = [f"g{g}r{i}" for i in range(2)] + m[2:], m[:-2] + [f"g{g}h{i}" for i in range(2)]
        b = m[:40] + [f"g{g}b{i}" for i in range(10)] + m[50:]
        texts += [(4 * g + i, " ".join(words)) for i, words in enumerate((r, m, h, b))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = op.near_duplicates(docs, width=1).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, i // 4 * 4) for i in range(160)]


def test_representatives(spark, odd):
    kept = op.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert op.keep_representatives(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(5, "a b c d e f g"), (2, "A b c  d e f g"), (9, "q")], "doc_id long, text string")
    assert sorted(r.doc_id for r in op.keep_representatives(docs).collect()) == [2, 9]


def test_every_place_of_a_sketch_fills():
    element = np.arange(1, 40, dtype=np.uint64)
    offsets = np.array([0, 1, 1, 4, 39])
    values = op.sketches(offsets, element)
    empty = values == np.iinfo(np.uint64).max
    assert empty[1].all() and not empty[[0, 2, 3]].any()


def test_agreement_is_the_similarity():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        part = np.sort(rng.integers(1, 2**63, 450).astype(np.uint64))
        other = np.sort(np.concatenate([part[50:], rng.integers(1, 2**63, 50).astype(np.uint64)]))
        values = op.sketches(np.array([0, 450, 900]), np.concatenate([part, other]))
        agree.append((values[0] == values[1]).mean())
    assert abs(np.mean(agree) - 400 / 500) < 0.02


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1_000, 1_100)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
