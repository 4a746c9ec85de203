import random

import numpy as np
import pytest
import xxhash

from dishlens.llm import simhash as op
from dishlens.llm import xxh

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text):
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return 0
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def least_linked(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, key in enumerate(ids):
        least[root(i)] = min(least.get(root(i), float("inf")), float("inf") if key is None else key)
    return [None if least[root(i)] == float("inf") else least[root(i)] for i in range(len(fps))]


def test_equals_brute_force(both, rows):
    fps = [fingerprint(r.text) for r in rows]
    expected = zip([r.doc_id for r in rows], [f"{fp:016x}" for fp in fps], least_linked([r.doc_id for r in rows], fps), strict=True)
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in op.near_duplicates(both).collect())


def test_xxh64_of_all_lengths():
    random.seed(1)
    parts = [random.randbytes(n) for n in [*range(100), 1_000, 0, 31, 32, 33]]
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert [int(h) for h in xxh.xxh64(np.frombuffer(b"".join(parts), np.uint8), starts, ends)] == [xxhash.xxh64_intdigest(p, 42) for p in parts]
    assert not len(xxh.xxh64(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))


def crowd(seed):
    """Fingerprints around few centers, so that keys are long, with chains and pairs at distances 1 to 4."""
    random.seed(seed)
    centers = [random.getrandbits(64) for _ in range(3)]
    found = {random.choice(centers) ^ sum(1 << b for b in random.sample(range(64), random.randrange(1, 5))) for _ in range(500)}
    chain = [random.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    return sorted(found | set(chain))


@pytest.mark.parametrize(("small", "most", "sample"), [(16, 4_096, 64), (2, 4_096, 64), (2, 8, 10**9), (2, 8, 1), (16, 4_096, 1)])
def test_links_of_crowded_keys(spark, monkeypatch, small, most, sample):
    """All ways that a key may take: pairs in step, one by one, crowded by the sample, crowded as met."""
    monkeypatch.setattr(op, "SMALL", small)
    monkeypatch.setattr(op, "MOST", most)
    monkeypatch.setattr(op, "SAMPLE", sample)
    monkeypatch.setattr(op, "CROWD", 8)
    fps = crowd(small + most)
    nodes = spark.createDataFrame([(int(np.uint64(fp).view(np.int64)),) for fp in fps], "fp long")
    links = op._links(nodes).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links if r.b is not None)
    root = {int(np.uint64(fp).view(np.int64)): k for k, fp in enumerate(fps)}
    groups = {k: [x] for x, k in root.items()}
    for r in links:
        if r.b is not None and root[r.a] != root[r.b]:
            a, b = root[r.a], root[r.b]
            for x in groups[b]:
                root[x] = a
            groups[a] += groups.pop(b)
    expected = least_linked(list(range(len(fps))), fps)
    mine = {}
    for k, fp in enumerate(fps):
        mine.setdefault(root[int(np.uint64(fp).view(np.int64))], k)
    assert [mine[root[int(np.uint64(fp).view(np.int64))]] for fp in fps] == expected


def test_pairs_share_a_key_if_they_are_close():
    random.seed(5)
    a = np.array([random.getrandbits(64) for _ in range(400)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in random.sample(range(64), random.randrange(3))) for x in a], np.uint64)
    keys_a, keys_b = op.segment_keys(a), op.segment_keys(b)
    first = op.first_key(a, b)
    assert (first < 64).all()
    assert all(keys_a[i, first[i]] == keys_b[i, first[i]] and not (keys_a[i, : first[i]] == keys_b[i, : first[i]]).any() for i in range(400))


def test_hot_fingerprints_and_components(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_SHARE", 4)
    texts = [(i, "one two three four five six seven") for i in range(50)] + [(100 + i, f"w{i} x{i} y{i} z{i}") for i in range(20)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op.near_duplicates(docs).collect()}
    fps = [fingerprint(t) for _, t in texts]
    assert got == dict(zip([i for i, _ in texts], least_linked([i for i, _ in texts], fps), strict=True))


def test_empty_table(odd):
    assert op.near_duplicates(odd.limit(0)).count() == 0
