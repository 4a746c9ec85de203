import os
import random

import numpy as np
import pyarrow as pa
import pytest

from dishlens.llm import arrays
from dishlens.llm import pieces as op

pytestmark = pytest.mark.skipif(not os.path.exists(op.MODEL), reason="no vocabulary here")


@pytest.fixture(scope="module")
def vocabulary():
    return op.read_vocabulary()


@pytest.fixture(scope="module")
def trie(vocabulary):
    return op.build_trie(vocabulary)


def brute(vocabulary, text):
    """Viterbi over every pair of positions."""
    if not text:
        return []
    known = {vocabulary.pieces[i]: i for i in np.flatnonzero(vocabulary.usable).tolist()}
    unknown = float(vocabulary.scores[vocabulary.usable].min()) - op.UNKNOWN_PENALTY
    body = b" " + text.encode()
    size = op.character_sizes(np.frombuffer(body, np.uint8)).tolist()
    best, back = [0.0] + [None] * len(body), [None] * (len(body) + 1)
    for e in range(1, len(body) + 1):
        for s in range(max(0, e - 64), e):
            if best[s] is None or not size[s]:
                continue
            part = body[s:e]
            if part in known:
                step = (best[s] + vocabulary.scores[known[part]], [known[part]])
            elif e - s == size[s]:
                step = (best[s] + unknown, [int(vocabulary.byte_ids[x]) for x in part])
            else:
                continue
            if best[e] is None or step[0] > best[e]:
                best[e], back[e] = step[0], (s, step[1])
    ids, e = [], len(body)
    while e:
        ids[:0] = back[e][1]
        e = back[e][0]
    return ids


def test_ranks_become_log_scores(vocabulary, trie):
    """Scores fall with the rank as logarithms do, and common words stay whole."""
    assert op.are_ranks(np.array([0.0, -1.0, -1e9])) and not op.are_ranks(np.array([-1.5, -2.0])) and not op.are_ranks(np.zeros(0))
    scores = op.log_scores(np.array([0.0, -1.0, -2.0, -9.0]), np.array([True, True, True, False]))
    assert np.allclose(np.exp(scores), np.array([1, 1 / 2, 1 / 3, 1 / 10]) / (1 + 1 / 2 + 1 / 3), atol=1e-5)
    assert np.exp(vocabulary.scores[vocabulary.usable]).sum() == pytest.approx(1, abs=1e-3)
    for word in ("international", "government", "different", "information"):
        assert len(encoded(trie, [word])[0]) == 1


def test_about_as_many_pieces_as_by_merging(trie):
    import pyarrow.parquet as pq
    import sentencepiece

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:60]
    words = sorted({w for t in texts if t for w in t.split()})
    library = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
    assert sum(map(len, encoded(trie, words))) <= 1.02 * sum(map(len, library.encode(words)))


TEXTS = ["", "Hello world", "  two  spaces ", "tab\there\nnew", "naïve ▁ marker 日本語 😀x", "a" * 50, "éreauxç çé. $$$ %%%", " ", "x" * 300]


def encoded(trie, texts):
    data, offsets = arrays.flat(pa.array(texts))
    ids, at = op.encode_batch(trie, data, offsets)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("in_step", [op.IN_STEP, 4])
def test_equals_brute_force(vocabulary, trie, documents, monkeypatch, in_step):
    monkeypatch.setattr(op, "IN_STEP", in_step)
    texts = TEXTS + [r.text[:200] for r in documents.limit(25).collect()]
    assert encoded(trie, texts) == [brute(vocabulary, t) for t in texts]


def test_scores_decide_and_ties_go_to_the_longer_last_piece():
    pieces = [b"a", b"b", b"ab", b"abc", b"c", b"bc", b" ", *[bytes([i]) for i in range(256)]]
    scores = np.array([-1.0, -1, -1.5, -9, -1, -1.5, 0, *[-50] * 256])
    usable = np.arange(len(pieces)) < 7
    byte_ids = np.arange(7, 263).astype(np.int32)
    trie = op.build_trie(op.Vocabulary(pieces, scores, usable, byte_ids))
    assert encoded(trie, ["abc", "ab", "é"]) == [[6, 0, 5], [6, 2], [6, 7 + 0xC3, 7 + 0xA9]]


def test_pieces_with_inner_spaces_are_found():
    pieces = [b" a", b" b", b" a b", *[bytes([i]) for i in range(256)]]
    usable = np.arange(len(pieces)) < 3
    trie = op.build_trie(op.Vocabulary(pieces, np.array([-1.0, -1, -1, *[-50] * 256]), usable, np.arange(3, 259).astype(np.int32)))
    assert not trie.by_word and encoded(trie, ["a b a"]) == [[2, 0]]


def test_the_trie_has_every_piece(vocabulary, trie):
    random.seed(1)
    for i in random.sample(np.flatnonzero(vocabulary.usable).tolist(), 2_000):
        node = 0
        for byte in vocabulary.pieces[i]:
            step = int(trie.base[node]) + byte
            assert trie.check[step] == node
            node = step
        assert vocabulary.pieces[trie.piece[node]] == vocabulary.pieces[i]


def test_round_trip(both, rows, odd):
    back = op.decode(op.encode(both)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in rows)
    got = op.tokenized(odd).collect()
    assert len(got) == 13 and all(r.lossless and r.n_tokens == len(r.ids) for r in got)
    assert op.tokenized(odd.limit(0)).count() == 0
