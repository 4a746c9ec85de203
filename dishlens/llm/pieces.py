"""SentencePiece encoding and decoding: the best segmentation of a text into scored pieces.

The pieces of a vocabulary, with their log scores, stand in a double-array trie over bytes, in which a space stands for the
whitespace marker. Of a model that has ranks of merges instead of log scores, a piece of rank r gets the log of its share by
Zipf's law, -log(r + 1) less the log of the sum of 1 / (r + 1) over all pieces; nothing is trained. Scores are multiples of GRID, so
that sums are exact and ties are ties in any order. A text gets one space in front. All pieces that begin at any byte of a batch are found at once, one byte
of length a step, and the Viterbi recurrence runs over all words of the batch in step. Of segmentations with equal scores the
one whose last piece is longest wins, and so on from the end. A character that no single-character piece covers may be written as its UTF-8
bytes, at the least score of all pieces less UNKNOWN_PENALTY. If no piece holds a space after another character, as in the
vocabularies that mark word beginnings, words are segmented apart and equal words of a batch once; else whole texts are.

A marker character that stands in a text itself is written as bytes, so decoding gives back every text exactly.

Results: null or empty text has no pieces; everything else decodes to itself. Rows are independent, repeated ones too. Very long
texts are cut into words, or segmented one by one where the vocabulary has no word beginnings. An empty table gives no rows. Other
columns are not read. The vocabulary's file is read by the driver, and what is broadcast is the trie, whose size is the vocabulary's.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm import arrays

#: The model's file, unless the environment names another one.
MODEL = os.environ.get("DISHLENS_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARKER, SPACE = "▁", 0x20
UNKNOWN_PENALTY, GRID = 10.0, 2.0**-20
#: Words up to this many bytes are segmented in step with all others of the batch, longer ones one by one.
IN_STEP = 2_000
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with their scores; ids of the 256 byte pieces; pieces of other kinds are never used to encode."""

    pieces: list[bytes]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray


@dataclass(frozen=True)
class Trie:
    """Node s goes to base[s] + byte if check of that is s; piece[s] is the id of the piece that ends in s, or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    by_word: bool
    #: All pieces' bytes, one after another, and where each begins, for decoding.
    flat: np.ndarray
    begins: np.ndarray
    lists: dict = field(default_factory=dict)


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The pieces of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = np.full(256, -1, np.int32)
    pieces, usable = [], np.ones(n, bool)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces.append(bytes([int(piece[3:5], 16)]))
            usable[i] = False
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
            usable[i] = False
        else:
            pieces.append(piece.replace(MARKER, " ").encode())
    scores = np.array([model.get_score(i) for i in range(n)], np.float64)
    return Vocabulary(pieces, log_scores(scores, usable) if are_ranks(scores[usable]) else scores, usable, byte_ids)


def are_ranks(scores: np.ndarray) -> bool:
    """Whether scores are ranks of merges, counted down from zero, rather than logarithms."""
    return len(scores) > 1 and bool((scores == np.round(scores)).all()) and bool((scores <= 0).all())


def log_scores(ranks: np.ndarray, usable: np.ndarray) -> np.ndarray:
    rank = np.maximum(-ranks, 0.0) + 1
    return np.round((-np.log(rank) - np.log((1 / rank[usable]).sum())) / GRID) * GRID


def place_nodes(children: list[dict[int, int]], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and piece of a trie: nodes with many children take the first place that fits, single ones fill the gaps."""
    size = 4 * len(children) + 4096
    used, owner = np.zeros(size, bool), np.full(size, -1, np.int64)
    at_of, base_of = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
    # places below 256 stay empty, so that every free place can be any byte's child
    used[:256], low, free, span = True, 256, 256, np.arange(1024)
    for node in sorted((n for n, c in enumerate(children) if c), key=lambda n: -len(children[n])):
        keys = np.array(sorted(children[node]), np.int64)
        if len(keys) > 1:
            at = low
            while True:
                fits = ~used[(at + span)[:, None] + keys].any(axis=1)
                if fits.any():
                    at += int(np.argmax(fits))
                    break
                at += len(span)
                low = at - len(span) // 2
        else:
            while used[free]:
                free += 1
            at = free - int(keys[0])
        used[at + keys], owner[at + keys], base_of[node] = True, node, at
        for k, child in children[node].items():
            at_of[child] = at + k
    check = np.where(owner >= 0, at_of[owner], -1).astype(np.int32)
    base, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    base[at_of], piece[at_of] = base_of, ends
    return base, check, piece


def build_trie(vocabulary: Vocabulary) -> Trie:
    if (vocabulary.byte_ids < 0).any():
        raise ValueError("the vocabulary has to have a piece for each byte")
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for i in np.flatnonzero(vocabulary.usable).tolist():
        node = 0
        for byte in vocabulary.pieces[i]:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        if node:
            ends[node] = i
    base, check, piece = place_nodes(children, ends)
    scores = vocabulary.scores
    least = float(scores[vocabulary.usable].min()) if vocabulary.usable.any() else 0.0
    spaced = [p for p, u in zip(vocabulary.pieces, vocabulary.usable, strict=True) if u and b" " in p.lstrip(b" ")]
    sizes = np.array([len(p) for p in vocabulary.pieces], np.int64)
    return Trie(
        base, check, piece, scores, vocabulary.byte_ids, least - UNKNOWN_PENALTY, not spaced,
        np.frombuffer(b"".join(vocabulary.pieces), np.uint8), np.concatenate([[0], np.cumsum(sizes)]),
    )


def character_sizes(data: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins at each byte, 0 where none does."""
    return np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)


def _edges(trie: Trie, data: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every piece that fits anywhere, and bytes where no single-character piece does: start, end, id (-1), score."""
    sizes = character_sizes(data)
    start = np.flatnonzero(sizes)
    single = np.zeros(len(data), bool)
    at, node = start, np.zeros(len(start), np.int64)
    found, k = [], 0
    while len(at):
        step = trie.base[node] + data[at + k].astype(np.int64)
        ok = (trie.check[step] == node) & (trie.base[node] > 0)
        at, node, k = at[ok], step[ok], k + 1
        piece = trie.piece[node]
        hit = np.flatnonzero(piece >= 0)
        found.append((at[hit], at[hit] + k, piece[hit]))
        single[at[hit][sizes[at[hit]] == k]] = True
        inside = at + k < end_of[at]
        at, node = at[inside], node[inside]
    bare = start[~single[start]]
    found.append((bare, np.minimum(bare + sizes[bare], end_of[bare]), np.full(len(bare), -1)))
    begin, end, piece = (np.concatenate(c) for c in zip(*found, strict=True))
    return begin, end, piece, np.where(piece >= 0, trie.scores[piece], trie.unknown)


def _in_step(trie: Trie, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the start and the piece of the best last step into it, over all words at once."""
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(size)), size)
    begin, end, piece, score = _edges(trie, data, offsets[1:][word])
    relative = end - offsets[:-1][word[begin]]
    order = np.lexsort((begin, end, relative))
    begin, end, piece, score, relative = begin[order], end[order], piece[order], score[order], relative[order]
    # a position is kept by the byte before it, so that the end of a word is not the start of the next
    best, back, chosen = np.zeros(len(data) + 1), np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    first_byte = np.zeros(len(data) + 1, bool)
    first_byte[offsets[:-1]] = True
    cuts = np.searchsorted(relative, np.arange(1, int(size.max()) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        s, e = begin[a:b], end[a:b]
        total = score[a:b] + np.where(first_byte[s], 0.0, best[s])
        heads = arrays.starts_of_runs(e)
        n = np.diff(np.append(heads, b - a))
        top = np.maximum.reduceat(total, heads)
        hit = np.flatnonzero(total == np.repeat(top, n))
        group = np.repeat(np.arange(len(heads)), n)[hit]
        hit = hit[arrays.starts_of_runs(group)]
        at = e[hit]
        # the best sum into the end of a word is never read, so the next word's first byte may share its place
        best[at], back[at], chosen[at] = top, s[hit], piece[a:b][hit]
    return back, chosen


def _one_by_one(trie: Trie, word: bytes) -> list[tuple[int, int, int]]:
    """The steps (start, end, piece) of one long word."""
    if not trie.lists:
        trie.lists.update(base=trie.base.tolist(), check=trie.check.tolist(), piece=trie.piece.tolist(), scores=trie.scores.tolist())
    base, check, piece, scores = (trie.lists[k] for k in ("base", "check", "piece", "scores"))
    n, least = len(word), float("-inf")
    best, back, chosen = [0.0] + [least] * n, [0] * (n + 1), [-1] * (n + 1)
    sizes = character_sizes(np.frombuffer(word, np.uint8)).tolist()
    for i in range(n):
        if not sizes[i]:
            continue
        node, single = 0, False
        for k in range(i, n):
            step = base[node] + word[k]
            if not base[node] or check[step] != node:
                break
            node = step
            if piece[node] >= 0:
                single |= k + 1 - i == sizes[i]
                total = best[i] + scores[piece[node]]
                if total > best[k + 1]:
                    best[k + 1], back[k + 1], chosen[k + 1] = total, i, piece[node]
        k = min(i + sizes[i], n)
        if not single and best[i] + trie.unknown > best[k]:
            best[k], back[k], chosen[k] = best[i] + trie.unknown, i, -1
    steps, at = [], n
    while at:
        steps.append((back[at], at, chosen[at]))
        at = back[at]
    return steps[::-1]


def segment(trie: Trie, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words' pieces, one word after another, and where each word's begin."""
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size <= IN_STEP))
    found = []
    if len(short):
        part, at = gather(data, offsets[:-1][short], size[short])
        back, chosen = _in_step(trie, part, at)
        word, here = np.arange(len(short)), at[1:].copy()
        while len(word):
            start = back[here]
            found.append((short[word], start - at[:-1][word] + offsets[:-1][short[word]], here - start, chosen[here]))
            inside = start > at[:-1][word]
            word, here = word[inside], start[inside]
    for w in np.flatnonzero(size > IN_STEP).tolist():
        steps = np.array(_one_by_one(trie, data[offsets[w] : offsets[w + 1]].tobytes()), np.int64)
        found.append((np.full(len(steps), w), steps[:, 0] + offsets[w], steps[:, 1] - steps[:, 0], steps[:, 2]))
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    word, start, length, piece = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(start, kind="stable")
    word, start, length, piece = word[order], start[order], length[order], piece[order]
    each = np.where(piece >= 0, 1, length)
    step = np.repeat(np.arange(len(each)), each)
    within = np.arange(len(step)) - np.repeat(np.cumsum(each) - each, each)
    ids = np.where(piece[step] >= 0, piece[step], trie.byte_ids[data[start[step] + within]])
    return ids.astype(np.int32), np.searchsorted(word[step], np.arange(len(offsets)))


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of an array, one after another, and where each begins."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at


def encode_batch(trie: Trie, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of all texts, one after another, and where each text's begin."""
    full = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[:-1][full], SPACE)
    added = np.zeros(len(offsets), np.int64)
    added[full + 1] = 1
    offsets = offsets + np.cumsum(added)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    begins = np.zeros(len(data), bool)
    if trie.by_word:
        begins[1:] = (data[1:] == SPACE) & (data[:-1] != SPACE)
    begins[offsets[:-1][full]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    _, first, inverse = np.unique(arrays.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    part, at = gather(data, starts[first], (ends - starts)[first])
    ids, begin = segment(trie, part, at)
    sizes = np.diff(begin)[inverse]
    out, word_at = gather(ids, begin[:-1][inverse], sizes)
    return out, word_at[np.searchsorted(starts, offsets)]


def decode_batch(trie: Trie, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts from their ids, without the space in front, and where each begins."""
    sizes = np.diff(trie.begins)[ids]
    data, at = gather(trie.flat, trie.begins[:-1][ids], sizes)
    offsets = at[offsets]
    full = np.flatnonzero(np.diff(offsets))
    data = np.delete(data, offsets[:-1][full])
    gone = np.zeros(len(offsets), np.int64)
    gone[full + 1] = 1
    return data, offsets - np.cumsum(gone)


def _encode(trie):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in arrays.chunks(batch.column("text"), BATCH_BYTES):
                ids, at = encode_batch(trie.value, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(at) - 1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"]
                )

    return find


def _decode(trie):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column("ids")
                if lists.null_count:
                    lists = pa.array([v or [] for v in lists.to_pylist()], pa.list_(pa.int32()))
                at = lists.offsets.to_numpy().astype(np.int64)
                data, offsets = decode_batch(trie.value, lists.values.to_numpy()[at[0] : at[-1]], at - at[0])
                texts = arrays.binaries(data, np.diff(offsets)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], names=["doc_id", "text"])

    return find


def encode(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every text."""
    trie = docs.sparkSession.sparkContext.broadcast(build_trie(read_vocabulary(model)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(trie), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text that the ids stand for; ids have to be an encoding."""
    trie = encoded.sparkSession.sparkContext.broadcast(build_trie(read_vocabulary(model)))
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_decode(trie), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def tokenized(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, lossless (the ids decode to the text) and ids of every text."""
    trie = docs.sparkSession.sparkContext.broadcast(build_trie(read_vocabulary(model)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trie.value
        is_byte = np.zeros(len(known.scores), bool)
        is_byte[known.byte_ids] = True
        for batch in batches:
            for first, data, offsets in arrays.chunks(batch.column("text"), BATCH_BYTES):
                ids, at = encode_batch(known, data, offsets)
                again, places = decode_batch(known, ids, at)
                same = np.array_equal(again, data) and np.array_equal(places, offsets)
                lossless = np.full(len(at) - 1, True) if same else np.array(
                    [np.array_equal(data[a:b], again[c:d]) for a, b, c, d in zip(offsets[:-1], offsets[1:], places[:-1], places[1:], strict=True)], bool
                )
                bytes_so_far = np.concatenate([[0], np.cumsum(is_byte[ids])])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(at) - 1),
                    pa.array(np.diff(at)),
                    pa.array(np.diff(bytes_so_far[at])),
                    pa.array(lossless),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                ], names=["doc_id", "n_tokens", "n_byte_tokens", "lossless", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_tokens long, n_byte_tokens long, lossless boolean, ids array<int>")
