"""Which reviews contain a term of a query, counted or drawn from, without listing (query, review) pairs.

A task takes a few hundred reviews at a time. One pass of an automaton over the distinct terms makes a bitmap of reviews for
each term that occurs; a query is the union of its terms' bitmaps, so its matches are counted as bits, and a draw takes the
least of its order under the bitmap. Counts and draws are combined inside the task, so one row per query or draw leaves it.

Counts take some thousand reviews at once, so that a step over a query's terms does much at a time. Terms that few of the reviews
hold have no bitmap then: their reviews are listed with the queries that ask for them, and count where the bitmaps say no yet.

The query list travels with the tasks as distinct terms and numbers, up to ``MAX_BLOCK_BYTES`` (some hundred thousand queries
at one scan). A longer list is cut into blocks of at most that size, one scan each. Texts of queries come to the driver a piece of
``MAX_PIECE_BYTES`` at a time and are turned into numbers there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.functions import text as tx
from dishlens.functions.hashing import draw, hash32
from dishlens.sources.sinks import materialize

MAX_BLOCK_BYTES, MAX_PIECE_BYTES = 256 << 20, 64 << 20
MAX_BLOCK_DRAWS = 200_000
#: What a query, each of its terms and each distinct term take besides the distinct term's text.
QUERY_BYTES, PLACE_BYTES, TERM_BYTES = 24, 4, 60
#: Reviews whose bitmaps are made at once, places of queries' terms and draws worked on at once.
BITMAP_ROWS, STEP_PLACES, STEP_DRAWS = 512, 1 << 18, 512
#: Reviews counted at once, how many of them a term with a bitmap is in at least, and places of queries' terms worked on at once.
COUNT_ROWS, FEW_ROWS, COUNT_PLACES = 2_048, 8, 1 << 15
PRIME = 2_147_483_647


class QueryTerms:
    """Some queries as numbers of distinct terms: ``places[begin[q] : begin[q + 1]]`` are those of query ``q``."""

    def __init__(self, pieces: Iterable[pa.Table]):
        known: dict[str, int] = {}
        ids, sizes, places = [], [], []
        for table in pieces:
            table = table.sort_by("query_id").combine_chunks()
            lists = pa.concat_arrays(table["terms"].chunks) if table.num_rows else pa.array([], pa.list_(pa.string()))
            coded = pc.dictionary_encode(lists.flatten())
            mine = np.array([known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()], "int32")
            ids.append(table["query_id"].to_numpy().astype("int64"))
            sizes.append(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            places.append(mine[coded.indices.to_numpy()])
        ids, sizes, places = np.concatenate(ids), np.concatenate(sizes).astype("int64"), np.concatenate(places).astype("int32")
        self.terms = list(known)
        by_id = np.argsort(ids, kind="stable")
        self.query_ids, self.begin = ids[by_id], np.append(0, np.cumsum(sizes[by_id]))
        first = np.cumsum(sizes) - sizes
        at, _ = _ranges(first[by_id], (first + sizes)[by_id])
        self.places = places[at]

    def automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(self.terms):
            automaton.add_word(term, i)
        if self.terms:
            automaton.make_automaton()
        return automaton

    def count(self, batches: Iterable[pa.Array]) -> np.ndarray:
        """For each query, how many of the lower-cased texts hold one of its terms."""
        automaton, term_of, totals = self.automaton(), itemgetter(1), np.zeros(len(self.query_ids), "int64")
        owner = np.repeat(np.arange(len(self.query_ids), dtype="int32"), np.diff(self.begin))
        asking = owner[np.argsort(self.places, kind="stable")], np.append(0, np.cumsum(np.bincount(self.places, minlength=len(self.terms))))
        del owner
        for batch in batches:
            for k in range(0, len(batch), COUNT_ROWS):
                texts = batch.slice(k, COUNT_ROWS).to_pylist()
                found = [np.fromiter(set(map(term_of, automaton.iter(t))) if t and self.terms else (), "int32") for t in texts]
                row = np.repeat(np.arange(len(found), dtype="int32"), [len(f) for f in found])
                self._add(totals, np.concatenate(found), row, len(found), asking)
        return totals

    def _add(self, totals: np.ndarray, term: np.ndarray, row: np.ndarray, rows: int, asking: tuple[np.ndarray, np.ndarray]) -> None:
        """Count the matches of some reviews, given the pairs of a term and a row that holds it."""
        held = np.bincount(term, minlength=len(self.terms))
        wide = np.flatnonzero(held >= FEW_ROWS)
        slot = np.zeros(len(self.terms), "int32")
        slot[wide] = np.arange(1, len(wide) + 1)
        words = -(-rows // 64)
        bitmaps = np.zeros((len(wide) + 1, words * 8), "uint8")
        some = slot[term] > 0
        at = slot[term[some]].astype("int64") * (words * 8) + (row[some] >> 3)
        np.add.at(bitmaps.reshape(-1), at, (1 << (row[some] & 7)).astype("uint8"))  # each bit once
        bitmaps = bitmaps.view("uint64")
        queries, begin = asking
        term, row = term[~some], row[~some]
        at, of = _ranges(begin[term], begin[term + 1])
        pairs = np.sort(queries[at].astype("int64") * rows + row[of])  # by query
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        buffer = np.empty((0, words), "uint64")
        first = 0
        while first < len(self.query_ids):
            last = max(first + 1, int(np.searchsorted(self.begin, self.begin[first] + COUNT_PLACES, side="right")) - 1)
            mine = slot[self.places[self.begin[first] : self.begin[last]]]
            owner = np.repeat(np.arange(last - first), np.diff(self.begin[first : last + 1]))[mine > 0]
            mine, n = mine[mine > 0], np.bincount(owner, minlength=last - first)
            # the queries with most bitmaps first, so that those that have a next one are at the top
            order, start = np.argsort(-n, kind="stable"), np.cumsum(n) - n
            n, start = n[order], start[order]
            union = np.zeros((last - first, words), "uint64")
            buffer = buffer if len(buffer) >= len(union) else np.empty_like(union)
            for j in range(int(n[0])):
                top = int(np.searchsorted(-n, -j))
                np.take(bitmaps, mine[start[:top] + j], axis=0, out=buffer[:top], mode="clip")
                np.bitwise_or(union[:top], buffer[:top], out=union[:top])
            totals[first + order] += np.bitwise_count(union).sum(axis=1, dtype="int64")
            lo, hi = np.searchsorted(pairs, [first * rows, last * rows])
            place = np.empty(last - first, "int64")
            place[order] = np.arange(last - first)
            query, r = pairs[lo:hi] // rows - first, pairs[lo:hi] % rows
            fresh = (union[place[query], r >> 6] >> (r & 63).astype("uint64")) & np.uint64(1) == 0
            totals[first:last] += np.bincount(query[fresh], minlength=last - first)
            first = last

    def compile(self) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
        """A function from lower-cased texts to the queries that match any, and a bitmap of texts for each of them."""
        automaton = self.automaton()
        slot, term_of = np.zeros(len(self.terms), "int64"), itemgetter(1)

        def match(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            terms, bitmaps = _bitmaps([set(map(term_of, automaton.iter(text))) if text and self.terms else () for text in texts])
            words = bitmaps.shape[1]
            slot[terms] = np.arange(len(terms)) + 1
            queries, unions = [], []
            for k in range(0, len(self.places), STEP_PLACES):
                # a query whose terms fall into two steps comes in both, and is put together below
                mine = slot[self.places[k : k + STEP_PLACES]]
                some = np.flatnonzero(mine)
                if len(some):
                    owner = np.searchsorted(self.begin, k + some, side="right") - 1
                    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    queries.append(owner[heads])
                    unions.append(np.bitwise_or.reduceat(bitmaps[mine[some] - 1], heads, axis=0))
            slot[terms] = 0
            if not queries:
                return np.zeros(0, "int64"), np.zeros((0, words), "uint64")
            query, union = np.concatenate(queries), np.concatenate(unions)
            heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            return query[heads], np.bitwise_or.reduceat(union, heads, axis=0)

        return match


def _bitmaps(found: list) -> tuple[np.ndarray, np.ndarray]:
    """From the terms found in each text: the distinct ones, and a bitmap of texts for each."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    terms, at = np.unique(np.fromiter(chain.from_iterable(found), "int64", len(row)), return_inverse=True)
    flags = np.zeros((len(terms), -(-len(found) // 64) * 64), bool)
    flags[at, row] = True
    return terms, np.packbits(flags, axis=1, bitorder="little").view("uint64")


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and the range each comes from."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (begin - np.cumsum(size) + size)[of], of


def term_blocks(queries: DataFrame, max_bytes: int = MAX_BLOCK_BYTES, max_piece_bytes: int = MAX_PIECE_BYTES) -> Iterator[QueryTerms]:
    """All queries as one block if they are within the bound, else block by block."""
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), tx.query_terms("query").alias("terms"))
    rows = rows.where(F.size("terms") > 0)
    text = F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + PLACE_BYTES)
    n, places, texts = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.sum(text), F.lit(0))).first()
    distinct = rows.select(F.explode("terms").alias("t")).distinct().agg(F.coalesce(F.sum(F.octet_length("t") + TERM_BYTES), F.lit(0))).first()[0]
    blocks = 1 + (n * QUERY_BYTES + places * PLACE_BYTES + distinct) // max_bytes
    pieces = 1 + texts * 2 // (blocks * max_piece_bytes)
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks * pieces))
    if blocks * pieces > 1:
        rows = materialize(rows, "query-terms")
        most = rows.groupBy(number.alias("piece")).agg(F.sum(text).alias("text")).agg(F.max("text")).first()[0]
        if most > 4 * max_piece_bytes:
            raise ValueError("query ids are not unique, or a query is very long")
    for b in range(blocks):
        yield QueryTerms((rows.where(number == b * pieces + p) if blocks * pieces > 1 else rows).toArrow() for p in range(pieces))


def match_counts(reviews: DataFrame, queries: DataFrame, max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``query_id, n_matches`` for queries with at least one matching review."""
    lowered = reviews.select(F.lower("review_text").alias("lowered"))
    parts = [_count_block(lowered, block) for block in term_blocks(queries, max_bytes)]
    return reduce(DataFrame.union, parts).groupBy("query_id").agg(F.sum("n").alias("n_matches"))


def _count_block(lowered: DataFrame, block: QueryTerms) -> DataFrame:
    shared = lowered.sparkSession.sparkContext.broadcast(block)
    out_schema = pa.schema([("query_id", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        totals = terms.count(batch.column("lowered") for batch in batches)
        some = totals > 0
        yield pa.RecordBatch.from_arrays([pa.array(terms.query_ids[some]), pa.array(totals[some])], schema=out_schema)

    return lowered.mapInArrow(count, "query_id bigint, n bigint")


def draw_factors(seed: int, strategy: str, j: Column) -> tuple[Column, Column]:
    """Factor and offset under which draw ``j`` orders the reviews."""
    return (
        draw(seed, strategy, j, "factor", F.lit(PRIME - 1)) + 1,
        draw(seed, strategy, j, "offset", F.lit(PRIME)),
    )


def draw_matches(
    reviews: DataFrame, queries: DataFrame, draws: DataFrame, seed: int, strategy: str, max_bytes: int = MAX_BLOCK_BYTES, max_draws: int = MAX_BLOCK_DRAWS
) -> DataFrame:
    """``j, review_id``: for each draw ``j, query_id`` one matching review, each of them equally likely.

    A draw puts the reviews in an order of its own, ``(factor * h(review) + offset) mod p``, and takes the first that
    matches: the least value over all matching reviews, which combines like any minimum. Draws whose query matches no
    review give no row. Draws are collected once, ``max_draws`` at a time; only the queries that are drawn travel.
    """
    factor, offset = draw_factors(seed, strategy, F.col("j"))
    draws = draws.select("j", "query_id", factor.alias("a"), offset.alias("b"))
    point = F.pmod(hash32(F.col("review_id").cast("string")), F.lit(PRIME)).alias("x")
    scanned = reviews.select(F.col("review_id").cast("bigint").alias("review_id"), point, F.lower("review_text").alias("lowered"))
    rounds = 1 + draws.count() * 2 // max_draws
    parts = []
    for r in range(rounds):
        some = draws.where(F.pmod(F.xxhash64("j"), F.lit(rounds)) == r) if rounds > 1 else draws
        table = some.toArrow()
        wanted = queries.join(some.select("query_id").distinct(), "query_id", "left_semi")
        for block in term_blocks(wanted, max_bytes):
            parts.append(_pick_block(scanned, block, table.filter(pc.is_in(table["query_id"], pa.array(block.query_ids)))))
    best = reduce(DataFrame.union, parts).groupBy("j").agg(F.min(F.struct("h", "review_id")).alias("m"))
    return best.select("j", F.col("m.review_id").alias("review_id"))


def _pick_block(scanned: DataFrame, block: QueryTerms, draws: pa.Table) -> DataFrame:
    shared = scanned.sparkSession.sparkContext.broadcast((block, draws.sort_by("query_id")))
    out_schema = pa.schema([("j", pa.int64()), ("h", pa.int64()), ("review_id", pa.int64())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, table = shared.value
        match = terms.compile()
        j, a, b, q = (table[c].to_numpy() for c in ("j", "a", "b", "query_id"))
        begin = np.searchsorted(q, terms.query_ids)
        n_draws = np.searchsorted(q, terms.query_ids, side="right") - begin
        least, chosen = np.full(len(j), PRIME, dtype="int64"), np.full(len(j), -1, dtype="int64")
        for batch in batches:
            for k in range(0, batch.num_rows, BITMAP_ROWS):
                part = batch.slice(k, BITMAP_ROWS)
                part = part.take(pc.sort_indices(part["review_id"]))  # equal values go to the least id
                review_id, x = part["review_id"].to_numpy(), part["x"].to_numpy()
                query, bitmaps = match(part["lowered"].to_pylist())
                n = n_draws[query]
                at = np.repeat(begin[query] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                of = np.repeat(np.arange(len(query)), n)
                for s in range(0, len(at), STEP_DRAWS):
                    mine, own = at[s : s + STEP_DRAWS], of[s : s + STEP_DRAWS]
                    able = np.unpackbits(bitmaps[own].view("uint8"), axis=1, count=len(x), bitorder="little").view(bool)
                    h = np.where(able, (a[mine, None] * x[None, :] + b[mine, None]) % PRIME, PRIME)
                    first = np.argmin(h, axis=1)
                    value, row = h[np.arange(len(mine)), first], review_id[first]
                    better = (value < least[mine]) | ((value == least[mine]) & (value < PRIME) & (row < chosen[mine]))
                    least[mine[better]], chosen[mine[better]] = value[better], row[better]
        some = least < PRIME
        yield pa.RecordBatch.from_arrays([pa.array(j[some]), pa.array(least[some]), pa.array(chosen[some])], schema=out_schema)

    return scanned.mapInArrow(pick, "j bigint, h bigint, review_id bigint")
