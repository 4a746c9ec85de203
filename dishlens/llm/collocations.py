"""Phrase collocations by dynamic itemset counting over shards of the documents, scanned in a cycle.

Texts (A to Z count as a to z) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into words. All counts
are by language.

1. The documents are cut into words once and written as SHARDS shards, a chunk of text a row: its different words, and the text
   as their numbers, with a zero before each piece. Step t scans shard t modulo SHARDS. Words count from the first step on; a
   longer phrase is activated in the step after both its subphrases (all but the last word, all but the first) have been counted
   MIN_COUNT times, and counts until it has seen each shard once. So pairs count while words still do, and a phrase of four
   words may begin in the fourth step. Steps go on until nothing is left to begin.
2. A phrase is a 62-bit hash and its length. Tasks count their active phrases and hand them out as sorted, packed lists by
   range of hashes; a range's lists meet its state: count, shards seen, last step, step in which the count was reached. A phrase
   that has seen all shards without reaching MIN_COUNT is forgotten, and so is one that was not met for SHARDS - 1 steps.
3. Tasks tell active phrases by two bitmaps, of all phrases that have reached the count and of those that did so in the
   last SHARDS steps. Their size, the same in all steps, is 16 bits for each phrase that can be frequent, at most 2 ** MAX_BITS.
   A false hit begins to count a phrase early or once more, perhaps in some of the shards only. A shard counts once for each
   phrase, and the SHARDS steps after its later subphrase is frequent complete what was seen before; so this costs time and
   changes nothing. Beyond 2 ** MAX_BITS / 16 frequent phrases false hits become more; a step's lists are never more than the
   phrases of its shard.
4. A last scan counts the phrases that reached the count once more, with their texts: lists of hashes, counts and texts by
   range, in which texts of one hash are told by a second one. From these cuts, scores and covers are joined.

Results: null text is empty and gives nothing; a null lang is ``und``. Ties are broken as ``best_phrases`` says; rows that repeat
count each time. A null doc_id is a row like others. Very long texts are worked on by themselves, a chunk each. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dishlens.config import work_dir
from dishlens.llm import arrays
from dishlens.llm.arrays import U
from dishlens.sources.sinks import materialize

SHARDS, LONGEST = 4, 4
MIN_COUNT, COVER_PERCENT, TOP, SCALE = 30, 80, 2_000, 2_000_000
#: Bits of a bitmap, at least and at most 2 to the power of these. A frequent phrase takes BYTES_PER_PHRASE of text at least:
#: MIN_COUNT words of two bytes, each the begin of three phrases that are asked for.
MIN_BITS, MAX_BITS, BYTES_PER_PHRASE = 6, 27, 20
#: Bytes of text of a shard whose phrases make one range of hashes, bytes of text that one task scans, phrases a task holds
#: before it hands them out, and bytes of text whose phrases it puts into words at once.
RANGE_BYTES, TASK_BYTES, HELD, HELD_BYTES = 4 << 20, 32 << 20, 1_250_000, 32 << 20
LENGTH = U(3)
WORDS = "shard int, size long, words binary, codes binary, texts binary, sizes binary, lang binary, langs array<string>, times array<long>"
STATE = "bucket int, keys binary, counts binary, seen binary, last binary, reached binary"
MARKS = "at binary, known binary, recent binary, late long"
LISTS = "bucket int, keys binary, counts binary, texts binary, sizes binary, lang binary, langs array<string>"
FOUND = "lang string, phrase string, n_words int, f long"

PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers, their first bytes first."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(value: pa.Scalar) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(value.as_buffer()), np.uint8)
    return np.ascontiguousarray(data.reshape(8, -1).T).view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_keys(value: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpack(value), dtype=U)


def packed(values: np.ndarray) -> bytes:
    """Small numbers as they are in memory."""
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value.as_buffer()), kind)


def binary(*values: bytes) -> pa.Array:
    return pa.array(values, pa.binary())


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = arrays.starts_of_runs(keys)
    return keys[heads], np.add.reduceat(counts[order], heads)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after another."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Chunk:
    """The words of some documents: where they are, and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> None:
        self.data = arrays.LOWER[data]
        inside = ~BREAK[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        self.starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        self.ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.piece = np.cumsum(PIECE[self.data])[self.starts] if len(data) else self.starts
        self.words = arrays.mix(arrays.span_hashes(self.data, self.starts, self.ends) + lang[self.doc] * U(arrays.BASE))

    def row(self, shard: int, lang: pa.DictionaryArray) -> pa.RecordBatch:
        """The different words, their texts with a space after each, their languages, and the text as their numbers from 1 on."""
        words, at, number = np.unique(self.words, return_index=True, return_inverse=True)
        begins = np.zeros(len(number), bool)
        begins[arrays.starts_of_runs(self.piece, self.doc)] = True
        place = np.arange(len(number)) + np.cumsum(begins)
        codes = np.zeros(place[-1] + 1, kind_of(words))
        codes[place] = number + 1
        of = lang.indices.to_numpy()
        sizes = self.ends[at] - self.starts[at]
        texts = gathered(np.append(self.data, np.uint8(0x20)), self.starts[at], sizes + 1)
        texts[np.cumsum(sizes + 1) - 1] = 0x20
        values = [pack_keys(words), packed(codes), packed(texts), packed(sizes.astype("<u4")), packed(of[self.doc[at]].astype("<u4"))]
        times = np.bincount(of[self.doc], minlength=len(lang.dictionary)).tolist()
        columns = [pa.array([shard], pa.int32()), pa.array([len(self.data)], pa.int64()), *(binary(v) for v in values)]
        columns += [pa.array([lang.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([times], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "size", "words", "codes", "texts", "sizes", "lang", "langs", "times"])


def kind_of(words: np.ndarray) -> str:
    """The type of a text's numbers, by how many words differ."""
    return "<u2" if len(words) < 1 << 16 else "<u4"


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    data, offsets = arrays.flat(batch.column("lang"))
    lang = arrays.span_hashes(data, offsets[:-1], offsets[1:])
    for first, data, offsets in arrays.chunks(batch.column("text")):
        yield first, Chunk(data, offsets, lang[first : first + len(offsets) - 1])


def _cut(shards: int) -> Callable:
    """The chunks of a task's documents, which are dealt to the shards in turn."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for shard in range(shards):
                part = batch.take(pa.array(np.arange((shard - done) % shards, batch.num_rows, shards)))
                for first, chunk in _chunks(part):
                    if len(chunk.words):
                        yield chunk.row(shard, part.column("lang").slice(first, int(chunk.doc[-1]) + 1).dictionary_encode())
            done += batch.num_rows

    return cut


def _texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, hashes of different words, and the text as their numbers."""
    for i in range(batch.num_rows):
        words = unpack_keys(batch.column("words")[i])
        yield i, words, unpacked(batch.column("codes")[i], kind_of(words))


def _in(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    slots = keys >> U(64 - bits)
    return (table[(slots >> U(6)).astype(np.int64)] >> (slots & U(63))) & U(1) > 0


def key_of(sums: np.ndarray, n: int) -> np.ndarray:
    """The key of phrases of ``n`` words, from sums of the words' hashes times powers."""
    return (arrays.mix(sums) & ~LENGTH) | U(n - 1)


def phrases(words: np.ndarray, codes: np.ndarray, bits: int, known: np.ndarray, recent: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of 2, 3 and so on words both of whose subphrases are known: places, keys, if a subphrase is recent, if they are known."""
    key = key_of(words, 1)
    hit = _in(known, bits, key)
    late = np.zeros(len(hit), bool) if recent is None else hit & _in(recent, bits, key)
    no = np.zeros(1, bool)
    at = np.flatnonzero(np.concatenate([no, hit])[codes])
    hashes, late = np.concatenate([np.zeros(1, U), words]), np.concatenate([no, late])[codes[at]]
    sums = hashes[codes[at]]
    for n in range(2, LONGEST + 1):
        left = np.flatnonzero(at[1:] == at[:-1] + 1)
        if not len(left):
            return
        at, late = at[left], late[left] | late[left + 1]
        sums = sums[left] + hashes[codes[at + n - 1]] * U(pow(arrays.BASE, n - 1, 1 << 64))
        key = key_of(sums, n)
        hit = _in(known, bits, key)
        yield at, key, late, hit
        at, sums = at[hit], sums[hit]
        late = late[hit] if recent is None else _in(recent, bits, key[hit])


def _parts(keys: np.ndarray, ranges: int) -> tuple[pa.Array, list[tuple[int, int]]]:
    """The ranges of hashes that ascending keys fall in, and from where to where in them."""
    bucket = (keys >> U(64 - ranges)).astype(np.int32) if ranges else np.zeros(len(keys), np.int32)
    heads = arrays.starts_of_runs(bucket)
    return pa.array(bucket[heads]), list(zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True))


def _count(step: int, bits: int, ranges: int, tables: Broadcast | None) -> Callable:
    """Counts of the active phrases, packed by range of hashes."""
    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
        if not len(keys):
            return
        bucket, parts = _parts(keys, ranges)
        columns = [bucket, binary(*(pack_keys(keys[a:b]) for a, b in parts)), binary(*(pack(counts[a:b]) for a, b in parts))]
        columns += [pa.nulls(len(parts), pa.binary())] * 3
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts", "seen", "last", "reached"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, recent = tables.value if tables else (None, None)
        held, met = [], []
        for batch in batches:
            for _, words, codes in _texts_of(batch):
                if step <= SHARDS:
                    held.append((key_of(words, 1), np.bincount(codes, minlength=len(words) + 1)[1:]))
                if known is not None:
                    met += [key[late] for _, key, late, _ in phrases(words, codes, bits, known, recent)]
                if sum(map(len, met)) > HELD // 2:
                    held.append(np.unique(np.concatenate(met), return_counts=True))
                    met = []
                if sum(len(keys) for keys, _ in held) > HELD:
                    held = [summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD // 2:
                        yield from out(held)
                        held = []
        held += [np.unique(np.concatenate(met), return_counts=True)] if met else []
        if held:
            yield from out(held)

    return count


def _marks(keys: np.ndarray, reached: np.ndarray, bits: int, since: int, longest: int) -> list[pa.Array]:
    """A bit for each phrase of up to ``longest`` words that has reached the count, and one for those that did so after ``since``."""
    take = (reached > 0) & (keys & LENGTH < longest)
    slots, late = keys[take] >> U(64 - bits), reached[take] > since
    at = slots >> U(6)
    heads = arrays.starts_of_runs(at)
    one = U(1) << (slots & U(63))
    values = [np.bitwise_or.reduceat(v, heads) if len(heads) else one for v in (one, np.where(late, one, U(0)))]
    return [binary(pack_keys(at[heads])), *(binary(pack(v)) for v in values), pa.array([int(np.count_nonzero(late))], pa.int64())]


def _merge(step: int, bits: int) -> Callable:
    """The state of a range of hashes after a step."""
    def merge(group: pa.Table) -> pa.Table:
        old = group.filter(group.column("seen").is_valid())
        new = group.filter(group.column("seen").is_null())
        state = [unpack_keys(old.column("keys")[0]), *(unpack(old.column(c)[0]) for c in ("counts", "seen", "last", "reached"))] if old.num_rows else [np.zeros(0, U)] * 5
        size = len(state[0])
        every = np.concatenate([state[0], *map(unpack_keys, new.column("keys"))])
        added = np.concatenate([np.zeros(size, U), *map(unpack, new.column("counts"))])
        # the state comes first, so that its phrases head their runs
        order = np.argsort(every, kind="stable")
        every = every[order]
        heads = arrays.starts_of_runs(every)
        every, added, mine = every[heads], np.add.reduceat(added[order], heads), order[heads] < size
        total, seen, last, reached = (np.zeros(len(every), U) for _ in range(4))
        for column, values in zip((total, seen, last, reached), state[1:], strict=True):
            column[mine] = values
        bit, all_bits = U(1) << U((step - 1) % SHARDS), U((1 << SHARDS) - 1)
        fresh = (added > 0) & (seen & bit == 0)
        total[fresh] += added[fresh]
        seen[fresh] |= bit
        last[added > 0] = step
        reached[(total >= MIN_COUNT) & (reached == 0)] = step
        keep = (reached > 0) | (last + U(SHARDS - 1) > step) & (seen != all_bits)
        every, total, seen, last, reached = (c[keep] for c in (every, total, seen, last, reached))
        values = [pack_keys(every), pack(total), pack(seen), pack(last), pack(reached)]
        columns = [group.column("bucket")[:1], *(binary(v) for v in values), *_marks(every, reached, bits, max(0, step - SHARDS), LONGEST - 1)]
        return pa.table(dict(zip(["bucket", "keys", "counts", "seen", "last", "reached", "at", "known", "recent", "late"], columns, strict=True)))

    return merge


def _bitmaps(marks: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Both bitmaps, from those of each range, and how many phrases are recent."""
    tables, late = np.zeros((2, 1 << (bits - 6)), U), 0
    for batch in marks.select("at", "known", "recent", "late").toArrow().to_batches():
        for at, known, recent in zip(*(batch.column(c) for c in ("at", "known", "recent")), strict=True):
            place = unpack_keys(at)
            tables[0][place] |= unpack(known)
            tables[1][place] |= unpack(recent)
        late += sum(batch.column("late").to_pylist())
    return tables, late


def _all_marks(bits: int) -> Callable:
    """Marks of the frequent phrases of all lengths."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, reached in zip(batch.column("keys"), batch.column("reached"), strict=True):
                yield pa.RecordBatch.from_arrays(_marks(unpack_keys(keys), unpack(reached), bits, 0, LONGEST), names=["at", "known", "recent", "late"])

    return mark


def _texts(bits: int, ranges: int, known: Broadcast) -> Callable:
    """How often a task has each frequent phrase, and its text, packed by range of hashes.

    Phrases are counted by their keys over HELD_BYTES of text; only then is each put into words, once.
    """
    def one_each(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, at, times = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        heads = arrays.starts_of_runs(keys)
        return keys[heads], at[order[heads]], np.add.reduceat(times[order], heads) if len(heads) else times

    def out(held: list[list[np.ndarray]], found: list[tuple[np.ndarray, ...]], langs: list[str]) -> Iterator[pa.RecordBatch]:
        keys, places, times = one_each(found)
        if not len(keys):
            return
        for part in held:
            part[:] = [np.concatenate(part)]
        (codes,), (texts,), (sizes,), (lang,) = held
        starts = np.cumsum(sizes + 1, dtype=np.int64) - sizes - 1
        bucket, parts = _parts(keys, ranges)
        columns, begin = [[] for _ in range(5)], 0
        for i, (a, b) in enumerate(parts):
            n = (keys[a:b] & LENGTH).astype(np.int64) + 1
            ends = np.cumsum(n)
            word = codes[np.arange(ends[-1]) + np.repeat(places[a:b].astype(np.int64) - ends + n, n)]
            spans = sizes[word].astype(np.int64) + 1
            spans[ends - 1] -= 1
            values = pack_keys(keys[a:b]), pack(times[a:b]), packed(gathered(texts, starts[word], spans)), packed(np.add.reduceat(spans, ends - n).astype("<u4")), packed(lang[word[ends - 1]].astype("<u4"))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
            if b - parts[begin][0] > HELD // 8 or i == len(parts) - 1:
                values = [bucket[begin : i + 1], *(binary(*c) for c in columns), pa.array([langs] * (i + 1 - begin), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(values, names=["bucket", "keys", "counts", "texts", "sizes", "lang", "langs"])
                columns, begin = [[] for _ in range(5)], i + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = known.value, {}
        held, found, n_words, n_codes, size = [[], [], [], []], [], 0, 0, 0
        for batch in batches:
            for i, words, codes in _texts_of(batch):
                key = key_of(words, 1)
                hit = np.flatnonzero(_in(table, bits, key))
                place = np.zeros(len(words) + 1, np.int64)
                place[codes] = np.arange(len(codes))
                ones = np.ones(len(codes), np.int64)
                parts = [(key[hit], place[hit + 1], np.bincount(codes, minlength=len(words) + 1)[hit + 1])]
                parts += [(key[hit], at[hit], ones[: np.count_nonzero(hit)]) for at, key, _, hit in phrases(words, codes, bits, table)]
                keys, places, times = one_each(parts)
                found.append((keys, (places + n_codes).astype(np.uint32), times.astype(np.uint32)))
                number = np.array([names.setdefault(lang, len(names)) for lang in batch.column("langs")[i].as_py()], np.int32)
                values = unpacked(batch.column("texts")[i], np.uint8), unpacked(batch.column("sizes")[i], "<u4"), number[unpacked(batch.column("lang")[i], "<u4")]
                for part, value in zip(held, (codes.astype(np.int32) + np.int32(n_words - 1), *values), strict=True):
                    part.append(value)
                n_words, n_codes, size = n_words + len(words), n_codes + len(codes), size + batch.column("size")[i].as_py()
                if sum(len(keys) for keys, *_ in found) > HELD:
                    found = [one_each(found)]
                if size > HELD_BYTES or len(found[0][0]) > HELD // 2:
                    yield from out(held, found, list(names))
                    held, found, n_words, n_codes, size = [[], [], [], []], [], 0, 0, 0
        if found:
            yield from out(held, found, list(names))

    return find


def _sums() -> Callable:
    """The frequent phrases of a range of hashes, from the lists of all tasks."""
    def sums(group: pa.Table) -> pa.Table:
        names, rows = {}, []
        for batch in group.to_batches():
            for i in range(batch.num_rows):
                number = np.array([names.setdefault(lang, len(names)) for lang in batch.column("langs")[i].as_py()], np.int64)
                keys, counts = unpack_keys(batch.column("keys")[i]), unpack(batch.column("counts")[i])
                sizes, lang = (unpacked(batch.column(c)[i], "<u4").astype(np.int64) for c in ("sizes", "lang"))
                rows.append((keys, counts, unpacked(batch.column("texts")[i], np.uint8), sizes, number[lang]))
        keys, counts, texts, sizes, lang = (np.concatenate(c) for c in zip(*rows, strict=True))
        starts = np.cumsum(sizes) - sizes
        told = arrays.mix(arrays.span_hashes(texts, starts, starts + sizes) + lang.astype(U))
        order = np.argsort(keys, kind="stable")
        heads = arrays.starts_of_runs(keys[order])
        if len(arrays.starts_of_runs(keys[order], told[order])) > len(heads):
            order = np.lexsort((told, keys))
            heads = arrays.starts_of_runs(keys[order], told[order])
        f = np.add.reduceat(counts[order], heads)
        enough = f >= MIN_COUNT
        one = order[heads][enough]
        phrase = arrays.binaries(gathered(texts, starts[one], sizes[one]), sizes[one]).cast(pa.string())
        n_words = pa.array((keys[one] & LENGTH).astype(np.int32) + 1, pa.int32())
        return pa.table({"lang": pa.array(list(names), pa.string()).take(pa.array(lang[one])), "phrase": phrase, "n_words": n_words, "f": pa.array(f[enough].astype(np.int64))})

    return sums


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, n_words and f of all phrases of up to LONGEST words with f >= MIN_COUNT; n_words 0 counts all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    folder = work_dir(spark, "phrases")
    rows.mapInArrow(_cut(SHARDS), WORDS).write.partitionBy("shard").parquet(f"{folder}/shards")
    shards = spark.read.schema(WORDS).parquet(f"{folder}/shards")
    total = shards.agg(F.sum("size")).first()[0] or 0
    ranges = max(0, int(np.ceil(np.log2(max(1, total / SHARDS / RANGE_BYTES)))))
    bits = int(np.clip(np.ceil(np.log2(max(1, 16 * total / BYTES_PER_PHRASE))), MIN_BITS, MAX_BITS))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(np.ceil(total / SHARDS / TASK_BYTES)))
    state, tables, step, late = spark.createDataFrame([], STATE), None, 0, 1
    while step < SHARDS or late:
        step += 1
        shard = shards.where(F.col("shard") == (step - 1) % SHARDS).select("words", "codes").coalesce(tasks)
        found = shard.mapInArrow(_count(step, bits, ranges, tables), STATE)
        place = f"{folder}/state-{step % 2}"
        # two places in turn: the state that a step reads stays until the step after it
        state.unionByName(found).groupBy("bucket").applyInArrow(_merge(step, bits), f"{STATE}, {MARKS}").write.mode("overwrite").parquet(place)
        marked = spark.read.schema(f"{STATE}, {MARKS}").parquet(place)
        state = marked.select("bucket", "keys", "counts", "seen", "last", "reached")
        if tables:
            tables.unpersist()
        both, late = _bitmaps(marked, bits)
        tables = spark.sparkContext.broadcast(both)
    tables.unpersist()
    (known, _), _ = _bitmaps(state.select("keys", "reached").mapInArrow(_all_marks(bits), MARKS), bits)
    known = spark.sparkContext.broadcast(known)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(np.ceil(total / HELD_BYTES)))
    lists = shards.drop("shard", "times").coalesce(tasks).mapInArrow(_texts(bits, ranges, known), LISTS)
    counted = lists.groupBy("bucket").applyInArrow(_sums(), FOUND)
    times = shards.select(F.explode(F.arrays_zip("langs", "times")).alias("part")).groupBy(F.col("part.langs").alias("lang")).agg(F.sum("part.times").alias("f"))
    counted = counted.unionByName(times.where("f > 0").select("lang", F.lit("").alias("phrase"), F.lit(0).alias("n_words"), "f"))
    return materialize(counted, "frequent")


def best_phrases(frequent: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and text: lang, rank, phrase, a, l, r, n, score."""
    candidates = frequent.where("n_words >= 2").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    counts = lambda name, value: frequent.where("n_words BETWEEN 1 AND 3").select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"])
    score = f"(CAST({SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))"
    scored = cuts.withColumn("score", F.expr(score)).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = candidates.where("n_words >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.expr(f"CAST(longer AS DECIMAL(19, 0)) * 100 >= CAST(a AS DECIMAL(19, 0)) * {COVER_PERCENT}")
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = frequent.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """The best phrases of each language."""
    return best_phrases(frequent_phrases(docs, text, lang), top)
