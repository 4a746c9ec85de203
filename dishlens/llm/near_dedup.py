"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct runs of ``width`` words (one run if it has fewer), as 64-bit hashes; A to Z count as a to z.

1. Sketch of T places. In round i < T every element is thrown into a random place with the value (i, random); in round T + j
   every element is thrown into place j. A place keeps the least value, and a document is done with the first round after which all its
   places are filled, at the latest after 2 T. Two sets agree in a place with the probability of their similarity.
2. Equal sets become one node. The T values make BANDS bands; nodes that agree in a whole band are candidates. At a
   similarity of 0.8 a pair is missed with probability (1 - 0.8 ** 5) ** 40 = 1.3e-7. Band keys that occur once are dropped early
   by a count-min sketch, which never drops one that occurs twice.
3. Every bucket of a band proposes its least and its greatest node to its members; a member's two best proposals are verified on
   full sets, and the links make components.
4. Where a bucket still holds several components, all members of the largest are compared with all members of the others, and
   the others among themselves, in blocks of BLOCK by BLOCK sets, whatever the sizes, except for two single nodes that were verified before.
   Members of one component need no comparison, since a link more changes nothing. So no candidate pair between different
   components goes unverified, a bucket gives as many rows as it has components, and no task gets more than two blocks.

Results: no words, empty or null text: an empty set, linked with nothing. Rows that repeat, or differ in white space or case
only, have equal sets; rows that share a doc_id within a group stay or go together. A null doc_id comes after all others. An empty table gives an empty result. Very long
texts are worked on by themselves, a chunk each; a set is as long as its text. Other columns are not read.
Equal sets are told by a 64-bit hash of a 128-bit one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dishlens.llm import arrays, sketch
from dishlens.llm.arrays import U
from dishlens.llm.components import components
from dishlens.llm.substring_dedup import keyed
from dishlens.sources.sinks import materialize

BANDS, PER_BAND = 40, 5
PLACES = BANDS * PER_BAND
PERCENT = 80
#: Proposals of each node verified before components are compared, and sets in a block of that comparison.
PROPOSALS, BLOCK = 2, 256
LEFT, RIGHT, BOTH = 0, 1, 2
FEATURES = "doc_key long, text_key long, n long, node long, bands binary"


def document_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunk by chunk: number of the first document, offsets of the documents' sets, and the sets, each ascending."""
    for first, data, offsets in arrays.chunks(column):
        data = arrays.LOWER[data]
        starts, ends, doc = arrays.word_spans(data, offsets)
        words = arrays.span_hashes(data, starts, ends)
        begin = np.searchsorted(doc, np.arange(len(offsets)))
        runs = arrays.rolling(words, width)
        at = np.flatnonzero(doc[: len(runs)] == doc[width - 1 :]) if len(runs) else np.zeros(0, np.int64)
        owner, element = doc[at], runs[at]
        n = np.diff(begin)
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            whole = np.array([arrays.rolling(words[begin[d] : begin[d + 1]], int(n[d]))[0] for d in short], U)
            owner, element = np.concatenate([owner, short]), np.concatenate([element, arrays.mix(whole ^ U(arrays.BASE))])
        order = np.lexsort((element, owner))
        owner, element = owner[order], element[order]
        heads = arrays.starts_of_runs(owner, element)
        owner, element = owner[heads], element[heads]
        yield first, np.searchsorted(owner, np.arange(len(offsets))), element


def sketches(offsets: np.ndarray, element: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One row of ``places`` values for each set; a set without elements keeps the greatest value everywhere."""
    n = len(offsets) - 1
    out = np.full(n * places, np.iinfo(np.uint64).max, U)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    for i in range(2 * places):
        if not len(element):
            break
        h = arrays.mix(element + U((2 * i + 1) * arrays.BASE % 2**64))
        place = ((h >> U(32)) * U(places) >> U(32)).astype(np.int64) if i < places else np.full(len(h), i - places)
        value = (U(i) << U(54)) | (arrays.mix(h) >> U(10))
        np.minimum.at(out, doc * places + place, value)
        if i >= places and i < 2 * places - 1:
            continue
        empty = (out.reshape(n, places) == np.iinfo(np.uint64).max).any(axis=1)
        more = empty[doc]
        doc, element = doc[more], element[more]
    return out.reshape(n, places)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    values = values.reshape(len(values), BANDS, PER_BAND)
    key = arrays.mix(np.arange(BANDS, dtype=U) + U(arrays.BASE)) + np.zeros((len(values), 1), U)
    for k in range(PER_BAND):
        key = arrays.mix(key ^ values[:, :, k]) * U(arrays.BASE)
    return key


def set_nodes(offsets: np.ndarray, element: np.ndarray) -> np.ndarray:
    """A hash of each set, from two sums over hashes of its elements and its size."""
    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, U), np.cumsum(x)])
        return total[offsets[1:]] - total[offsets[:-1]]

    a, b = sums(arrays.mix(element)), sums(arrays.mix(element ^ U(0x5851F42D4C957F2D)))
    return arrays.mix(arrays.mix(a) ^ (b * U(arrays.BASE)) ^ np.diff(offsets).astype(U)).view(np.int64)


def _features(width: int) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, element in document_sets(batch.column("text"), width):
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), BANDS), U)
                keys[some] = band_keys(sketches(offsets, element)[some])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_key").slice(first, len(n)),
                    batch.column("text_key").slice(first, len(n)),
                    pa.array(n.astype(np.int64)),
                    pa.array(set_nodes(offsets, element)),
                    arrays.binaries(keys.reshape(-1).view(np.uint8), np.full(len(n), BANDS * 8)),
                ], names=["doc_key", "text_key", "n", "node", "bands"])

    return find


def _bucket_rows(bits: int, table) -> Callable:
    """A row for each band key that may occur twice."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = arrays.binary_bytes(batch.column("bands"))[0].view(U)
            at = np.flatnonzero(sketch.may_repeat(table.value, keys, bits))
            row = at // BANDS
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at].view(np.int64)), pa.array(batch.column("node").to_numpy()[row]), pa.array(batch.column("n").to_numpy()[row])], names=["key", "node", "n"]
            )

    return find


def _wanted_sets(width: int, bits: int, table) -> Callable:
    """The sets of the nodes that a bitmap names, and of some others."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, element in document_sets(batch.column("text"), width):
                node, n = set_nodes(offsets, element), np.diff(offsets)
                take = (n > 0) & sketch.in_bitmap(table.value, node, bits)
                at = np.flatnonzero(take)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_key").slice(first, len(n)).take(pa.array(at)),
                    batch.column("text_key").slice(first, len(n)).take(pa.array(at)),
                    pa.array(node[at]),
                    arrays.binaries(element[np.repeat(take, n)].view(np.uint8), n[at] * 8),
                ], names=["doc_key", "text_key", "node", "elements"])

    return find


def _linked(shared: np.ndarray, n: np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return 100 * shared >= PERCENT * (n + m - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        ok = []
        for a, b in zip(batch.column("a_elements"), batch.column("b_elements"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
            both = np.concatenate([x, y])
            both.sort()
            ok.append(bool(_linked(np.count_nonzero(both[1:] == both[:-1]), len(x), len(y))))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _compare_blocks(group: pa.Table) -> pa.Table:
    """Links between sets of different components, left against right; of one component's links with a set, the first."""
    side = group.column("side").to_numpy()
    node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
    sets = [np.frombuffer(v.as_buffer(), U) for v in group.column("elements").combine_chunks()]
    left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
    found: list[tuple[int, int]] = []
    if len(left):
        sizes = np.array([len(sets[i]) for i in left], np.int64)
        flat = np.concatenate([sets[i] for i in left])
        owner = np.repeat(np.arange(len(left)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for j in right:
            lo, hi = np.searchsorted(flat, sets[j], "left"), np.searchsorted(flat, sets[j], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            shared = np.bincount(owner[at], minlength=len(left))
            linked = left[_linked(shared, sizes, len(sets[j])) & (label[left] != label[j])]
            _, first = np.unique(label[linked], return_index=True)
            found += [(int(node[i]), int(node[j])) for i in linked[first]]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _proposals(buckets: DataFrame) -> DataFrame:
    """For each node, the PROPOSALS ends of its buckets that it shares most buckets with: pivot, node."""
    ends = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    met = buckets.join(ends, "key").select("node", F.explode(F.array("lo", "hi")).alias("pivot")).where("node <> pivot")
    met = met.groupBy("node", "pivot").count()
    best = Window.partitionBy("node").orderBy(F.col("count").desc(), "pivot")
    met = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PROPOSALS).select("pivot", "node")
    # a pair that proposes itself from both ends is one pair
    twice = met.select(F.col("node").alias("pivot"), F.col("pivot").alias("node"))
    return met.join(twice.where("pivot > node"), ["pivot", "node"], "left_anti")


def _unresolved(buckets: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
    """Components to compare: for each bucket with several, the largest as center and each other one.

    Two others of one bucket have the same center and are compared there, so a bucket needs no pairs of them.
    """
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = buckets.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("root", "node").alias("label")).distinct()
    placed = placed.join(sizes.withColumnRenamed("root", "label"), "label", "left").fillna(1, ["size"])
    ends = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("size").alias("most"), F.count(F.lit(1)).alias("labels")]
    several = placed.groupBy("key").agg(*ends).where("lo <> hi")
    # two single nodes that were compared are settled; a root that was compared says nothing of its component's other nodes
    done = tried.select(F.least("pivot", "node").alias("lo"), F.greatest("pivot", "node").alias("hi"), F.lit(True).alias("done")).distinct()
    several = several.join(done, ["lo", "hi"], "left").where("labels > 2 OR most > 1 OR done IS NULL").select("key")
    placed = placed.join(several, "key", "left_semi")
    center = placed.groupBy("key").agg(F.max(F.struct("size", F.bitwise_not("label").alias("rank"))).alias("best"))
    pairs = placed.join(center.select("key", F.bitwise_not("best.rank").alias("center")), "key")
    return pairs.where("label <> center").select("center", F.col("label").alias("other")).distinct()


def _across(pairs: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between a center and its others, and between its others, compared in blocks of sets."""
    roots = materialize(sets.select("node").join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")
    own = pairs.select("center").distinct().join(roots, F.col("center") == F.col("label")).select("center", "node", "label")
    others = pairs.join(roots, F.col("other") == F.col("label")).select("center", "node", "label")
    n = own.groupBy("center").agg(F.count(F.lit(1)).alias("xs")).join(others.groupBy("center").agg(F.count(F.lit(1)).alias("ys")), "center")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    n = materialize(n.select("center", blocks("xs"), blocks("ys")), "blocks")
    own, others = own.join(n, "center"), others.join(n, "center")
    each = lambda first, count: F.sequence(first, count - 1)
    of = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    zero, y = F.lit(0), F.col("y")
    own = own.withColumn("x", of("xs")).select("center", "node", "label", F.lit(True).alias("mixed"), "x", F.explode(each(zero, F.col("ys"))).alias("y"), F.lit(LEFT).alias("side"))
    others = others.withColumn("y", of("ys"))
    across = others.select("center", "node", "label", F.lit(True).alias("mixed"), F.explode(each(zero, F.col("xs"))).alias("x"), "y", F.lit(RIGHT).alias("side"))
    # blocks of others among themselves: one as left side of itself and those behind, and as right side of those before
    up = others.select("center", "node", "label", F.lit(False).alias("mixed"), y.alias("x"), F.explode(each(y, F.col("ys"))).alias("y"))
    up = up.withColumn("side", F.when(F.col("x") == F.col("y"), F.lit(BOTH)).otherwise(F.lit(LEFT)))
    down = others.where("y > 0").select("center", "node", "label", F.lit(False).alias("mixed"), F.explode(each(zero, y)).alias("x"), "y", F.lit(RIGHT).alias("side"))
    rows = own.unionByName(across).unionByName(up).unionByName(down).join(sets, "node")
    rows = rows.select("center", "mixed", "x", "y", "side", "node", "label", "elements")
    return rows.groupBy("center", "mixed", "x", "y").applyInArrow(_compare_blocks, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """One row for each document: doc_key, text_key, n_shingles, component_key (the least doc_key it is linked with)."""
    rows = keyed(docs, doc_id, text).select("doc_key", "text_key", "text")
    features = materialize(rows.mapInArrow(_features(width), FEATURES), "sets")
    some = features.where("n > 0")
    nodes = materialize(some.groupBy("node").agg(F.min(F.struct("doc_key", "text_key")).alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    bits = sketch.bits_for(nodes.count() * BANDS)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield arrays.binary_bytes(batch.column("bands"))[0].view(U)

    table = sketch.repeated_keys(nodes.select("bands"), keys, bits)
    buckets = materialize(nodes.select("node", "n", "bands").mapInArrow(_bucket_rows(bits, table), "key long, node long, n long"), "buckets")
    tried = materialize(_proposals(buckets), "proposals")
    ends = tried.select("node").unionByName(tried.select(F.col("pivot").alias("node"))).distinct()
    # every node of a bucket of two or more is in a proposal
    wanted_bits, wanted = sketch.bitmap(ends, "node")
    heads = nodes.select("node", F.col("head.doc_key").alias("doc_key"), F.col("head.text_key").alias("text_key")).join(ends, "node", "left_semi")
    found = rows.mapInArrow(_wanted_sets(width, wanted_bits, wanted), "doc_key long, text_key long, node long, elements binary")
    sets = materialize(found.join(heads, ["node", "doc_key", "text_key"], "left_semi").select("node", "elements").dropDuplicates(["node"]), "elements")
    links = materialize(_verified(tried, sets), "links")
    labels = components(links)
    pairs = materialize(_unresolved(buckets, labels, tried), "pairs")
    if not pairs.isEmpty():
        links = materialize(links.unionByName(_across(pairs, labels, sets)), "links")
        labels = components(links)
    placed = nodes.select("node", "head.doc_key").join(labels, "node", "left").select("node", "doc_key", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_key").alias("component_key"))
    placed = placed.join(least, "root").select("node", "component_key")
    own = some.select("doc_key", "text_key", "n", "node").join(placed, "node").select("doc_key", "text_key", F.col("n").alias("n_shingles"), "component_key")
    return own.unionByName(features.where("n = 0").select("doc_key", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_key").alias("component_key")))


def _verified(tried: DataFrame, sets: DataFrame) -> DataFrame:
    """Proposed pairs whose sets are similar enough: a, b."""
    b = sets.select(F.col("node").alias("b"), F.col("elements").alias("b_elements"))
    a = sets.select(F.col("node").alias("a"), F.col("elements").alias("a_elements"))
    fits = 100 * F.least(F.length("a_elements"), F.length("b_elements")) >= PERCENT * F.greatest(F.length("a_elements"), F.length("b_elements"))
    pairs = tried.select(F.col("pivot").alias("a"), F.col("node").alias("b")).join(b, "b").join(a, "a").where(fits)
    return pairs.select("a", "b", "a_elements", "b_elements").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    known = lambda key: F.when(F.col(key) != arrays.LAST_ID, F.col(key))
    return classes(docs, doc_id, text, width).select(
        known("doc_key").alias("doc_id"), "n_shingles", known("component_key").alias("component_id"), (F.col("doc_key") == F.col("component_key")).alias("kept")
    )


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group, with all their columns."""
    found = classes(docs, doc_id, text, width)
    kept = found.where("doc_key = component_key").select("doc_key", "text_key").distinct()
    left, right = arrays.unused(docs, "doc_key"), arrays.unused(docs, "text_key")
    keyed_docs = docs.withColumns({left: arrays.document_key(doc_id), right: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return keyed_docs.join(kept.select(F.col("doc_key").alias(left), F.col("text_key").alias(right)), [left, right], "left_semi").select(docs.columns)

