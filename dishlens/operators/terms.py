"""Which terms of a dictionary occur inside a text, as plain substrings.

A dictionary within a checked size is scanned for in one pass over each text: no shuffle, and the work grows with the
text and not with text x terms. A larger one is cut into blocks of that size, with one such pass each; between the passes only
the places of terms found are written, and a text that has all it may list leaves the later passes. Terms of any length
count, and the rows are the same whatever the cut.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.sources.sinks import materialize

MAX_SCAN_TERMS = 200_000
MAX_SCAN_CHARS = 8_000_000
#: Texts that have all their mentions up to which their keys go to every task; more are joined.
MAX_BROADCAST_DONE = 1_000_000
#: Texts that are Python strings at once.
STEP_TEXTS = 256


@dataclass(frozen=True)
class Dictionary:
    """A bounded dictionary on the driver: ``terms[i]`` has rank ``ranks[i]``."""

    ranks: tuple[int, ...]
    terms: tuple[str, ...]


def fetch_dictionary(dictionary: DataFrame, max_terms: int = MAX_SCAN_TERMS, max_chars: int = MAX_SCAN_CHARS) -> Dictionary | None:
    """The dictionary if its size allows one copy per task, else None. At most ``max_terms + 1`` rows come here."""
    rows = dictionary.select("rank", "term").limit(max_terms + 1).collect()
    if len(rows) > max_terms or sum(len(r.term) for r in rows) > max_chars:
        return None
    rows.sort(key=lambda r: r.rank)
    return Dictionary(tuple(r.rank for r in rows), tuple(r.term for r in rows))


@dataclass(frozen=True)
class Listing:
    """An output list of a scan: labels with the words that stand for each, and how many labels to list at most."""

    name: str
    words_of: tuple[tuple[str, tuple[str, ...]], ...]
    keep: int | None = None


def scan(lowered: Column, listings: list[Listing]) -> Column:
    """One array per listing, as a struct: the labels one of whose words is inside the lower-cased text, in order.

    One automaton per task, fed with Arrow batches.
    """
    labels = [label for x in listings for label, _ in x.words_of]
    lists: dict[str, list[int]] = {}
    i = 0
    ends = []
    for x in listings:
        for _, words in x.words_of:
            for word in words:
                lists.setdefault(word, []).append(i)
            i += 1
        ends.append(i)
    keep = [x.keep for x in listings]
    names = [x.name for x in listings]
    ids_of = {word: tuple(ids) for word, ids in lists.items()}

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, ids in ids_of.items():
            automaton.add_word(word, ids)
        if ids_of:
            automaton.make_automaton()
        for batch in batches:
            for k in range(0, len(batch), STEP_TEXTS):
                columns = [[] for _ in ends]
                for text in batch.slice(k, STEP_TEXTS).to_pylist():
                    hits = sorted({*chain.from_iterable(set(map(itemgetter(1), automaton.iter(text))))}) if text and ids_of else []
                    start = 0
                    for column, end, most in zip(columns, ends, keep):
                        stop = bisect_left(hits, end, start)
                        last = stop if most is None else min(stop, start + most)
                        column.append([labels[i] for i in hits[start:last]])
                        start = stop
                yield pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.string())) for c in columns], names)

    return F.arrow_udf(found, "struct<" + ", ".join(f"{n}: array<string>" for n in names) + ">")(lowered)


def dictionary_blocks(dictionary: DataFrame, max_terms: int = MAX_SCAN_TERMS, max_chars: int = MAX_SCAN_CHARS) -> Iterator[Dictionary]:
    """The dictionary by rank, in blocks of a size that one copy per task allows; one block at a time is here."""
    ranks, terms, chars = [], [], 0
    for row in dictionary.select("rank", "term").orderBy("rank").toLocalIterator():
        if terms and (len(terms) == max_terms or chars + len(row.term) > max_chars):
            yield Dictionary(tuple(ranks), tuple(terms))
            ranks, terms, chars = [], [], 0
        ranks.append(row.rank)
        terms.append(row.term)
        chars += len(row.term)
    yield Dictionary(tuple(ranks), tuple(terms))


def with_mentions(
    df: DataFrame,
    dictionary: DataFrame,
    text_col: str = "review_text",
    out_col: str = "mentioned_foods",
    max_mentions: int = 5,
    max_scan_terms: int = MAX_SCAN_TERMS,
    max_scan_chars: int = MAX_SCAN_CHARS,
) -> DataFrame:
    """Add the ``max_mentions`` first terms of the dictionary, by rank, that the text contains.

    Each block of the dictionary is one pass over the texts that are not done; as blocks come by rank, what is found is only
    added to. A text is known by two hashes of its own, so rows need no id and equal texts are scanned for alike.
    """
    small = fetch_dictionary(dictionary, max_scan_terms, max_scan_chars)
    if small is not None:
        return with_mentions_of(df, small, text_col, out_col, max_mentions)
    key = [F.xxhash64(text_col).alias("_key"), F.hash(text_col).alias("_check")]
    texts = df.where(F.col(text_col).isNotNull()).select(*key, text_col)
    found: DataFrame | None = None
    for number, block in enumerate(dictionary_blocks(dictionary, max_scan_terms, max_scan_chars)):
        going = texts
        if found is not None:
            done = found.groupBy("_key", "_check").agg(F.sum(F.size("_terms")).alias("_n")).where(F.col("_n") >= max_mentions).select("_key", "_check")
            done = materialize(done, "done")
            few = done.count() <= MAX_BROADCAST_DONE
            going = texts.join(F.broadcast(done) if few else done, ["_key", "_check"], "left_anti")
        hits = with_mentions_of(going, block, text_col, "_terms", max_mentions).where(F.size("_terms") > 0)
        hits = hits.groupBy("_key", "_check").agg(F.first("_terms").alias("_terms")).withColumn("_block", F.lit(number))
        hits = materialize(hits, "mentions")
        found = hits if found is None else found.unionByName(hits)
    ordered = F.array_sort(F.collect_list(F.struct("_block", "_terms")))  # a row for each block that a text has terms of
    lists = found.groupBy("_key", "_check").agg(F.slice(F.flatten(F.transform(ordered, lambda x: x["_terms"])), 1, max_mentions).alias(out_col))
    columns = [F.col(c) for c in df.columns if c != out_col]
    joined = df.withColumns({"_key": key[0], "_check": key[1]}).drop(out_col).join(lists, ["_key", "_check"], "left")
    return joined.select(*columns, F.coalesce(out_col, F.array().cast("array<string>")).alias(out_col))


def with_mentions_of(
    df: DataFrame, dictionary: Dictionary, text_col: str, out_col: str = "mentioned_foods", max_mentions: int = 5
) -> DataFrame:
    scanned = df.withColumn("_scan", scan(F.lower(text_col), [mentions_listing(dictionary, out_col, max_mentions)]))
    return scanned.withColumn(out_col, F.col(f"_scan.{out_col}")).drop("_scan")


def mentions_listing(dictionary: Dictionary, name: str, max_mentions: int) -> Listing:
    return Listing(name, tuple((t, (t.lower(),)) for t in dictionary.terms), max_mentions)
