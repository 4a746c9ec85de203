"""Toxicity by a linear classifier that learns not to mind who is mentioned.

Features are the words of a text (runs of letters in lower case) and their first 4 to 7 letters, each as "at least 1, 2 or 3
different words of the text have it". Features are chosen by how surely their share differs between the labels, counted by
Spark over the teaching rows; terms of identity are always among them. Weights minimise

    mean log loss + RIDGE / 2 * |w| ** 2 + SWAP * mean over swaps of (change of the score's logit) ** 2

where a swap replaces one term of identity of a labelled text by another of its group, everything else the same. Terms are
listed for the four languages of the corpus. A text is swapped in every term that it holds; and whatever it holds, a term drawn by a
hash of the text is put into it and swapped with another one of its group, so that every labelled text gives a counterfactual
pair. A group that the labelled texts happen to blame, also through beginnings its terms share with other words, thus gets the
same weight as the others, and being neutral costs least, so it is near zero.

Learning takes at most SAMPLE_ROWS labelled ids (those with the least hash), joined by a broadcast of so many ids. Rows of
equal features and label are summed to one with a weight by Spark, and equal swaps too, before they come to the driver; of what
is then still more than SAMPLE_ROWS rows or MAX_SWAPS swaps, those of the least hash fit the weights.
Scoring covers every row and whole texts, also very long ones, a text at a time. Results: null or empty text is scored by the
intercept alone; without any labelled row of both kinds every score is 0. Of several labels of one id the highest counts, null
labels do not. Repeated rows teach once more each and get the same score. Empty tables give no rows. Labels, lang, source and ids
are never inputs of a score; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm.language_id import held_out
from dishlens.sources.sinks import materialize

SAMPLE_ROWS, MAX_SWAPS, VOCABULARY = 20_000, 20_000, 512
PREFIXES, LEVELS = (4, 5, 6, 7), 3
#: A feature counts if this many teaching texts have it and its share differs by so many standard errors.
MIN_TEXTS, MIN_Z = 5, 4.0
RIDGE, SWAP, STEPS = 1e-4, 1.0, 40
WORDS_REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")
#: Terms of identity by group, in English, German, French and Spanish; a term is swapped with the others of its group.
IDENTITIES = (
    ("man", "woman", "person"),
    ("men", "women", "people"),
    ("boys", "girls", "children"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("german", "french", "spanish", "english", "american", "african", "chinese", "indian"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
    ("mann", "frau", "mensch"),
    ("männer", "frauen", "menschen"),
    ("jungen", "mädchen", "kinder"),
    ("christ", "moslem", "jude", "hindu", "buddhist", "atheist"),
    ("schwul", "lesbisch", "heterosexuell", "transgender", "bisexuell"),
    ("deutscher", "franzose", "spanier", "engländer", "amerikaner", "afrikaner", "chinese", "inder"),
    ("einwanderer", "flüchtling", "einheimischer", "ausländer"),
    ("taub", "blind", "behindert"),
    ("homme", "femme", "personne"),
    ("hommes", "femmes", "gens"),
    ("garçons", "filles", "enfants"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("noir", "blanc", "asiatique"),
    ("homosexuel", "lesbienne", "hétérosexuel", "transgenre", "bisexuel"),
    ("allemand", "français", "espagnol", "anglais", "américain", "africain", "chinois", "indien"),
    ("immigré", "réfugié", "étranger"),
    ("sourd", "aveugle", "handicapé"),
    ("hombre", "mujer", "persona"),
    ("hombres", "mujeres", "gente"),
    ("chicos", "chicas", "niños"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("negro", "blanco", "asiático"),
    ("homosexual", "lesbiana", "heterosexual", "transgénero", "bisexual"),
    ("alemán", "francés", "español", "inglés", "americano", "africano", "chino", "indio"),
    ("inmigrante", "refugiado", "extranjero"),
    ("sordo", "ciego", "discapacitado"),
)


def stems(word: str) -> list[str]:
    """The word as a whole, marked by its end, and its beginnings."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if len(word) >= k)]


def stem_counts(found: set[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for word in found:
        for stem in stems(word):
            counts[stem] = counts.get(stem, 0) + 1
    return counts


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(text: str | None) -> set[str]:
    """All features of a text: a stem and the number of different words that have it, up to LEVELS."""
    return {f"{stem}*{level}" for stem, n in stem_counts(words(text)).items() for level in range(1, min(n, LEVELS) + 1)}


def _change(counts: dict[str, int], gone: str, came: str | None) -> tuple[list[str], list[str]]:
    """The features that go and those that come when a word of a text gives way to another; None if that is there already."""
    changes = dict.fromkeys(stems(gone), -1)
    for stem in stems(came) if came else ():
        changes[stem] = changes.get(stem, 0) + 1
    out, into = [], []
    for stem, change in changes.items():
        n = counts.get(stem, 0)
        out += [f"{stem}*{level}" for level in range(n + change + 1, min(n, LEVELS) + 1)]
        into += [f"{stem}*{level}" for level in range(n + 1, min(n + change, LEVELS) + 1)]
    return out, into


def swaps(text: str | None, identities: tuple) -> Iterator[tuple[list[str], list[str]]]:
    """For each term of identity in the text and each other of its group, the features that go and those that come."""
    found = words(text)
    counts: dict[str, int] | None = None
    for group in identities:
        for term in found.intersection(group):
            counts = stem_counts(found) if counts is None else counts
            for other in group:
                if other != term:
                    yield _change(counts, term, None if other in found else other)


def drawn_swap(text: str | None, identities: tuple) -> Iterator[tuple[list[str], list[str]]]:
    """The same for a term that a hash of the text draws, once it has been put into the text."""
    found = words(text)
    number = zlib.crc32((text or "").encode("utf-8", "replace"))
    group = identities[number % len(identities)]
    number //= len(identities)
    term, other = group[number % len(group)], group[(number + 1 + number // len(group) % (len(group) - 1)) % len(group)]
    if term not in found and other not in found:
        yield _change(stem_counts(found | {term}), term, other)


@dataclass(frozen=True)
class Model:
    """Weights by feature and the intercept; with intercept None nothing was learned. And how many swaps it learned from."""

    weights: dict[str, float]
    intercept: float | None
    swaps: int = 0

    def scorer(self) -> Callable[[str | None], float]:
        """A function from text to score that remembers, for a bounded number of words, which stems of theirs have a weight."""
        sums: dict[str, list[float]] = {}
        for feature in self.weights:
            stem = feature.rpartition("*")[0]
            steps = [self.weights.get(f"{stem}*{level}", 0.0) for level in range(1, LEVELS + 1)]
            sums[stem] = [sum(steps[:n]) for n in range(LEVELS + 1)]
        known: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            if self.intercept is None:
                return 0.0
            if len(known) > WORDS_REMEMBERED:
                known.clear()
            counts: dict[str, int] = {}
            for word in words(text):
                found = known.get(word)
                if found is None:
                    found = known[word] = tuple(x for x in stems(word) if x in sums)
                for stem in found:
                    counts[stem] = counts.get(stem, 0) + 1
            z = self.intercept + sum(sums[x][min(counts[x], LEVELS)] for x in sorted(counts))
            return round(float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))), 9)

        return score


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by feature and label, one row for each feature in a batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            for feature in features(text.as_py()):
                counts.setdefault(feature, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
            names=["feature", "clean", "toxic"],
        )


def choose_features(teaching: DataFrame, clean: int, toxic: int) -> list[str]:
    """The features whose shares of texts differ most surely, ties by name."""
    counts = teaching.mapInArrow(_feature_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    error = F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic))
    z = F.round(F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / error, 6)
    counts = counts.where((F.col("clean") + F.col("toxic") >= MIN_TEXTS) & (share < 1)).withColumn("z", z).where(F.col("z") >= MIN_Z)
    return [row["feature"] for row in counts.orderBy(F.col("z").desc(), "feature").limit(VOCABULARY).collect()]


def fit(
    rows: list[np.ndarray], toxic: np.ndarray, size: int, changes: dict[tuple[int, ...], int], swap: float = SWAP, times: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps, halved while they do not lower the loss.

    ``times``: how often each row counts, once unless given. ``changes``: how often a swap changes which features, those that
    come as i + 1 and those that go as -(i + 1).
    """
    n = len(rows)
    part = np.ones(n) / n if times is None else times / times.sum()
    x = np.zeros((n, size + 1), np.float32)
    x[:, size] = 1
    for i, row in enumerate(rows):
        x[i, row] = 1
    change, often = np.zeros((len(changes), size + 1)), np.zeros(len(changes))
    for i, (signed, n_times) in enumerate(sorted(changes.items())):
        often[i] = n_times
        for at in signed:
            change[i, abs(at) - 1] = 1 if at > 0 else -1
    # quadratic part of the loss: ridge and swaps
    bend = RIDGE * np.eye(size + 1) + 2 * swap * (change.T * (often / max(often.sum(), 1.0))) @ change
    bend[size, size] = 0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(part @ (np.logaddexp(0, z) - toxic * z) + w @ bend @ w / 2)

    w = np.zeros(size + 1)
    share = float(part @ toxic)
    w[size] = np.log((share + 0.5 / n) / (1 - share + 0.5 / n))
    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ ((p - toxic) * part) + bend @ w
        spread = (p * (1 - p) * part).astype(np.float32)
        step = np.linalg.solve((x * spread[:, None]).T @ x + bend + 1e-9 * np.eye(size + 1), gradient)
        size_of = 1.0
        while (then := loss(w - size_of * step)) > now and size_of > 1e-4:
            size_of /= 2
        if now - then < 1e-9:
            break
        w, now = w - size_of * step, then
    return w[:size], float(w[size])


def _term(word: str) -> str:
    return f"{word}$*1"


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", identities: tuple = IDENTITIES, swap: float = SWAP) -> Model:
    """A model from the labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    sample = known.select(F.col(doc_id).alias("id"), "toxic").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    teaching = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "id").select("text", "toxic")
    total = {row["toxic"]: row["count"] for row in teaching.groupBy("toxic").count().collect()}
    if not (total.get(0) and total.get(1)):
        return Model({}, None)
    chosen = choose_features(teaching, total[0], total[1])
    terms = sorted({_term(t) for group in identities for t in group} - set(chosen))
    vocabulary = {w: i for i, w in enumerate([*chosen, *terms])}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            found = [sorted(vocabulary[f] for f in features(t) if f in vocabulary) for t in texts]
            signed = lambda gone, came: sorted([-vocabulary[f] - 1 for f in gone if f in vocabulary] + [vocabulary[f] + 1 for f in came if f in vocabulary])
            swapped = [[signed(*change) for change in (*swaps(t, identities), *drawn_swap(t, identities))] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32()))), batch.column("toxic")], names=["features", "swaps", "toxic"]
            )

    rows = materialize(teaching.mapInArrow(indexed, "features array<int>, swaps array<array<int>>, toxic int"), "features")
    same = rows.groupBy("features", "toxic").agg(F.count(F.lit(1)).alias("n"))
    same = same.orderBy(F.xxhash64("features", "toxic"), "features", "toxic").limit(SAMPLE_ROWS).toArrow()
    changes = rows.select(F.explode("swaps").alias("change")).where(F.size("change") > 0).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    changes = changes.orderBy(F.xxhash64("change"), "change").limit(MAX_SWAPS).collect()
    lists = [np.array(x, np.int64) for x in same.column("features").to_pylist()]
    often = {tuple(row["change"]): row["n"] for row in changes}
    w, b = fit(lists, same.column("toxic").to_numpy().astype(float), len(vocabulary), often, swap, same.column("n").to_numpy().astype(float))
    return Model({name: round(float(w[i]), 6) for name, i in vocabulary.items() if abs(w[i]) >= 1e-6}, round(b, 6), sum(often.values()))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for texts in parts:
            yield texts.map(lambda t: scorer(t) if isinstance(t, str) else scorer(None)).astype("float64")

    return docs.where(scored(F.col(text)) < 0.5)
