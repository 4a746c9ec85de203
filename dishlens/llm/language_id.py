"""Language of a text by the rank order of its n-grams.

A language's profile is the list of its most frequent n-grams of 1 to 3 letters, the most frequent first (ties by code
points). A text gets a list of its own, and its distance to a language is the sum over its n-grams of how far their place is
from that in the profile; an n-gram that the profile lacks counts the profile's length. The nearest language wins, ties by
name. The score is the margin to the second, as a share of the second's distance plus the nearest's, mapped to 0.5 to 1; with
one language it is 1.

Text: every letter of the whole text counts, lower-cased; runs of letters are words, with one space on each side.

Learning: counts over all labelled rows, so a language's profile does not depend on how common the others are; counting and
ranking are Spark aggregations over n-grams already counted in each task, and a profile has LENGTH entries a language. Prediction
covers every row of every size.

Results: `und` and score 0 if the text is null, has no letter, or nothing was learned. Rows with a null lang or text teach nothing. Repeated
rows are rows like others. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES, LENGTH = (1, 2, 3), 400
#: N-grams a task holds before it hands out their counts.
HELD_GRAMS = 1 << 20
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
BITS = 21


def held_out(doc_id: str) -> Column:
    """Whether a row's id falls into the fold that teaches nothing; a null id teaches nothing either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of anything but letters as one space, spaces at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64)
    known, inverse = np.unique(codes, return_inverse=True)
    alphabetic = np.array([chr(c).isalpha() for c in known.tolist()], bool)[inverse]
    if not alphabetic.any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate([[0], np.where(alphabetic, codes, 0), [0]]).astype(np.uint64)
    return codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]


def grams(text: str) -> np.ndarray:
    """Every n-gram of the text as one number; those that are a space alone are left out."""
    codes = letters(text)
    found = []
    for n in SIZES:
        if len(codes) >= n:
            number = codes[: len(codes) - n + 1].copy()
            for k in range(1, n):
                number = (number << np.uint64(BITS)) | codes[k : len(codes) - n + 1 + k]
            found.append(number[number > 0] if n == 1 else number)
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def ranked(text: str) -> np.ndarray:
    """The text's most frequent n-grams, in the order of their rank."""
    values, count = np.unique(grams(text), return_counts=True)
    return values[np.lexsort((values, -count))][:LENGTH]


def _counted(texts: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, found in texts.items():
        values, count = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, one row for each in about HELD_GRAMS of a task."""
    texts: dict[str, list[np.ndarray]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            found = grams(text.as_py())
            texts.setdefault(lang.as_py(), []).append(found)
            held += len(found)
            if held >= HELD_GRAMS:
                yield from _counted(texts)
                texts, held = {}, 0
    yield from _counted(texts)


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Profiles by language from all rows of (key, lang, text)."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = known.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LENGTH).collect()
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in rows:
        profiles.setdefault(row["lang"], []).append((row["place"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(p)], np.int64) for lang, p in sorted(profiles.items())}


def _places(profiles: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all n-grams of all profiles ascending, and the place of each in each; LENGTH counts as beyond any."""
    every = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.int64)
    table = np.full((len(profiles), len(every) + 1), -1, np.int32)
    for i, profile in enumerate(profiles.values()):
        table[i, np.searchsorted(every, profile)] = np.arange(len(profile))
    return list(profiles), every, table


def nearest(text: str | None, names: list[str], every: np.ndarray, table: np.ndarray) -> tuple[str, float]:
    own = ranked(text) if text and names else ()
    if not len(own):
        return UNKNOWN, 0.0
    at = np.searchsorted(every, own)
    at[(at == len(every)) | (every[np.minimum(at, len(every) - 1)] != own)] = len(every)
    place = table[:, at]
    distance = np.where(place < 0, LENGTH, np.abs(place - np.arange(len(own)))).sum(axis=1)
    best = int(np.argmin(distance))
    if len(names) == 1:
        return names[best], 1.0
    second = float(np.delete(distance, best).min())
    total = second + float(distance[best])
    return names[best], round(second / total, 6) if total else 0.5


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    places = docs.sparkSession.sparkContext.broadcast(_places(profiles))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(v.as_py(), *places.value) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    teaching = docs.where(~held_out(doc_id)).select(F.col(doc_id).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = predict(docs, learn(teaching), doc_id, text)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
