"""Turn texts into vectors.

A *space* says how: the encoder, the prefixes for the two roles and, if fitted, the weights. Index and queries must share
one. ``hashed`` is native: words fall into ``dim`` buckets by md5, the weight is the count (times an inverse document
frequency in a fitted space), and rows have unit length. A row is encoded from its own text alone, with no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.functions import text as tx
from dishlens.functions import vectors as vx
from dishlens.functions.hashing import hash32

DEFAULT_DIM = 4096


@dataclass(frozen=True)
class Space:
    """How texts of one index become vectors; kept with the index so that queries are encoded the same way."""

    name: str
    encoder: str = "hashed"
    passage_prefix: str = ""
    query_prefix: str = ""
    dim: int = DEFAULT_DIM
    tokens: str = "words"
    idf: tuple[float, ...] | None = field(default=None, repr=False)

    def key(self) -> str:
        """A short mark of everything that makes vectors of this space comparable."""
        told = (self.name, self.encoder, self.passage_prefix, self.query_prefix, self.dim, self.tokens, self.idf)
        return hashlib.sha256(repr(told).encode()).hexdigest()[:16]

    def prefix(self, role: str) -> str:
        return {"passage": self.passage_prefix, "query": self.query_prefix}[role]


def e5_prefixes(name: str, model_name: str, **kwargs) -> Space:
    """Role prefixes go with the model the vectors came from, not with the place they are stored in."""
    if "e5" in model_name.lower():
        return Space(name, passage_prefix="passage: ", query_prefix="query: ", **kwargs)
    return Space(name, **kwargs)


def check_same_space(index_space: Space, query_space: Space) -> None:
    if index_space != query_space:
        raise ValueError(f"queries in space {query_space.name!r} cannot search an index in space {index_space.name!r}")


def token_column(c: Column | str, tokens: str) -> Column:
    """``words`` for spaced scripts, ``trigrams`` of characters for scripts without spaces."""
    if tokens == "words":
        return tx.words(c)
    chars = F.split(F.lower(tx.as_column(c)), "")
    n = F.size(chars)
    grams = F.transform(
        F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(chars, i, 3), "")
    )
    return F.when(n >= 3, grams).otherwise(F.array().cast("array<string>"))


#: Rows whose words are counted at once, so that what a task holds does not follow the size of its batches.
STEP_ROWS = 256


def _counted(idf: tuple[float, ...] | None) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Buckets of each row -> distinct buckets, ascending, and their unit-length weights; some rows at a time."""
    factors = None if idf is None else np.array(idf)

    def count(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype("int64")
        owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False))
        cells, counts = np.unique((owner << 32) | flat, return_counts=True)
        row, feature = cells >> 32, cells & 0xFFFFFFFF
        weight = counts.astype("float64") if factors is None else counts * factors[feature]
        length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
        ends = np.searchsorted(row, np.arange(n + 1)).astype("int32")
        features = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype("int32")))
        weights = pa.ListArray.from_arrays(pa.array(ends), pa.array(weight / length[row] if len(row) else weight))
        return pa.StructArray.from_arrays([features, weights], ["features", "weights"])

    def in_steps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for k in range(0, len(batch), STEP_ROWS):
                yield count(batch.slice(k, STEP_ROWS))

    return in_steps


def encode(df: DataFrame, text: Column | str, space: Space, role: str) -> DataFrame:
    """Add ``features array<int>`` (ascending, distinct) and ``weights array<double>`` of unit length."""
    if space.encoder != "hashed":
        raise ValueError(f"space {space.name!r} brings its own vectors; use encode_with or a vector column")
    prefixed = F.coalesce(tx.with_prefix(tx.as_column(text), space.prefix(role)), F.lit(""))
    buckets = F.transform(token_column(prefixed, space.tokens), lambda t: F.pmod(hash32(t), F.lit(space.dim)).cast("int"))
    vector = F.arrow_udf(_counted(space.idf), "struct<features: array<int>, weights: array<double>>")(buckets)
    return df.withColumn("_v", vector).withColumns({"features": F.col("_v.features"), "weights": F.col("_v.weights")}).drop("_v")


def feature_idf(encoded: DataFrame, dim: int) -> DataFrame:
    """``feature, df, idf`` over a corpus: ``ln((1 + n) / (1 + df)) + 1``. Rows hold distinct features."""
    total = encoded.agg(F.count(F.lit(1))).scalar()
    counts = encoded.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("feature", "df", (F.log((total + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def fit_idf(encoded: DataFrame, space: Space, name: str) -> Space:
    """A fitted space next to ``space``; the weights that come to the driver are bounded by its ``dim``."""
    total = encoded.count()
    idf = np.full(space.dim, np.log(1.0 + total) + 1.0)
    for row in feature_idf(encoded, space.dim).select("feature", "idf").collect():
        idf[row.feature] = row.idf
    return Space(
        name, space.encoder, space.passage_prefix, space.query_prefix, space.dim, space.tokens, tuple(float(x) for x in idf)
    )


def refitted(encoded: DataFrame, fitted: Space) -> DataFrame:
    """Rows of the unfitted space in the fitted one: same features, weights scaled and brought back to unit length."""
    factors = np.array(fitted.idf)

    def in_steps(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for features, weights in batches:
            for k in range(0, len(features), STEP_ROWS):
                yield scale(features.slice(k, STEP_ROWS), weights.slice(k, STEP_ROWS))

    def scale(features: pa.Array, weights: pa.Array) -> pa.Array:
        n = len(features)
        feature = features.flatten().to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), lengths)
        weight = weights.flatten().to_numpy(zero_copy_only=False) * factors[feature]
        length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(weight / length[row] if len(row) else weight))

    return encoded.withColumn("weights", F.arrow_udf(in_steps, "array<double>")("features", "weights"))


def encode_with(
    df: DataFrame,
    id_col: str,
    text: Column | str,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    space: Space,
    role: str,
    batch_size: int = 64,
) -> DataFrame:
    """``id, vector`` from a model of the caller: ``load`` runs once per task, its result on batches of texts."""
    prefixed = df.select(F.col(id_col), tx.with_prefix(tx.as_column(text), space.prefix(role)).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                vectors = np.asarray(model(part["_text"].tolist()), dtype="float32")
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = np.divide(vectors, length, out=vectors.copy(), where=length > 0)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "vector": list(unit)})

    id_type = df.schema[id_col].dataType.simpleString()
    return prefixed.mapInPandas(run, f"{id_col} {id_type}, vector array<float>")


def normalized(df: DataFrame, col: str = "vector") -> DataFrame:
    """Unit-length vectors in place; a zero vector stays zero."""
    return df.withColumn(col, vx.unit(col))


def reweighted(df: DataFrame, weights: list[float], col: str = "vector") -> DataFrame:
    """A second dense space from the first: one factor per dimension, then unit length again."""
    return df.withColumn(col, vx.unit(vx.weighted(col, weights)))
