"""Ranking loss of a set of pairs under an encoder: how well each left text picks its own right text in its batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.operators.encode import Space, encode
from dishlens.operators.pairs import batches

# Fixed value: the factor on the cosines.
SCALE = 20.0
BATCHES_PER_GROUP = 64


def in_batch_loss(pairs: DataFrame, space: Space, batch_size: int = 16, scale: float = SCALE) -> DataFrame:
    """``batch, n_pairs, loss``: mean cross-entropy of scaled cosines, the other pairs of the batch as negatives.

    Batches are worked on ``BATCHES_PER_GROUP`` at a time, so a group has at most that many times ``batch_size`` rows.
    """
    left = encode(batches(pairs, batch_size), "text_a", space, "query")
    left = left.withColumnsRenamed({"features": "fa", "weights": "wa"})
    both = encode(left, "text_b", space, "passage").withColumnsRenamed({"features": "fb", "weights": "wb"})
    rows = both.select("batch", "pair_id", "fa", "wa", "fb", "wb", F.floor(F.col("batch") / BATCHES_PER_GROUP).alias("grp"))

    def dense(features: pd.Series, weights: pd.Series) -> np.ndarray:
        out = np.zeros((len(features), space.dim))
        owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
        if len(owner):
            out[owner, np.concatenate(features.to_list())] = np.concatenate(weights.to_list())
        return out

    def losses(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for batch, part in group.groupby("batch"):
            part = part.sort_values("pair_id")
            logits = scale * dense(part["fa"], part["wa"]) @ dense(part["fb"], part["wb"]).T
            top = logits.max(axis=1)
            log_sum = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
            out.append((batch, len(part), float((log_sum - np.diag(logits)).mean())))
        return pd.DataFrame(out, columns=["batch", "n_pairs", "loss"])

    return rows.groupBy("grp").applyInPandas(losses, "batch bigint, n_pairs bigint, loss double")
