"""Assembly of the training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dishlens.operators import pairs as pr
from dishlens.sources.sinks import materialize


def training_pairs(reviews: DataFrame, queries: DataFrame, num_pairs: int = 10_000, seed: int = 42) -> DataFrame:
    """``pair_id, strategy, left_id, right_id, text_a, text_b`` in shuffled order; ``num_pairs`` of them.

    The quotas add up to at most ``num_pairs`` and the fill stops there, so nothing is cut off at the end. The mined
    pairs are written once because the fill counts them, and so is the fill, because the shuffle counts both.
    """
    mined = pr.query_pairs(reviews, queries, num_pairs, seed)
    mined = mined.unionByName(pr.similar_pairs(reviews, num_pairs, seed)).unionByName(pr.rating_pairs(reviews, num_pairs, seed))
    mined = materialize(mined, "mined-pairs")
    filled = mined.unionByName(materialize(pr.fill_pairs(reviews, mined, num_pairs, seed), "fill-pairs"))
    return pr.shuffled(filled, seed).select("pair_id", *pr.PAIR_COLUMNS)
