"""Index building and search for whole tables of queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dishlens.functions import text as tx
from dishlens.operators import answers
from dishlens.operators.encode import Space, check_same_space, encode, fit_idf, refitted
from dishlens.operators.filters import Filters, apply_filters, passes_query_filters
from dishlens.operators.topk import QUERY_FILTERS, Hits, top_k
from dishlens.sources import catalog
from dishlens.sources.sinks import Payload

OVERFETCH = 3
BASE, TUNED = "base", "tuned"
#: What a row must have beside its vector for a search: what queries filter by.
SEARCHED = ["row_id", "star_rating", *QUERY_FILTERS[1:]]


SPACE_KEY = "space_key"


def check_index_space(index: DataFrame, space: Space) -> None:
    """Refuse an index whose vectors were made in another space than the queries will be."""
    row = index.select(SPACE_KEY).limit(1).collect() if SPACE_KEY in index.columns else []
    if row and row[0][0] != space.key():
        raise ValueError(f"the index was not made in space {space.name!r} as it is given here")


def build_index(processed: DataFrame, space: Space) -> DataFrame:
    """Vectors and payload in one table, keyed by ``row_id``."""
    renamed = processed.withColumnRenamed("review_id", "row_id")
    encoded = encode(renamed, "search_text", space, "passage")
    return encoded.withColumns({SPACE_KEY: F.lit(space.key()), "space": F.lit(space.name)})


def payload_rows(processed: DataFrame) -> DataFrame:
    """Processed reviews as what hits are given: keyed by ``row_id``, without what only the encoder reads."""
    return processed.withColumnRenamed("review_id", "row_id").drop("search_text")


def build_dense_index(processed: DataFrame, vectors: DataFrame, space: Space) -> DataFrame:
    """The same from vectors computed elsewhere: ``row_id, vector`` and whatever else should stay with them.

    The rows hold what queries filter by; the payload is a table of its own, as spaces share it.
    """
    renamed = processed.withColumnRenamed("review_id", "row_id")
    kept = [c for c in SEARCHED if c in renamed.columns]
    return renamed.select(kept).join(vectors, "row_id").withColumns({SPACE_KEY: F.lit(space.key()), "space": F.lit(space.name)})


def build_two_spaces(processed: DataFrame, space: Space, path: str, tuned_name: str = TUNED) -> tuple[DataFrame, dict[str, Space]]:
    """A plain index and one in a space fitted to the corpus, written as one table of vectors and what queries filter by.

    The texts are read once: fitting and the second space start from the vectors written for the first. The payload is not
    in it; ``write_payload(payload_rows(processed), ...)`` writes it once for all spaces.
    """
    spark = processed.sparkSession
    index = build_index(processed, space)
    index = index.select(*[c for c in SEARCHED if c in index.columns], "features", "weights", SPACE_KEY, "space")
    index.write.partitionBy("space").option("compression", "zstd").parquet(path)
    base = spark.read.parquet(path).where(F.col("space") == space.name)
    fitted = fit_idf(base, space, tuned_name)
    tuned = refitted(base, fitted).withColumns({SPACE_KEY: F.lit(fitted.key()), "space": F.lit(tuned_name)})
    tuned.write.mode("append").partitionBy("space").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), {space.name: space, tuned_name: fitted}


def index_stats(index: DataFrame) -> DataFrame:
    size = F.size("vector") if "vector" in index.columns else F.size("features")
    return index.groupBy("space").agg(F.count(F.lit(1)).alias("n_vectors"), F.max(size).alias("max_size"))


def in_space(index: DataFrame, name: str) -> DataFrame:
    return index.where(F.col("space") == name)


def asked(queries: DataFrame) -> DataFrame:
    """Queries with something in them."""
    return queries.where(tx.strip("query") != "")


def encode_queries(queries: DataFrame, space: Space, index_space: Space) -> DataFrame:
    check_same_space(index_space, space)
    return encode(asked(queries), "query", space, "query")


def search(index: DataFrame, encoded: DataFrame, k: int = 5) -> Hits:
    """The ``k`` nearest rows of one space for each encoded query."""
    return top_k(index, encoded, k)


def search_filtered(
    index: DataFrame, encoded: DataFrame, k: int = 5, mode: str = "pre", filters: Filters | None = None, payload: DataFrame | Payload | None = None
) -> DataFrame:
    """Hits with payload under metadata filters: one set for all queries, or filter columns (and ``k``) per query.

    ``pre`` searches only rows that pass. ``post`` takes the ``3 k`` nearest of all rows and keeps those that pass, so
    it may return fewer than exist. ``payload`` is the index itself unless given.
    """
    payload = index if payload is None else payload
    if mode not in ("pre", "post"):
        raise ValueError(f"mode must be pre or post, not {mode!r}")
    per_query = [c for c in QUERY_FILTERS if c in encoded.columns]
    own = F.coalesce(F.col("k").cast("int"), F.lit(k)) if "k" in encoded.columns else F.lit(k)
    encoded = encoded.withColumn("k", own)
    if mode == "pre":
        return top_k(apply_filters(index, filters), encoded, k, filtered=bool(per_query)).with_payload(payload)
    wide = top_k(index, encoded.withColumn("k", F.col("k") * OVERFETCH), k)
    asked_for = encoded.select("query_id", F.col("k").alias("_k"), *[F.col(c).alias(f"_want_{c}") for c in per_query])
    found = wide.with_payload(payload).join(asked_for, "query_id")
    passed = apply_filters(found.where(passes_query_filters(per_query, "_want_")), filters)
    again = Window.partitionBy("query_id").orderBy("rank")
    reranked = passed.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= F.col("_k"))
    return reranked.drop("_k", *[f"_want_{c}" for c in per_query])


def rerank(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Second stage over over-fetched hits: the share of the query's terms a review contains, then the first score."""
    terms = queries.select("query_id", tx.query_terms("query").alias("_terms"))
    joined = hits.join(terms, "query_id").withColumn("_lowered", F.lower("review_text"))
    covered = F.size(F.filter("_terms", lambda t: F.contains(F.col("_lowered"), t)))
    scored = joined.withColumn("coverage", F.when(F.size("_terms") > 0, covered / F.size("_terms")).otherwise(F.lit(0.0)))
    best = Window.partitionBy("query_id").orderBy(F.col("coverage").desc(), F.col("score").desc(), "row_id")
    out = scored.withColumnRenamed("rank", "first_rank").withColumn("rank", F.row_number().over(best))
    return out.where(F.col("rank") <= k).drop("_terms", "_lowered")


def resolve_spaces(requests: DataFrame, spaces: Iterable[str]) -> DataFrame:
    """Add ``used_space``: the requested ``space`` if it is one of ``spaces``, else the base space."""
    known = F.col("space").isin(list(spaces))
    return requests.withColumn("used_space", F.when(F.coalesce(known, F.lit(False)), F.col("space")).otherwise(F.lit(BASE)))


def search_and_answer(
    index: DataFrame,
    spaces: dict[str, Space],
    queries: DataFrame,
    filter_mode: str = "pre",
    payload: DataFrame | Payload | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers and hits for a table of requests ``query_id, query, k, mode`` with optional filter columns.

    Every request gets its own ``k``, and a search keeps no more rows for it than that (or three times that, for ``post``).

    ``mode`` is ``base``, ``finetuned`` or ``compare`` (both). Without a tuned space the base answers for it, and the
    tuned side of a comparison says so. Filter values may be labels or category keys. ``payload`` holds the texts of the rows,
    if the index does not.
    """
    requests = catalog.resolve_filter_labels(asked(queries))
    sides = F.when(F.col("mode") == "compare", F.array(F.lit(BASE), F.lit(TUNED))).otherwise(
        F.array(F.when(F.col("mode") == "finetuned", F.lit(TUNED)).otherwise(F.lit(BASE)))
    )
    wanted = requests.withColumn("side", F.explode(sides))
    have_tuned = TUNED in spaces
    found = []
    for side in (BASE, TUNED):
        space = spaces[TUNED if side == TUNED and have_tuned else BASE]
        check_index_space(in_space(index, space.name), space)
        encoded = encode(wanted.where(F.col("side") == side), "query", space, "query")
        rows = search_filtered(in_space(index, space.name), encoded, mode=filter_mode, payload=payload)
        found.append(rows.withColumn("side", F.lit(side)))
    hits = found[0].unionByName(found[1])
    texts = answers.template_answers(wanted, hits, by=["side"]).join(requests.select("query_id", "mode"), "query_id")
    if not have_tuned:
        missing = (F.col("mode") == "compare") & (F.col("side") == TUNED)
        texts = texts.withColumn("answer", F.when(missing, F.lit(answers.TUNED_MISSING)).otherwise(F.col("answer")))
    return texts, hits
