"""The registered queries: every operator and job over the driver's tables.

``documents`` stands for the reviews (rating ``1 + doc_id % 5``), ``embeddings`` for vectors made by a model outside,
``benchmark`` for a query list and the food dictionary, user turns of ``conversations`` for a second query list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dishlens.config import work_dir
from dishlens.functions import lexicon as lx
from dishlens.functions import text as tx
from dishlens.functions import vectors as vx
from dishlens.operators import answers, metrics
from dishlens.operators import pairs as pr
from dishlens.operators.cells import build_cells, search_cells
from dishlens.operators.encode import Space, encode, encode_with, feature_idf, normalized, reweighted
from dishlens.operators.loss import in_batch_loss
from dishlens.operators.lsh import WIDE_BANDS, approximate_top_k, recall
from dishlens.operators.ordinals import exact_sample
from dishlens.operators.query_match import match_counts
from dishlens.operators.tagging import tag_columns, tag_reviews, tag_whole_words
from dishlens.operators.terms import with_mentions
from dishlens.operators.topk import Hits, top_k
from dishlens.plans import evaluation as ev
from dishlens.plans import preprocess as pp
from dishlens.plans import retrieval as rt
from dishlens.plans.training import training_pairs
from dishlens.sources import catalog, readers, sinks

DIGITS, HALF_UP = 6, 1e-10
EMBEDDING_DIM = 64
TUNED_WEIGHTS = [1.0 + (i % 7) / 7.0 for i in range(EMBEDDING_DIM)]
SPACE = Space(rt.BASE, passage_prefix="passage: ", query_prefix="query: ")
NUM_PAIRS = 2000
SAMPLE_SIZE = 300
K = 5


def rounded(c: Column | str) -> Column:
    """To ``DIGITS``; scores are rounded to 9 digits before, so halves are common and are moved off the edge first."""
    return F.round(tx.as_column(c) + HALF_UP, DIGITS)


def joined(*cols: str) -> list[Column]:
    return [F.array_join(c, ", ").alias(c) for c in cols]


class Tables:
    """The driver's tables in the shapes of the jobs; processed tables and indexes are written once per session."""

    _made: dict[tuple[str, str, str], DataFrame] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _once(self, name: str, make: Callable[[], DataFrame], partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in self._made:
            self._made[key] = sinks.materialize(make(), name, partition_by, compression)
        return self._made[key]

    def reviews(self) -> DataFrame:
        docs = self.read("documents").select(
            F.col("doc_id").alias("review_id"),
            F.col("text").alias("review_text"),
            (1 + F.col("doc_id") % 5).cast("int").alias("star_rating"),
        )
        return readers.spread(docs, "review_id")

    def dictionary_lines(self) -> DataFrame:
        words = self.read("benchmark").select("item_id", F.posexplode(tx.words("text")).alias("pos", "line"))
        return words.select((F.col("item_id") * 1_000_000 + F.col("pos")).alias("rank"), "line")

    def dictionary(self) -> DataFrame:
        return readers.prepare_dictionary(readers.dictionary_lines(self.dictionary_lines()))

    def user_queries(self) -> DataFrame:
        turns = self.read("conversations").where(F.col("role") == "user")
        lines = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("line"))
        return readers.query_lines(lines)

    def benchmark_queries(self) -> DataFrame:
        lines = self.read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("line"))
        return readers.query_lines(lines)

    def all_queries(self) -> DataFrame:
        return pr.union_queries(self.user_queries(), self.benchmark_queries())

    def processed(self) -> DataFrame:
        """The processed reviews; the search text, which holds the review's whole text again, is put together where it is read."""
        written = self._once("processed", lambda: pp.process_reviews(self.reviews(), self.dictionary(), max_reviews=None).drop("search_text"), compression="zstd")
        return written.withColumn("search_text", tx.search_text("review_text", list(pp.SEARCH_FACETS))).select(pp.PROCESSED)

    # A dense space and a second one from it, with one query per label: the direction its vectors share.
    def vectors(self, space: str) -> DataFrame:
        e = self.read("embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("vector"))
        return normalized(e) if space == rt.BASE else reweighted(e, TUNED_WEIGHTS)

    def payload(self) -> sinks.Payload:
        """The reviews behind all indexes' rows, once for all spaces."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in self._payload:
            self._payload[key] = sinks.write_payload(rt.payload_rows(self.processed()), work_dir(self.spark, "payload"))
        return self._payload[key]

    _payload: dict[tuple[str, str], sinks.Payload] = {}

    def dense_index(self) -> DataFrame:
        def make() -> DataFrame:
            parts = [rt.build_dense_index(self.processed(), self.vectors(s), Space(s, "precomputed")) for s in (rt.BASE, rt.TUNED)]
            return parts[0].unionByName(parts[1])

        return self._once("dense-index", make, ["space"])

    def dense_queries(self, space: str) -> DataFrame:
        parts = self.vectors(space).select("label", F.posexplode("vector").alias("pos", "x"))
        means = parts.groupBy("label", "pos").agg(F.avg("x").alias("x"))
        v = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
        centre = means.groupBy("label").agg(v.alias("vector"))
        return normalized(centre).select(
            F.col("label").cast("bigint").alias("query_id"),
            F.concat(F.lit("topic "), F.col("label").cast("string")).alias("query"),
            self._category(F.col("label")),
            "vector",
        )

    @staticmethod
    def _category(number: Column) -> Column:
        names = F.lit([k for k, _ in catalog.CATEGORY_TITLES])
        return F.element_at(names, (number % len(catalog.CATEGORY_TITLES) + 1).cast("int")).alias("category")

    def evaluation(self) -> ev.Evaluation:
        encoded = {s: self.dense_queries(s) for s in (rt.BASE, rt.TUNED)}
        hits = ev.hits_of_spaces(self.dense_index(), encoded, K, self.payload())
        queries = encoded[rt.BASE].select("query_id", "category", "query")
        return ev.Evaluation(queries, hits)

    def demo(self) -> ev.Evaluation:
        """The evaluation queries, searched in both text spaces."""
        index, spaces = self.text_index()
        queries = catalog.evaluation_queries(self.spark)
        encoded = {name: rt.encode_queries(queries, space, space) for name, space in spaces.items()}
        return ev.Evaluation(queries, self._once("demo-hits", lambda: ev.hits_of_spaces(index, encoded, K, self.payload())))

    def base_hits(self, k: int = K) -> DataFrame:
        index = rt.in_space(self.dense_index(), rt.BASE)
        return rt.search(index, self.dense_queries(rt.BASE), k).with_payload(self.payload())

    # A hashed space over the search texts, and one fitted to them.
    def text_index(self) -> tuple[DataFrame, dict[str, Space]]:
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in self._text:
            self._text[key] = rt.build_two_spaces(self.processed(), SPACE, work_dir(self.spark, "text-index"))
        return self._text[key]

    _text: dict[tuple[str, str], tuple[DataFrame, dict[str, Space]]] = {}

    def text_hits(self, k: int = K, space: str = rt.BASE) -> tuple[DataFrame, Hits, sinks.Payload]:
        """Queries, their hits in one space, and what the rows hold."""
        index, spaces = self.text_index()
        index = rt.in_space(index, space)
        queries = self.benchmark_queries()
        return queries, rt.search(index, rt.encode_queries(queries, spaces[space], spaces[space]), k), self.payload()


# --- sources, constants -------------------------------------------------------------------------------------------


def dictionary_prepare(t: Tables) -> DataFrame:
    return t.dictionary()


def normalize_queries(t: Tables) -> DataFrame:
    return rt.asked(t.user_queries())


def processed_roundtrip(t: Tables) -> DataFrame:
    back = sinks.materialize(t.processed(), "roundtrip")
    return back.select("review_id", "star_rating", F.length("search_text").alias("n_chars"), *joined("food_type", "mentioned_foods"))


def index_roundtrip(t: Tables) -> DataFrame:
    index, spaces = t.text_index()
    path = work_dir(t.spark, "index")
    sinks.write_index(index, list(spaces.values()), path)
    back, found = readers.read_index(t.spark, path)
    size = F.size("features").cast("bigint")
    stats = back.groupBy("space").agg(F.count(F.lit(1)).alias("n_vectors"), F.sum(size).alias("n_features"), rounded(F.sum(vx.dot("weights", "weights"))).alias("sum_sq"))
    prefixes = t.spark.createDataFrame([(s.name, s.query_prefix) for s in found.values()], "space string, query_prefix string")
    return stats.join(F.broadcast(prefixes), "space")


def csv_scan(t: Tables) -> DataFrame:
    """Reviews written as separated text, quoted line breaks and all, and read again with ids from their places in the files."""
    path = work_dir(t.spark, "reviews-csv")
    ordered = t.reviews().select("review_text", "star_rating", "review_id").repartitionByRange("review_id").sortWithinPartitions("review_id")
    sinks.write_csv(ordered.drop("review_id"), path, header=False)
    return readers.read_reviews_csv(t.spark, path).select("review_id", "star_rating", "review_text")


def text_scan(t: Tables) -> DataFrame:
    """Lines written as text and read again as a dictionary, ranked by their places in the files."""
    path = work_dir(t.spark, "dictionary-text")
    lines = t.read("benchmark").select("item_id", F.posexplode(F.split("text", r"[\r\n]")).alias("pos", "value"))
    lines.repartitionByRange("item_id", "pos").sortWithinPartitions("item_id", "pos").select("value").write.text(path)
    return readers.read_dictionary(t.spark, path)


def csv_export(t: Tables) -> DataFrame:
    """Processed reviews exported with a header, lists joined, and read back."""
    path = work_dir(t.spark, "export")
    sinks.write_csv(t.processed().select("review_id", "star_rating", "food_type", "location"), path)
    back = t.spark.read.schema("review_id bigint, star_rating int, food_type string, location string").option("header", True)
    return back.option("sep", ";").option("quote", '"').option("escape", '"').csv(path).fillna("", ["food_type", "location"])


def _length_model() -> Callable[[list[str]], np.ndarray]:
    """Stands for a model: a text's length modulo 8 says which of 8 numbers it gets."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 8))
        out[np.arange(len(texts)), [len(x) % 8 for x in texts]] = [float(len(x)) for x in texts]
        return out

    return run


def model_index(t: Tables) -> DataFrame:
    """Vectors from a function of the caller, loaded once a task and given batches of texts."""
    made = encode_with(t.processed(), "review_id", "search_text", _length_model, SPACE, "passage")
    return made.select("review_id", F.posexplode("vector").alias("pos", "x")).where("x <> 0").select("review_id", "pos", rounded(F.col("x").cast("double")).alias("x"))


def query_catalog(t: Tables) -> DataFrame:
    queries = catalog.evaluation_queries(t.spark)
    counts = match_counts(t.reviews(), queries)
    return queries.join(counts, "query_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def _tagged(t: Tables, column: str) -> DataFrame:
    return tag_reviews(pp.clean_reviews(t.reviews()), lx.shipped_entries(), {column: lx.REVIEW_FACETS[column]})


def lexicon_stats(t: Tables) -> DataFrame:
    """Keywords of every category and the reviews it tags."""
    facets = [f for f, _ in lx.FACET_TABLES]
    tagged = tag_reviews(pp.clean_reviews(t.reviews()), lx.shipped_entries(), {f: (f,) for f in facets})
    counts = tagged.select(F.explode(metrics.facet_values(facets)).alias("t")).groupBy("t.facet", F.col("t.value").alias("category")).agg(F.count(F.lit(1)).alias("n_reviews"))
    table = lx.shipped_table(t.spark).groupBy("facet", "category").agg(F.count(F.lit(1)).alias("n_keywords"))
    return table.join(counts, ["facet", "category"], "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))


def filter_label_map(t: Tables) -> DataFrame:
    """The category behind every filter label and the reviews the filter would leave."""
    groups = metrics.facet_groups(t.processed()).select("facet", F.col("value").alias("category"), "n")
    return catalog.filter_labels(t.spark).join(groups, ["facet", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- text ---------------------------------------------------------------------------------------------------------


def clean_reviews(t: Tables) -> DataFrame:
    return pp.clean_reviews(t.reviews()).select("review_id", "star_rating", "review_text")


def search_text(t: Tables) -> DataFrame:
    tagged = tag_reviews(pp.clean_reviews(t.reviews()), lx.shipped_entries())
    opening = tx.search_text("review_text", list(pp.SEARCH_FACETS), tx.SEARCH_TEXT_CHARS)
    return tagged.select("review_id", opening.alias("search_text"))


def search_text_prefixed(t: Tables) -> DataFrame:
    text = tx.with_prefix(F.col("search_text"), SPACE.prefix("passage"))
    return t.processed().select("review_id", text.alias("passage"))


def excerpts(t: Tables) -> DataFrame:
    return pp.clean_reviews(t.reviews()).select(
        "review_id",
        tx.excerpt("review_text", tx.ANSWER_EXCERPT_CHARS).alias("answer_excerpt"),
        tx.excerpt("review_text", tx.CARD_EXCERPT_CHARS, stripped=False).alias("card_excerpt"),
        tx.excerpt("review_text", tx.PROMPT_EXCERPT_CHARS, stripped=False, ellipsis=False).alias("prompt_excerpt"),
    )


def star_display(t: Tables) -> DataFrame:
    return t.reviews().select("review_id", tx.stars("star_rating").alias("stars"), tx.star_slots("star_rating").alias("slots"))


def query_terms(t: Tables) -> DataFrame:
    return rt.asked(t.user_queries()).select("query_id", F.array_join(tx.query_terms("query"), " ").alias("terms"))


# --- tags ---------------------------------------------------------------------------------------------------------


def _tag_query(column: str) -> Callable[[Tables], DataFrame]:
    return lambda t: _tagged(t, column).select("review_id", *joined(column))


def tag_price(t: Tables) -> DataFrame:
    tagged = tag_columns(pp.clean_reviews(t.reviews()), lx.shipped_entries(), {"price_level": ("price_level",)})
    return tagged.select("review_id", *joined("price_level"))


def tag_wordmatch(t: Tables) -> DataFrame:
    return tag_whole_words(pp.clean_reviews(t.reviews()), lx.shipped_entries()).select("review_id", *joined(*lx.REVIEW_FACETS))


def _word_flags(facet: str) -> Column:
    def flag(category: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), category.alias("category"), F.array_contains(facet, category).alias("word"))

    return F.transform(f"sub_{facet}", flag)


def tag_false_hits(t: Tables) -> DataFrame:
    """Per category: reviews hit as substring, as whole words, and only as substring."""
    facets = list(lx.REVIEW_FACETS)
    both = tag_reviews(pp.clean_reviews(t.reviews()), lx.shipped_entries())
    both = both.withColumnsRenamed({f: f"sub_{f}" for f in facets})
    both = tag_whole_words(both, lx.shipped_entries())
    hits = F.flatten(F.array(*[_word_flags(f) for f in facets]))
    rows = both.select(F.explode(hits).alias("h")).select("h.*")
    return rows.groupBy("facet", "category").agg(
        F.count(F.lit(1)).alias("n_substring"), F.count_if("word").alias("n_word"), F.count_if(~F.col("word")).alias("n_false")
    )


def mentioned_terms(t: Tables) -> DataFrame:
    return with_mentions(pp.clean_reviews(t.reviews()), t.dictionary()).select("review_id", *joined("mentioned_foods"))


def processed_reviews(t: Tables) -> DataFrame:
    done = pp.process_reviews(t.reviews(), t.dictionary(), max_reviews=None)
    return done.select("review_id", "star_rating", "search_text", *joined(*pp.SEARCH_FACETS, "mentioned_foods"))


# --- counts -------------------------------------------------------------------------------------------------------


def rating_distribution(t: Tables) -> DataFrame:
    return metrics.rating_distribution(pp.clean_reviews(t.reviews())).withColumn("share_pct", rounded("share_pct"))


def facet_groups(t: Tables) -> DataFrame:
    return metrics.facet_groups(t.processed(), min_members=2)


def query_union(t: Tables) -> DataFrame:
    return t.all_queries()


def distinct_queries(t: Tables) -> DataFrame:
    return t.user_queries().select("query").union(t.benchmark_queries().select("query")).agg(
        F.count(F.lit(1)).alias("n_queries"), F.countDistinct("query").alias("n_distinct")
    )


def pipeline_counts(t: Tables) -> DataFrame:
    return pp.pipeline_counts(t.reviews(), SAMPLE_SIZE)


def sampled_reviews(t: Tables) -> DataFrame:
    return exact_sample(pp.clean_reviews(t.reviews()), SAMPLE_SIZE, "review_id").select("review_id", "star_rating")


# --- vectors and indexes ------------------------------------------------------------------------------------------


def l2_normalize(t: Tables) -> DataFrame:
    weighted = F.aggregate(
        F.zip_with("vector", F.lit([float(i) for i in range(EMBEDDING_DIM)]), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x
    )
    return t.vectors(rt.TUNED).select("row_id", rounded(vx.norm("vector")).alias("norm"), rounded(weighted).alias("weighted_sum"))


def index_stats(t: Tables) -> DataFrame:
    return rt.index_stats(t.dense_index()).select("space", "n_vectors", F.col("max_size").cast("bigint").alias("dim"))


def _features(index: DataFrame) -> DataFrame:
    cells = F.arrays_zip("features", "weights")
    return index.select("row_id", F.explode(cells).alias("c")).select(
        "row_id", F.col("c.features").cast("bigint").alias("feature"), rounded("c.weights").alias("weight")
    )


def hashed_index(t: Tables) -> DataFrame:
    return _features(rt.build_index(t.processed(), SPACE))


def idf_index(t: Tables) -> DataFrame:
    index, _ = t.text_index()
    return _features(rt.in_space(index, rt.TUNED))


def feature_frequencies(t: Tables) -> DataFrame:
    encoded = encode(t.processed(), "search_text", SPACE, "passage")
    out = feature_idf(encoded, SPACE.dim)
    return out.select(F.col("feature").cast("bigint").alias("feature"), "df", rounded("idf").alias("idf"))


# --- search -------------------------------------------------------------------------------------------------------


def _scored(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", "rank", "row_id", rounded("score").alias("score"), *more)


def dense_topk(t: Tables) -> DataFrame:
    return _scored(top_k(rt.in_space(t.dense_index(), rt.BASE), t.dense_queries(rt.BASE), K).rows)


def sparse_topk(t: Tables) -> DataFrame:
    _, hits, _ = t.text_hits()
    return _scored(hits.rows)


def tuned_topk(t: Tables) -> DataFrame:
    _, hits, _ = t.text_hits(space=rt.TUNED)
    return _scored(hits.rows)


def search_hits(t: Tables) -> DataFrame:
    return t.base_hits().select(
        "query_id", "rank", "row_id", rounded("score").alias("score"), "star_rating", "review_text", *joined("food_type", "location")
    )


def _filter_queries(t: Tables) -> DataFrame:
    q = t.dense_queries(rt.BASE)
    n = F.col("query_id")
    return q.select(
        "query_id",
        "vector",
        (n % 4).cast("int").alias("min_rating"),
        F.when(n % 3 == 0, F.lit("TEA")).otherwise(F.lit("")).alias("food_type"),
        F.when(n % 2 == 0, F.lit("nan")).alias("location"),
        F.when(n % 5 == 4, F.lit("worth")).alias("price_level"),
    )


def filtered_topk_pre(t: Tables) -> DataFrame:
    return _scored(rt.search_filtered(rt.in_space(t.dense_index(), rt.BASE), _filter_queries(t), K, "pre", payload=t.payload()))


def filtered_topk_post(t: Tables) -> DataFrame:
    return _scored(rt.search_filtered(rt.in_space(t.dense_index(), rt.BASE), _filter_queries(t), K, "post", payload=t.payload()))


def rerank_topk(t: Tables) -> DataFrame:
    queries, hits, payload = t.text_hits(k=K * rt.OVERFETCH)
    out = rt.rerank(queries, hits.with_payload(payload), K)
    return out.select("query_id", "rank", "row_id", "first_rank", rounded("coverage").alias("coverage"), rounded("score").alias("score"))


def _every_twentieth(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The dense index, and its rows whose id is divisible by 20 as queries."""
    index = rt.in_space(t.dense_index(), rt.BASE).select("row_id", "vector")
    return index, index.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vector")


def lsh_recall(t: Tables) -> DataFrame:
    """With as many bands as a recall of 0.9 takes."""
    index, queries = _every_twentieth(t)
    return _round_all(recall(top_k(index, queries, K).rows, approximate_top_k(index, queries, K, bands=WIDE_BANDS)))


def cell_topk(t: Tables) -> DataFrame:
    index, queries = _every_twentieth(t)
    best, _ = search_cells(build_cells(index, work_dir(t.spark, "cells")), queries, K)
    return _scored(best)


def cell_recall(t: Tables) -> DataFrame:
    """Hits of the cell index against those of a search over all rows, and the share of rows it scored."""
    index, queries = _every_twentieth(t)
    cells = build_cells(index, work_dir(t.spark, "cells"))
    best, effort = search_cells(cells, queries, K)
    found = recall(top_k(index, queries, K).rows, best.join(effort.withColumnRenamed("n_scored", "n_candidates"), "query_id"))
    share = F.col("n_scored") / F.lit(max(1, int(cells.cells.rows.sum())))
    return _round_all(found.withColumnRenamed("n_candidates", "n_scored").withColumn("share_scored", share))


def space_fallback(t: Tables) -> DataFrame:
    """Queries ask for the tuned space or for one that was never built; hits come from the space they end up with."""
    wanted = F.when(F.col("query_id") % 2 == 0, F.lit(rt.TUNED)).otherwise(F.lit("unbuilt"))
    requests = t.evaluation().queries.select("query_id", wanted.alias("space"))
    resolved = rt.resolve_spaces(requests, (rt.BASE, rt.TUNED))
    hits = t.evaluation().hits.select("query_id", F.col("space").alias("used_space"), "rank", "row_id", "score")
    return resolved.join(hits, ["query_id", "used_space"]).select(
        "query_id", "space", "used_space", "rank", "row_id", rounded("score").alias("score")
    )


# --- answers ------------------------------------------------------------------------------------------------------


def answer_template(t: Tables) -> DataFrame:
    queries, hits, payload = t.text_hits()
    return answers.template_answers(queries, hits.with_payload(payload))


def answer_prompt(t: Tables) -> DataFrame:
    queries, hits, payload = t.text_hits()
    made = answers.answer_prompts(queries, hits.with_payload(payload))
    return made.select("query_id", F.posexplode("messages").alias("pos", "m")).select("query_id", "pos", "m.role", "m.content")


def answer_router(t: Tables) -> DataFrame:
    queries, hits, payload = t.text_hits()
    asked = queries.withColumn("use_model", F.col("query_id") % 2 == 0)
    routed = answers.routed_answers(asked, hits.with_payload(payload))
    return routed.select("query_id", "answer", F.element_at("messages", 2)["content"].alias("user_message"))


def display_rows(t: Tables) -> DataFrame:
    _, hits, payload = t.text_hits()
    rows = answers.display_rows(hits.with_payload(payload))
    return rows.select(
        "query_id", "rank", "row_id", "star_rating", "star_display", "star_slots", rounded("score").alias("score"),
        *joined("cuisine_type_shown", "food_type_shown", "location_shown"), "review_shown",
    )


def display_nested(t: Tables) -> DataFrame:
    queries, hits, payload = t.text_hits()
    found = hits.with_payload(payload)
    nested = answers.nested_results(answers.template_answers(queries, found), found)
    return nested.select("query_id", "num_results", F.explode("results").alias("r")).select(
        "query_id", "num_results", "r.rank", "r.star_rating", "r.star_display", rounded("r.relevance_score").alias("relevance_score"),
        F.array_join("r.mentioned_foods", ", ").alias("mentioned_foods"),
    )


def demo_answers(t: Tables) -> DataFrame:
    queries, hits, payload = t.text_hits(k=3)
    made = answers.template_answers(queries, hits.with_payload(payload))
    return made.select("query_id", answers.answer_preview("answer").alias("preview"))


def quick_demo(t: Tables) -> DataFrame:
    """The four quick queries, three rows each, and the openings of their answers."""
    index, spaces = t.text_index()
    queries, space = catalog.quick_queries(t.spark), spaces[rt.BASE]
    hits = rt.search(rt.in_space(index, rt.BASE), rt.encode_queries(queries, space, space), 3)
    made = answers.template_answers(queries, hits.with_payload(t.payload()))
    return made.select("query_id", answers.answer_preview("answer").alias("preview"))


def requests(t: Tables) -> DataFrame:
    n = F.col("query_id")
    return t.benchmark_queries().select(
        "query_id",
        "query",
        (3 + n % 3).cast("int").alias("k"),
        F.element_at(F.lit(["base", "finetuned", "compare"]), (n % 3 + 1).cast("int")).alias("mode"),
        (n % 4).cast("int").alias("min_rating"),
        F.when(n % 7 == 3, F.lit("ไทย")).otherwise(F.lit("")).alias("cuisine_type"),
        F.when(n % 2 == 0, F.lit("tea")).otherwise(F.lit("")).alias("food_type"),
    )


def _answered(t: Tables, filter_mode: str) -> DataFrame:
    index, spaces = t.text_index()
    texts, _ = rt.search_and_answer(index, spaces, requests(t), filter_mode, t.payload())
    return texts.select("query_id", "side", "mode", "num_results", "answer")


def search_and_answer(t: Tables) -> DataFrame:
    return _answered(t, "post")


def search_and_answer_pre(t: Tables) -> DataFrame:
    return _answered(t, "pre")


# --- evaluation ---------------------------------------------------------------------------------------------------


def _round_all(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def retrieval_metrics(t: Tables) -> DataFrame:
    e = t.evaluation()
    return _round_all(metrics.per_query(e.queries, t.base_hits())).drop("query")


def retrieval_overall(t: Tables) -> DataFrame:
    return _round_all(metrics.over_hits(t.evaluation().queries, t.base_hits()))


def compare_spaces(t: Tables) -> DataFrame:
    return _round_all(t.evaluation().comparison()).drop("query")


def category_summary(t: Tables) -> DataFrame:
    return _round_all(t.evaluation().by_category())


def comparison_overall(t: Tables) -> DataFrame:
    return _round_all(t.evaluation().overall())


def evaluation_report(t: Tables) -> DataFrame:
    return _round_all(t.evaluation().report())


def _detail(e: ev.Evaluation) -> DataFrame:
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ", ") for c in ("baseline_hits", "finetuned_hits")}
    return _round_all(e.detail().withColumns(lists))


def evaluation_detail(t: Tables) -> DataFrame:
    e = t.evaluation()
    return _detail(ev.Evaluation(e.queries, sinks.materialize(e.hits, "hits")))


def demo_evaluation(t: Tables) -> DataFrame:
    return _round_all(t.demo().report())


def demo_detail(t: Tables) -> DataFrame:
    return _detail(t.demo())


def ir_metrics(t: Tables) -> DataFrame:
    index = rt.in_space(t.dense_index(), rt.BASE)
    queries = t.dense_queries(rt.BASE)
    relevant = index.select(F.col("label").cast("bigint").alias("query_id"), "row_id")
    return _round_all(metrics.ir_metrics(queries, top_k(index, queries, K).rows, relevant, K))


# --- training pairs -----------------------------------------------------------------------------------------------


def query_review_matches(t: Tables) -> DataFrame:
    """How many reviews contain a term of each query."""
    queries = rt.asked(t.user_queries())
    counts = match_counts(t.processed(), queries)
    return queries.select("query_id").join(counts, "query_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


PAIR_VIEW = ["j", "left_id", "right_id", "text_a", "text_b"]


def pairs_query(t: Tables) -> DataFrame:
    return pr.query_pairs(t.processed(), t.all_queries(), NUM_PAIRS).select(PAIR_VIEW)


def pairs_similar(t: Tables) -> DataFrame:
    return pr.similar_pairs(t.processed(), NUM_PAIRS).select(PAIR_VIEW)


def pairs_rating(t: Tables) -> DataFrame:
    return pr.rating_pairs(t.processed(), NUM_PAIRS).select(PAIR_VIEW)


def pairs_fill(t: Tables) -> DataFrame:
    """What the rating strategy alone leaves open of ``NUM_PAIRS``."""
    mined = pr.rating_pairs(t.processed(), NUM_PAIRS)
    return pr.fill_pairs(t.processed(), mined, NUM_PAIRS).select(PAIR_VIEW)


def _pairs(t: Tables) -> DataFrame:
    return training_pairs(t.processed(), t.all_queries(), NUM_PAIRS)


def pairs_all(t: Tables) -> DataFrame:
    return _pairs(t).select("pair_id", "strategy", "left_id", "right_id", "text_a", "text_b")


def training_batches(t: Tables) -> DataFrame:
    return pr.batch_plan(_pairs(t))


def batch_loss(t: Tables) -> DataFrame:
    return _round_all(in_batch_loss(_pairs(t), SPACE))


REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {
    "dictionary_prepare": dictionary_prepare,
    "normalize_queries": normalize_queries,
    "processed_roundtrip": processed_roundtrip,
    "index_roundtrip": index_roundtrip,
    "csv_scan": csv_scan,
    "text_scan": text_scan,
    "csv_export": csv_export,
    "model_index": model_index,
    "query_catalog": query_catalog,
    "lexicon_stats": lexicon_stats,
    "filter_label_map": filter_label_map,
    "clean_reviews": clean_reviews,
    "search_text": search_text,
    "search_text_prefixed": search_text_prefixed,
    "excerpts": excerpts,
    "star_display": star_display,
    "query_terms": query_terms,
    "tag_cuisine": _tag_query("cuisine_type"),
    "tag_food_type": _tag_query("food_type"),
    "tag_atmosphere": _tag_query("atmosphere"),
    "tag_price": tag_price,
    "tag_location": _tag_query("location"),
    "tag_wordmatch": tag_wordmatch,
    "tag_false_hits": tag_false_hits,
    "mentioned_terms": mentioned_terms,
    "processed_reviews": processed_reviews,
    "rating_distribution": rating_distribution,
    "facet_groups": facet_groups,
    "query_union": query_union,
    "distinct_queries": distinct_queries,
    "pipeline_counts": pipeline_counts,
    "exact_sample": sampled_reviews,
    "l2_normalize": l2_normalize,
    "index_stats": index_stats,
    "hashed_index": hashed_index,
    "idf_index": idf_index,
    "feature_frequencies": feature_frequencies,
    "dense_topk": dense_topk,
    "sparse_topk": sparse_topk,
    "tuned_topk": tuned_topk,
    "search_hits": search_hits,
    "filtered_topk_pre": filtered_topk_pre,
    "filtered_topk_post": filtered_topk_post,
    "rerank_topk": rerank_topk,
    "lsh_recall": lsh_recall,
    "cell_topk": cell_topk,
    "cell_recall": cell_recall,
    "space_fallback": space_fallback,
    "answer_template": answer_template,
    "answer_prompt": answer_prompt,
    "answer_router": answer_router,
    "display_rows": display_rows,
    "display_nested": display_nested,
    "demo_answers": demo_answers,
    "quick_demo": quick_demo,
    "search_and_answer": search_and_answer,
    "search_and_answer_pre": search_and_answer_pre,
    "retrieval_metrics": retrieval_metrics,
    "retrieval_overall": retrieval_overall,
    "compare_spaces": compare_spaces,
    "category_summary": category_summary,
    "comparison_overall": comparison_overall,
    "evaluation_report": evaluation_report,
    "evaluation_detail": evaluation_detail,
    "demo_evaluation": demo_evaluation,
    "demo_detail": demo_detail,
    "ir_metrics": ir_metrics,
    "query_review_matches": query_review_matches,
    "pairs_query": pairs_query,
    "pairs_similar": pairs_similar,
    "pairs_rating": pairs_rating,
    "pairs_fill": pairs_fill,
    "pairs_all": pairs_all,
    "training_batches": training_batches,
    "in_batch_loss": batch_loss,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY[name](Tables(spark, sf_dir))
