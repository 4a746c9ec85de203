"""The steps of a deployment, each from the tables that the one before it has written, under the paths and sizes of ``Settings``.

Preprocess (``preprocess.run_preprocessing``), index, training set, evaluation, answers. A step leaves its results only; what
it writes in between is removed when it ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishlens.config import Settings, scratch
from dishlens.operators import answers, pairs
from dishlens.operators.encode import Space, e5_prefixes
from dishlens.plans import evaluation
from dishlens.plans import retrieval as rt
from dishlens.plans.training import training_pairs
from dishlens.sources import catalog, readers, sinks


def processed_reviews(spark: SparkSession, settings: Settings) -> DataFrame:
    return readers.read_table(spark, settings.processed_path, "run_preprocessing")


def run_indexing(spark: SparkSession, settings: Settings) -> tuple[DataFrame, dict[str, Space], sinks.Payload]:
    """Both spaces and the payload; prefixes of the roles go with the name of the embedding model."""
    processed = processed_reviews(spark, settings)
    with scratch(spark):
        _, spaces = rt.build_two_spaces(processed, e5_prefixes(rt.BASE, settings.embedding_model), f"{settings.index_path}/vectors")
        sinks.write_spaces(spark, list(spaces.values()), settings.index_path)
        sinks.write_payload(rt.payload_rows(processed), f"{settings.index_path}/payload")
    return load_index(spark, settings)


def load_index(spark: SparkSession, settings: Settings) -> tuple[DataFrame, dict[str, Space], sinks.Payload]:
    index, spaces = readers.read_index(spark, settings.index_path)
    return index, spaces, readers.read_payload(spark, f"{settings.index_path}/payload")


def run_training_set(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The mined pairs, written, and the plan of their batches."""
    with scratch(spark):
        judges, algo = (readers.read_queries(spark, path) for path in (settings.judge_queries_path, settings.algo_queries_path))
        mined = training_pairs(processed_reviews(spark, settings), pairs.union_queries(judges, algo), settings.num_pairs, settings.seed)
        sinks.write_table(mined, settings.pairs_path)
    written = readers.read_table(spark, settings.pairs_path, "run_training_set")
    return written, pairs.batch_plan(written, settings.batch_size, settings.epochs)


def run_evaluation(spark: SparkSession, settings: Settings) -> evaluation.Evaluation:
    """The evaluation queries, searched once in both spaces."""
    index, spaces, payload = load_index(spark, settings)
    queries = catalog.evaluation_queries(spark)
    encoded = {name: rt.encode_queries(queries, space, space) for name, space in spaces.items()}
    return evaluation.Evaluation(queries, sinks.materialize(evaluation.hits_of_spaces(index, encoded, settings.top_k, payload), "evaluated"))


def run_answers(spark: SparkSession, settings: Settings, queries: DataFrame) -> DataFrame:
    """Prompts for the answer model and templated answers of ``query_id, query``: query_id, model, messages, answer."""
    index, spaces, payload = load_index(spark, settings)
    space = spaces[rt.BASE]
    hits = rt.search(rt.in_space(index, rt.BASE), rt.encode_queries(queries, space, space), settings.top_k).with_payload(payload)
    hits = sinks.materialize(hits, "answered")
    prompts = answers.answer_prompts(queries, hits).select("query_id", F.lit(settings.answer_model).alias("model"), "messages")
    return prompts.join(answers.template_answers(queries, hits).select("query_id", "answer"), "query_id")
