"""Settings shared by the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Paths and sizes of one deployment; every job takes what it needs from here as arguments."""

    reviews_path: str = "data/reviews.csv"
    dictionary_path: str = "data/food_dictionary.txt"
    judge_queries_path: str = "data/queries_judges.txt"
    algo_queries_path: str = "data/queries_algo.txt"
    processed_path: str = "data/processed"
    index_path: str = "data/index"
    pairs_path: str = "data/pairs"
    embedding_model: str = "intfloat/multilingual-e5-base"
    answer_model: str = "scb10x/llama3.1-typhoon2-8b-instruct"
    top_k: int = 5
    max_reviews: int | None = None
    num_pairs: int = 10_000
    batch_size: int = 16
    epochs: int = 3
    seed: int = 42


#: Folders that callers of local sessions without the setting have named, by application.
_own_base: dict[str, str] = {}


def use_own_work_dir(spark: SparkSession, make: Callable[[], str]) -> None:
    """For a session on one machine that leaves ``spark.checkpoint.dir`` out: the folder that ``make`` makes takes its place."""
    context = spark.sparkContext
    unset = not (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"))
    if unset and context.master.startswith("local[") and context.applicationId not in _own_base:
        _own_base[context.applicationId] = make()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables below the shared folder the session names.

    The session names it in ``spark.checkpoint.dir``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_base.get(spark.sparkContext.applicationId)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


#: Folders given out inside ``scratch`` blocks that are open.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders for intermediate tables given out inside are removed at the end; a job writes its results inside, elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _scratch.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
