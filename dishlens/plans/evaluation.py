"""Evaluation of one space and comparison of two over a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.operators import answers, metrics
from dishlens.operators.topk import top_k
from dishlens.plans.retrieval import BASE, TUNED, in_space
from dishlens.sources.sinks import Payload


def hits_of_spaces(index: DataFrame, encoded: dict[str, DataFrame], k: int = 5, payload: DataFrame | Payload | None = None) -> DataFrame:
    """Hits with payload of every space, one search each, as one table with a ``space`` column."""
    parts = []
    for name, queries in encoded.items():
        own = in_space(index, name)
        parts.append(top_k(own, queries, k).with_payload(own if payload is None else payload).withColumn("space", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Evaluation:
    """Everything the report needs; ``hits`` should be a written or cached table because each part reads it."""

    queries: DataFrame
    hits: DataFrame

    def comparison(self) -> DataFrame:
        return metrics.compare(self.queries, self.hits, BASE, TUNED)

    def by_category(self) -> DataFrame:
        return metrics.by_category(self.comparison())

    def overall(self) -> DataFrame:
        return metrics.over_queries(self.comparison())

    def report(self) -> DataFrame:
        return metrics.report(self.comparison())

    def detail(self) -> DataFrame:
        """Per query: its attributes, the comparison, both answers and both lists of rows found, by rank."""
        both = self.queries.withColumn("space", F.explode(F.array(F.lit(BASE), F.lit(TUNED))))
        texts = answers.template_answers(both, self.hits, by=["space"])
        sides = texts.groupBy("query_id").agg(
            F.max(F.when(F.col("space") == BASE, F.col("answer"))).alias("baseline_answer"),
            F.max(F.when(F.col("space") == TUNED, F.col("answer"))).alias("finetuned_answer"),
        )
        found = lambda space: F.transform(
            F.array_sort(F.collect_list(F.when(F.col("space") == space, F.struct("rank", "row_id")))), lambda h: h["row_id"]
        )
        lists = self.hits.groupBy("query_id").agg(found(BASE).alias("baseline_hits"), found(TUNED).alias("finetuned_hits"))
        none = F.array().cast("array<bigint>")
        out = self.comparison().join(sides, "query_id").join(lists, "query_id", "left")
        out = out.withColumns({c: F.coalesce(c, none) for c in ("baseline_hits", "finetuned_hits")})
        more = [c for c in ("description",) if c in self.queries.columns and c not in out.columns]
        return out.join(self.queries.select("query_id", *more), "query_id") if more else out
