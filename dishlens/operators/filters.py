"""Metadata filters on reviews and on hits. A filter that is not set filters nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.operators.topk import QUERY_FILTERS

LIST_FILTERS = QUERY_FILTERS[1:]


@dataclass(frozen=True)
class Filters:
    """The same filters for every query; empty text and 0 mean none."""

    min_rating: int | None = None
    cuisine_type: str | None = None
    food_type: str | None = None
    location: str | None = None
    price_level: str | None = None

    def conditions(self) -> list[Column]:
        out = [F.col("star_rating") >= self.min_rating] if self.min_rating else []
        for facet in LIST_FILTERS:
            value = getattr(self, facet)
            if value:
                out.append(holds(F.col(facet), F.lit(value)))
        return out


def holds(values: Column, wanted: Column) -> Column:
    """A whole value of the list equals the wanted one, whatever the case."""
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(v) == F.lower(wanted))


def apply_filters(df: DataFrame, filters: Filters | None) -> DataFrame:
    for condition in filters.conditions() if filters else []:
        df = df.where(condition)
    return df


def passes_query_filters(query_columns: list[str], prefix: str) -> Column:
    """A hit with payload passes the filter columns of its query, which carry ``prefix`` here."""
    ok = F.lit(True)
    if "min_rating" in query_columns:
        least = F.col(f"{prefix}min_rating")
        ok = ok & F.coalesce((least <= 0) | (F.col("star_rating") >= least), least.isNull())
    for facet in LIST_FILTERS:
        if facet in query_columns:
            wanted = F.col(f"{prefix}{facet}")
            ok = ok & (F.coalesce(wanted, F.lit("")).eqNullSafe("") | holds(F.col(facet), wanted))
    return ok
