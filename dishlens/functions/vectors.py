"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dishlens.functions.text import as_column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once, however often ``body`` uses it and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_column(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector at length one; a zero vector stays as it is."""

    def divided(vector: Column, length: Column) -> Column:
        return F.transform(vector, lambda x: x.cast("double") / length)

    return let(
        as_column(v),
        lambda vector: let(norm(vector), lambda n: divided(vector, F.when(n > 0, n).otherwise(F.lit(1.0)))),
    )


def weighted(v: Column | str, weights: list[float]) -> Column:
    """One factor per dimension."""
    factors = F.split(F.lit(",".join(repr(float(w)) for w in weights)), ",").cast("array<double>")
    return F.zip_with(as_column(v), factors, lambda x, w: x.cast("double") * w)
