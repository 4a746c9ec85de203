"""Seeded draws that do not depend on partitioning, retries or the engine's own random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def hash32(c: Column) -> Column:
    """Uniform integer in ``[0, 2^32)`` from a string."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def key(seed: int, *parts: Column | str) -> Column:
    """Text under which a draw is made: ``seed:part:part``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])


def draw(seed: int, strategy: str, ordinal: Column, slot: str, modulus: Column) -> Column:
    """Draw number ``ordinal`` out of ``[0, modulus)``; null if there is nothing to draw from."""
    return F.when(modulus > 0, F.pmod(hash32(key(seed, strategy, ordinal, slot)), F.when(modulus > 0, modulus)))
