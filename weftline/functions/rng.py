"""Counter-based draws: the same for a (seed, id, draw) in every partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(seed: int, key: Column, *draw: Column | str | int) -> Column:
    """32 uniform bits as bigint: the first eight hex digits of an MD5."""
    parts = [F.lit(str(seed)), key.cast("string"), *((d if isinstance(d, Column) else F.lit(str(d))).cast("string") for d in draw)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, key: Column, *draw: Column | str | int) -> Column:
    """A real in [0, 1)."""
    return u32(seed, key, *draw) / F.lit(4294967296.0)


def randint(seed: int, key: Column, low: Column | int, high: Column | int, *draw: Column | str | int) -> Column:
    """An integer between both ends, both included."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return lo + u32(seed, key, *draw) % (hi - lo + 1)
