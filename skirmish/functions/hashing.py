"""Reproducible randomness: the same seed and key give the same draw everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int | str, *cols: Column | str) -> Column:
    """Hex digest of seed and key; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str)
                                                      else c.cast("string") for c in cols]))


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """Uniform number in (0, 1) from the first 32 bits of :func:`draw_key`."""
    bits = F.conv(F.substring(draw_key(seed, *cols), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4294967296.0)


def shuffle_segment(key: Column, digits: int = 3) -> Column:
    """Leading hex digits of a digest: even, ordered segments for exact ranks."""
    return F.substring(key, 1, digits)


def fast_uniform(seed: int | str, *cols: Column) -> Column:
    """Uniform number in (0, 1) from a 64-bit hash; for draws made many times per row."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *cols), 11).cast("double")
    return (bits + 0.5) / F.lit(float(2 ** 53))
