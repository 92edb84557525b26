"""Unordered pairs inside groups, in bounded blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unordered_pairs(df: DataFrame, group: Sequence[str], item: str, block: int = 64) -> DataFrame:
    """Every pair ``(a, b)``, ``a < b``, of distinct items of a group.

    ``item`` may be a struct whose first field identifies the item.  A group of n
    items is cut into ceil(n / block) blocks and block pairs are joined on
    equality, so no join key ever holds more than about block x block pairs.
    Items must be distinct per group.
    """
    keys = [*group]
    rows = df.select(*keys, F.col(item).alias("_x"))
    blocks = F.ceil(F.count("*") / block).cast("int").alias("_nb")
    if keys:
        sized = rows.join(rows.groupBy(*keys).agg(blocks), keys)
    else:
        sized = rows.withColumn("_nb", rows.agg(blocks).scalar())
    tagged = sized.withColumn("_b", F.pmod(F.hash("_x"), F.col("_nb")))
    lo = tagged.select(*keys, F.col("_x").alias("_x1"), F.col("_b").alias("_lo"),
                       F.explode(F.sequence("_b", F.col("_nb") - 1)).alias("_hi"))
    hi = tagged.select(*keys, F.col("_x").alias("_x2"),
                       F.explode(F.sequence(F.lit(0), "_b")).alias("_lo"), F.col("_b").alias("_hi"))
    pairs = lo.join(hi, [*keys, "_lo", "_hi"]).where(
        (F.col("_lo") < F.col("_hi")) | (F.col("_x1") < F.col("_x2")))
    return pairs.select(*group, F.least("_x1", "_x2").alias("a"), F.greatest("_x1", "_x2").alias("b"))
