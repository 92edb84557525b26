"""Set operations on rows and inside rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(*sources: DataFrame, distinct: bool = False) -> DataFrame:
    """Union by name; columns a source lacks become null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return out.distinct() if distinct else out


def only_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), [*on], "left_anti")


def in_both(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), [*on], "left_semi")


def with_mirror(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Each example and its mirror with the label flipped, in one scan."""
    both = df.withColumn("mirrored", F.explode(F.array(F.lit(False), F.lit(True))))
    m = F.col("mirrored")
    keep = [c for c in df.columns if c not in (a, b, y)]
    return both.select(*keep, "mirrored", F.when(m, F.col(b)).otherwise(F.col(a)).alias(a),
                       F.when(m, F.col(a)).otherwise(F.col(b)).alias(b),
                       F.when(m, 1 - F.col(y)).otherwise(F.col(y)).alias(y))


def set_identity(name: Column, moves: Column, item: Column, ability: Column) -> Column:
    """Key of a record that ignores move order and unknown moves."""
    return F.struct(name.alias("name"), F.sort_array(F.array_distinct(F.array_compact(moves))).alias("moves"),
                    item.alias("item"), ability.alias("ability"))


def distinct_sets(df: DataFrame, identity: Column) -> DataFrame:
    """One row per identity with the number of copies."""
    return df.groupBy(identity.alias("identity")).agg(F.count("*").alias("copies"))
