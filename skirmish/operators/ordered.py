"""Ordered computations over a key that may hold a third of all rows.

A plain window puts a whole key into one task.  Here rows are windowed inside
``(key, segment)``, where the segment is a coarse function of the order (a week
of timestamps, a thousand positions), and one summary row per segment carries
state from earlier to later segments.  The rows are shuffled once by
``(key, segment)``; only the summaries meet per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

Specs = Mapping[str, tuple[str, Column]]


def _ordering(order: Sequence[str], value: Column | None = None) -> Column:
    key = F.struct(*order)
    return key if value is None else F.when(value.isNotNull(), key)


def _valued(df: DataFrame, specs: Specs) -> DataFrame:
    return df.select("*", *[col.alias(f"_v_{n}") for n, (_, col) in specs.items()])


def _segment_total(kind: str, name: str, order: Sequence[str]) -> Column:
    v = F.col(f"_v_{name}")
    totals = {
        "last": lambda: F.max_by(v, _ordering(order, v)),
        "first": lambda: F.min_by(v, _ordering(order, v)),
        "sum": lambda: F.sum(v), "count": lambda: F.count(v),
        "max": lambda: F.max(v), "min": lambda: F.min(v), "set": lambda: F.collect_set(v),
    }
    return totals[kind]().alias(f"_t_{name}")


def _fold(kind: str, v: Column) -> Column:
    return {"last": lambda: F.last(v, ignorenulls=True), "first": lambda: F.first(v, ignorenulls=True),
            "sum": lambda: F.sum(v), "count": lambda: F.count(v), "max": lambda: F.max(v),
            "min": lambda: F.min(v), "set": lambda: F.collect_set(v)}[kind]()


def _fold_totals(kind: str, t: Column) -> Column:
    if kind == "set":
        return F.collect_list(t)
    return F.sum(t) if kind == "count" else _fold(kind, t)


def _join_states(kind: str, near: Column, far: Column) -> Column:
    """Combine the state inside the segment with the state carried into it."""
    if kind in ("sum", "count"):
        return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
    if kind == "max":
        return F.greatest(near, far)
    if kind == "min":
        return F.least(near, far)
    if kind == "set":
        return F.sort_array(F.array_distinct(F.concat(near, F.flatten(far))))
    return F.coalesce(near, far)


def _scan(df: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], specs: Specs,
          inside: tuple[int, int], outside: tuple[int, int], swap: bool) -> DataFrame:
    kept = df.columns
    rows = _valued(df, specs)
    near_w = Window.partitionBy(*key, seg).orderBy(*order).rowsBetween(*inside)
    far_w = Window.partitionBy(*key).orderBy(seg).rowsBetween(*outside)
    near = rows.select(*kept, *[_fold(k, F.col(f"_v_{n}")).over(near_w).alias(f"_n_{n}")
                                for n, (k, _) in specs.items()])
    far = (rows.groupBy(*key, seg)
           .agg(*[_segment_total(k, n, order) for n, (k, _) in specs.items()])
           .select(*key, seg, *[_fold_totals(k, F.col(f"_t_{n}")).over(far_w).alias(f"_f_{n}")
                                for n, (k, _) in specs.items()]))

    def merged(name: str, kind: str) -> Column:
        a, b = F.col(f"_n_{name}"), F.col(f"_f_{name}")
        if swap and kind == "first":
            a, b = b, a
        return _join_states(kind, a, b).alias(name)

    return near.join(far, [*key, seg], "left").select(
        *kept, *[merged(n, k) for n, (k, _) in specs.items()])


def running(df: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], specs: Specs) -> DataFrame:
    """State from the first row of the key up to the current row.

    ``specs`` maps a new column to ``(kind, value)`` with kind one of last, first,
    sum, count, max, min, set.  ``last`` and ``first`` skip nulls.
    """
    return _scan(df, key, seg, order, specs, (Window.unboundedPreceding, 0),
                 (Window.unboundedPreceding, -1), swap=True)


def following(df: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], specs: Specs) -> DataFrame:
    """State from the current row to the last row of the key (backward fill with ``first``)."""
    return _scan(df, key, seg, order, specs, (0, Window.unboundedFollowing),
                 (1, Window.unboundedFollowing), swap=False)


def neighbours(df: DataFrame, key: Sequence[str], seg: str, order: Sequence[str],
               lead: Mapping[str, Column] | None = None,
               lag: Mapping[str, Column] | None = None) -> DataFrame:
    """Value of the next (``lead``) or previous (``lag``) row, across segments."""
    lead, lag = lead or {}, lag or {}
    kept = df.columns
    rows = df.select("*", *[c.alias(f"_v_{n}") for n, c in {**lead, **lag}.items()])
    w = Window.partitionBy(*key, seg).orderBy(*order)
    w_seg = Window.partitionBy(*key).orderBy(seg)
    near = rows.select(
        *kept, F.lead(F.lit(1)).over(w).alias("_has_next"), F.lag(F.lit(1)).over(w).alias("_has_prev"),
        *[F.lead(f"_v_{n}").over(w).alias(f"_n_{n}") for n in lead],
        *[F.lag(f"_v_{n}").over(w).alias(f"_n_{n}") for n in lag])
    edge = rows.groupBy(*key, seg).agg(
        F.lit(1).alias("_one"),
        *[F.min_by(f"_v_{n}", _ordering(order)).alias(f"_t_{n}") for n in lead],
        *[F.max_by(f"_v_{n}", _ordering(order)).alias(f"_t_{n}") for n in lag])
    edge = edge.select(*key, seg,
                       *[F.lead(f"_t_{n}").over(w_seg).alias(f"_f_{n}") for n in lead],
                       *[F.lag(f"_t_{n}").over(w_seg).alias(f"_f_{n}") for n in lag])
    return near.join(edge, [*key, seg], "left").select(
        *kept,
        *[F.when(F.col("_has_next").isNotNull(), F.col(f"_n_{n}")).otherwise(F.col(f"_f_{n}")).alias(n) for n in lead],
        *[F.when(F.col("_has_prev").isNotNull(), F.col(f"_n_{n}")).otherwise(F.col(f"_f_{n}")).alias(n) for n in lag])


def history(df: DataFrame, key: Sequence[str], seg: str, order: Sequence[str],
            value: Column, k: int, name: str) -> DataFrame:
    """Array of the values of the last ``k`` rows and the current one, oldest first."""
    kept = df.columns
    rows = df.withColumn("_v", F.struct(value.alias("x")))
    w = Window.partitionBy(*key, seg).orderBy(*order)
    w_back = Window.partitionBy(*key, seg).orderBy(*[F.desc(c) for c in order])
    near = rows.withColumn("_n", F.collect_list("_v").over(w.rowsBetween(-k, 0)))
    tails = (rows.withColumn("_r", F.row_number().over(w_back)).where(F.col("_r") <= k)
             .groupBy(*key, seg).agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), "_v"))).alias("_t")))
    segs = rows.select(*key, seg).distinct().join(tails, [*key, seg], "left")
    w_seg = Window.partitionBy(*key).orderBy(seg).rowsBetween(-k, -1)
    carry = segs.select(*key, seg, F.flatten(F.collect_list("_t").over(w_seg)).alias("_f"))
    joined = F.concat(F.transform("_f", lambda s: s["_v"]), F.col("_n"))
    last = F.slice(joined, F.greatest(F.size(joined) - k, F.lit(1)), k + 1)
    return near.join(carry, [*key, seg], "left").select(
        *kept, F.transform(last, lambda s: s["x"]).alias(name))


def range_segments(df: DataFrame, *order: Column | str, name: str = "_seg") -> DataFrame:
    """``df`` with a segment that ascends with ``order`` and holds about equally many rows, whatever the values.

    Splitters come from a sample of the rows, as in any range partitioning; rows that are equal in ``order`` share a
    segment, so give it what tells rows apart, or count equal rows first.  Written once: a lost task can't move a row.
    """
    return materialise(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "range-segments")


def ranked(df: DataFrame, by: Sequence[str], seg: Column, order: Sequence[Column | str], name: str,
           total: str | None = None) -> DataFrame:
    """Exact row number inside ``by`` without one task per group.

    ``seg`` is a coarse key, ascending with ``order``: all rows of a smaller
    segment come first.  ``total`` also adds the size of the group.
    """
    kept = df.columns
    rows = df.withColumn("_seg", seg)
    w = Window.partitionBy(*by, "_seg").orderBy(*order)
    w_seg = Window.partitionBy(*by).orderBy("_seg")
    counts = rows.groupBy(*by, "_seg").agg(F.count("*").alias("_c"))
    offsets = counts.select(
        *by, "_seg",
        F.coalesce(F.sum("_c").over(w_seg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*by)).alias("_all"))
    out = (rows.withColumn("_rn", F.row_number().over(w)).join(offsets, [*by, "_seg"])
           .withColumn(name, F.col("_rn") + F.col("_off")))
    extra = [F.col("_all").alias(total)] if total else []
    return out.select(*kept, name, *extra)


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int,
            name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark keeps ``k`` rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
