"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 60-bit hash.  For each source the words are summed by hash bucket; the bucket in which the
budget ends is split into finer buckets, and so on, until it holds one hash.  Documents are then kept by
comparing their hash with the threshold of their source: nothing is sorted, and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import word_count

HASH_BITS, LEVEL_BITS = 60, 10


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def draw_hash(ident: Column, text: Column) -> Column:
    """60 bits of a digest of identifier and text: documents that share an identifier are drawn apart, full
    repeats of a row together."""
    key = F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("")), F.sha2(F.coalesce(text, F.lit("")), 256))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size (words; 0 for a null text) and hash of each document."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"), draw_hash(F.col(id_col), F.col(text_col)).alias("hash"))


def cycled_weights(rows: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, size, weight: the sources in code-point order, null last, take the weights of ``cycle`` in
    turn.  Needs one row per source in one task: the list of sources, not the documents."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", "size", F.element_at(
        F.array(*[F.lit(w) for w in cycle]), F.pmod(place, F.lit(len(cycle))) + 1).alias("weight"))


def targets(sources: DataFrame, share_num: int = 3, share_den: int = 2, most: int = 2) -> DataFrame:
    """Adds ``target``: the sources share ``share_num/share_den`` of all words by weight; none gets more than
    ``most`` times its size, and what it can't take is shared again until none is above.

    Sources saturate in the order of size/weight, so the water level is found with running sums in that order.
    The sums are whole numbers: the result doesn't depend on the order of addition.
    """
    full = F.col("size") * most
    ahead = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    rest = ahead.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = sources.select(
        "source", "size", "weight", F.sum("size").over(everything).alias("_total"),
        F.coalesce(F.sum(full).over(before), F.lit(0)).alias("_full"), F.sum("weight").over(rest).alias("_weight"))
    left = F.col("_total") * share_num - F.col("_full") * share_den
    open_ = left * F.col("weight") < full * share_den * F.col("_weight")
    first = F.max(F.when(open_, F.struct(F.col("_weight").alias("weight"), left.alias("left")))).over(everything)
    level = stepped.select("*", first.alias("_open"), open_.alias("_is_open"))
    shared = (F.col("_open.left") * F.col("weight")).cast("double") / (F.col("_open.weight") * share_den).cast("double")
    return level.select("source", "size", "weight", F.when(F.col("_is_open"), shared).otherwise(full.cast("double"))
                        .alias("target"))


def _level(docs: DataFrame, budgets: DataFrame, shift: int) -> DataFrame:
    """For each source the first bucket that reaches its budget, with the words before it."""
    sums = docs.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").alias("words"), (F.min("hash") == F.max("hash")).alias("alone"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (sums.join(budgets, "key")
            .withColumn("end", F.col("before") + F.sum("words").over(upto))
            .where(F.col("end") >= F.col("budget"))
            .groupBy("key").agg(F.min(F.struct("bucket", "end", "words", "alone", "budget")).alias("x"))
            .select("key", "x.bucket", (F.col("x.end") - F.col("x.words")).alias("before"), "x.end", "x.alone",
                    "x.budget"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """key, cut: the documents with a hash up to ``cut`` have about ``budget`` words.  ``docs`` has key, size
    and hash, ``budgets`` key and budget; the document in which a budget ends is taken when that comes nearer."""
    found, shift = [], HASH_BITS
    inside, budgets = docs, budgets.select("key", "budget", F.lit(0).cast("long").alias("before"))
    while True:
        shift -= LEVEL_BITS
        level = materialise(_level(inside, budgets, shift), f"mix-level-{shift}")
        alone = F.col("alone") | F.lit(shift == 0)
        found.append(level.where(alone).select("key", F.lit(shift).alias("shift"), "bucket", "before", "end", "budget"))
        budgets = level.where(~alone).select("key", "budget", "before", "bucket")
        if shift == 0 or budgets.isEmpty():
            break
        inside = materialise(
            inside.join(budgets.select(F.col("key").alias("k"), F.col("bucket").alias("b")),
                        (F.col("key") == F.col("k")) & (F.shiftright("hash", shift) == F.col("b")))
            .select("key", "size", "hash"), f"mix-inside-{shift}")
        budgets = budgets.drop("bucket")
    ends = found[0]
    for more in found[1:]:
        ends = ends.unionByName(more)
    whole = F.expr("shiftleft(bucket + 1, shift) - 1")
    return ends.select("key", F.when(F.col("budget") * 2 >= F.col("before") + F.col("end"), whole)
                       .otherwise(F.expr("shiftleft(bucket, shift) - 1")).alias("cut"))


def plan(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source: key, source_size, target, passes, cut.  ``rows`` is :func:`sized`, ``goals`` has
    source, size and target."""
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    goals = materialise(goals.select(_key(F.col("source")).alias("key"), F.col("size").alias("source_size"), "target",
                                     passes.alias("passes"), (F.col("target") - passes * F.col("size")).alias("budget")),
                        "mix-goals")
    cuts = thresholds(rows.select(_key(F.col("source")).alias("key"), "size", "hash"),
                      goals.where(F.col("budget") > 0).select("key", "budget"))
    return materialise(goals.drop("budget").join(cuts, "key", "left"), "mix-plan")


def _times() -> Column:
    return (F.col("passes") + F.when(F.col("hash") <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds source_size, target and ``times`` (how often the mix takes the document) to :func:`sized` rows.

    A source gives whole passes over its documents as often as its target holds, and for the rest the documents
    up to a threshold of the hash, so no document is taken more than one time oftener than another of its source.
    A null source is a source of its own; an empty table gives no rows.  Runs agree: the draw depends on digests.
    """
    return (rows.withColumn("key", _key(F.col("source"))).join(plan(rows, goals), "key")
            .select("id", "source", "size", "hash", "source_size", "target", _times().alias("times")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, all columns kept.  The documents meet
    only the plan, a row per source, so texts are not shuffled."""
    rows = materialise(sized(docs, id_col, text_col, source_col), "mix-sized")
    sources = plan(rows, targets(cycled_weights(rows, cycle)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    drawn = docs.select(row.alias("row"), _key(F.col(source_col)).alias("key"),
                        draw_hash(F.col(id_col), F.col(text_col)).alias("hash")).join(sources, "key")
    return (drawn.where(_times() > 0)
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), _times())).alias("_"))
            .select("row.*"))
