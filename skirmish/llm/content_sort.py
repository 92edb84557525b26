"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised texts (``repartitionByRange``), each partition is sorted
externally, so that equal texts lie side by side, and a window compares each text with its neighbours in full.
The sort order is that of the first characters, then a hash, then the whole text: the splitters, which the driver
holds, stay short however long the texts are, and a beginning that very many texts share is split by the hash.
A text with more than ``copies_per_run`` copies is dealt to as many runs as it needs, by a hash of the
identifier; the sort keeps those runs apart and a sum over one row per run puts them together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import ascii_lower

#: Characters of a text that a splitter holds.
SPLITTER_CHARS = 16


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, copies_per_run: int,
                 carried: Column | None) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"),
                       *([carried.alias("row")] if carried is not None else []))
    hashed = rows.withColumns({"start": F.substring("norm", 1, SPLITTER_CHARS), "h": F.xxhash64("norm")})
    hot = materialise(hashed.groupBy(F.col("h").alias("hot")).count().where(F.col("count") > copies_per_run), "hot-texts")
    runs = F.ceil(F.col("count") / F.lit(copies_per_run))
    dealt = (hashed.join(hot, F.col("h") == F.col("hot"), "left")
             .withColumn("run", F.when(F.col("hot").isNull(), F.lit(-1))
                         .otherwise(F.pmod(F.xxhash64("id"), runs)).cast("long"))
             .drop("hot", "count")
             .repartitionByRange("start", "h", "run"))
    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    group = Window.partitionBy("start", "h", "run", "norm")
    ordered = group.orderBy(best)
    return dealt.select(
        "*", F.row_number().over(ordered).alias("nth"), F.count(F.lit(1)).over(group).alias("run_size"),
        F.first("id").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("run_best"),
    ).withColumn("digest", F.sha2("norm", 256)).drop("norm", "start", "h")


def _joined_runs(runs: DataFrame, keep: str) -> DataFrame:
    """One row per hot text from one row per run: best identifier, the run that has it, all copies."""
    known = F.struct(F.col("run_best").isNotNull() if keep == "largest" else F.col("run_best").isNull(),
                     "run_best", "run")
    pick = F.max if keep == "largest" else F.min
    return (runs.where((F.col("run") >= 0) & (F.col("nth") == 1)).groupBy("digest")
            .agg(pick(known).alias("best"), F.sum("run_size").alias("copies"))
            .select(F.col("digest").alias("hot_digest"), F.col("best.run_best").alias("hot_best"),
                    F.col("best.run").alias("hot_run"), "copies"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     copies_per_run: int = 1000) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  One row of each group stays,
    that with the smallest (or largest) identifier; a null identifier loses to any other, and of rows that
    repeat the winning identifier one stays.  Other columns of ``docs`` are not read; an empty table gives none.
    """
    rows = materialise(_sorted_runs(docs, id_col, text_col, keep, copies_per_run, None), "content-sort")
    joined = _joined_runs(rows, keep)
    single = rows.where(F.col("run") < 0).select(
        F.col("id").alias(id_col), F.col("run_best").alias("keep_id"), F.col("run_size").alias("group_size"),
        (F.col("nth") == 1).alias("kept"), F.col("digest").alias("text_sha256"))
    hot = rows.where(F.col("run") >= 0).join(joined, F.col("digest") == F.col("hot_digest")).select(
        F.col("id").alias(id_col), F.col("hot_best").alias("keep_id"), F.col("copies").alias("group_size"),
        ((F.col("nth") == 1) & (F.col("run") == F.col("hot_run"))).alias("kept"),
        F.col("digest").alias("text_sha256"))
    return single.unionByName(hot)


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                  copies_per_run: int = 1000) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns."""
    runs = _sorted_runs(docs, id_col, text_col, keep, copies_per_run, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    firsts = materialise(runs.where(F.col("nth") == 1), "content-sort")
    hot = firsts.where(F.col("run") >= 0).join(
        _joined_runs(firsts, keep), (F.col("digest") == F.col("hot_digest")) & (F.col("run") == F.col("hot_run")))
    return firsts.where(F.col("run") < 0).select("row.*").unionByName(hot.select("row.*"))
