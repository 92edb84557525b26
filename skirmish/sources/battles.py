"""Raw battle logs: scan, format recovery, storage by generation and tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = ("id STRING, format STRING, players ARRAY<STRING>, log STRING, uploadtime BIGINT, formatid STRING, "
              "_corrupt_record STRING")


def read_raw_battles(spark: SparkSession, roots: Sequence[str], multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Battles below the roots (one JSON each), and unreadable files with their path.

    A battle reached twice through links is kept once.
    """
    raw = (spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", True).option("multiLine", multi_line)
           .option("mode", "PERMISSIVE").json(list(roots)).withColumn("path", F.col("_metadata.file_path")))
    good = raw.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")
    bad = raw.where("_corrupt_record IS NOT NULL OR id IS NULL").select(
        "path", "_corrupt_record", F.lit("UnreadableBattle").alias("reason"))
    good = good.withColumn("uploaded", F.timestamp_seconds("uploadtime"))
    return good.dropDuplicates(["id"]), bad


def recover_format(raw: DataFrame) -> DataFrame:
    """Adds ``format_id``: the given id, else the cleaned format text, else a ``genN...`` piece of the battle id;
    rows whose format cannot be recovered are dropped."""
    present = lambda c: F.when(F.col(c) != "MISSING", F.col(c))
    from_text = F.lower(F.regexp_replace(present("format"), r"[\[\] ]", ""))
    from_id = F.try_element_at(F.filter(F.split("id", "-"), lambda p: p.rlike("^gen[0-9]")), F.lit(1))
    rows = raw.where(present("id").isNotNull()).withColumn(
        "format_id", F.coalesce(present("formatid"), from_text, F.lower(F.trim(from_id))))
    rows = rows.where(F.col("format_id").rlike("^gen[0-9]"))
    return rows.withColumn("gen", F.substring("format_id", 4, 1).cast("int")).withColumn(
        "tier", F.expr("substring(format_id, 5)"))


def format_counts(battles: DataFrame) -> DataFrame:
    return battles.groupBy("format_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "format_id")


def write_battles(battles: DataFrame, path: str) -> None:
    """Store by generation and tier, so that a format is read by partition pruning.

    Rows are rebalanced first: small formats share a task, a large one is split over many.
    """
    battles.hint("rebalance", "gen", "tier").write.mode("append").partitionBy("gen", "tier").parquet(path)
