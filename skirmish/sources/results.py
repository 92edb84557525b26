"""Result logs, examples and match results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = ("player", "team_file", "opponent", "result", "turns", "battle_id")
RESULT_SCHEMA = ("matchup_id STRING, policy_a_name STRING, policy_b_name STRING, policy_a_wins BIGINT, policy_b_wins BIGINT, "
                 "total_battles BIGINT, timestamp STRING, _corrupt_record STRING")
EXAMPLE_SCHEMA = "team_A ARRAY<INT>, team_B ARRAY<INT>, y INT"


def header_key(name: Column) -> Column:
    """Column name reduced to lower-case letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


# Header spellings of the first column.
_FIRST_HEADERS = ("playerusername",)


def read_result_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of result CSVs with or without a header; missing trailing columns are null, blank and short rows
    (under four values) are dropped."""
    schema = ", ".join(f"{c} STRING" for c in RESULT_COLUMNS)
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(list(paths))
    return clean_results(rows)


def clean_results(rows: DataFrame) -> DataFrame:
    filled = [F.trim(F.col(c)) for c in RESULT_COLUMNS]
    rows = rows.select(*[F.nullif(c, F.lit("")).alias(n) for c, n in zip(filled, RESULT_COLUMNS)])
    rows = rows.where(F.col("result").isNotNull() & ~header_key(F.coalesce("player", F.lit(""))).isin(*_FIRST_HEADERS))
    return rows.withColumn("result", F.upper("result")).withColumn("turns", F.col("turns").try_cast("int"))


def latest_results(log: DataFrame, key: str, at: str) -> DataFrame:
    """Last row per id of an append-only log; unreadable lines are left out."""
    cols = [c for c in log.columns if c != "_corrupt_record"]
    good = log.where("_corrupt_record IS NULL") if "_corrupt_record" in log.columns else log
    rows = good.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(at, *[c for c in cols if c not in (key, at)])).alias("_r"))
    return rows.select("_r.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").json(path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("append").json(path)


def read_examples(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Examples of several JSONL sources as one table."""
    return spark.read.schema(EXAMPLE_SCHEMA).json(list(paths))
