"""Battle metadata carried in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_battle_date


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(json\.lz4|json|[a-z0-9]+_team)$", "")


def parse_trajectory_names(df: DataFrame, name: str = "file_name") -> DataFrame:
    """``battle_rating_p1_vs_p2_date_result``; eight parts mean an underscore in the first name, any other
    count drops the row."""
    rows = df.withColumn("_p", F.split(_stem(F.col(name)), "_")).where(F.size("_p").isin(7, 8))
    back = lambda i: F.element_at("_p", -i)
    first = F.when(F.size("_p") == 7, F.element_at("_p", 3)).otherwise(F.concat_ws("_", F.element_at("_p", 3), F.element_at("_p", 4)))
    battle = F.element_at("_p", 1)
    return rows.select(
        *df.columns, battle.alias("battle"), F.element_at("_p", 2).alias("rating"), first.alias("player"), back(3).alias("opponent"),
        back(2).alias("date_text"), parse_battle_date(back(2)).alias("played"), back(1).alias("result"),
        F.lower(F.regexp_replace(battle, r"[\[\] ]", "")).alias("battle_key"))


def of_format(df: DataFrame, fmt: str) -> DataFrame:
    """Rows whose battle name contains the format (the import rule; stored tables compare for equality)."""
    return df.where(F.col("battle_key").contains(fmt))


def parse_team_names(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Team files: the first seven parts, with a WIN or LOSS result."""
    rows = df.withColumn("_p", F.split(_stem(F.col(name)), "_")).where((F.size("_p") >= 7) & F.element_at("_p", 7).isin("WIN", "LOSS"))
    at = lambda i: F.element_at("_p", i)
    return rows.select(*df.columns, at(1).alias("battle"), at(2).alias("rating"), at(3).alias("player"), at(5).alias("opponent"),
                       parse_battle_date(at(6)).alias("played"), at(7).alias("result"))
