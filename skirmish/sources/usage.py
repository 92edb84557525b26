"""Monthly usage reports: boxed text to long usage rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordered import running
from ..session import materialise

# Section heading -> usage field.
SECTIONS = {"Abilities": "abilities", "Items": "items", "Spreads": "spreads", "Moves": "moves",
            "Tera Types": "tera_types", "Teammates": "teammates", "Checks and Counters": "checks"}

DEFAULT_RANK = 1500


def read_reports(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
            .text(list(roots), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def report_rank(file_name: Column, fmt: Column) -> Column:
    """Skill cut-off in a report's name: none written means 1500; null for a file of another format."""
    stem = F.regexp_extract(file_name, r"^(.*)\.txt$", 1)
    suffix = F.regexp_extract(stem, r"-([0-9]+)(?:\.[0-9]+)?$", 1)
    plain = F.regexp_replace(stem, r"-[0-9]+(?:\.[0-9]+)?$", "")
    return F.when(stem == fmt, DEFAULT_RANK).when((plain == fmt) & (suffix != ""), suffix.try_cast("int"))


def _report_blocks(reports: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Boxes of each report with the entity they belong to.  Reports are read and split once, before the scan reads the boxes twice."""
    boxes = F.split(content, r"(?m)^\s*\+-[-+]*\s*$")
    rows = reports.select(*keys, F.posexplode(boxes).alias("i", "_b"))
    lines = F.filter(F.transform(F.split("_b", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\||\|\s*$", ""))), lambda x: x != "")
    rows = materialise(rows.select(*keys, "i", lines.alias("lines")), "report-boxes").where(F.size("lines") > 0)
    head = F.col("lines")[0]
    rows = rows.withColumn("head", head).withColumn("_seg", F.floor(F.col("i") / 2048))
    is_name = (F.size("lines") == 1) & ~head.isin(*SECTIONS) & ~head.startswith("Raw count")
    return running(rows, keys, "_seg", ["i"], {"entity": ("last", F.when(is_name, head))}).drop("_seg")


def parse_reports(reports: DataFrame, keys: Sequence[str], content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(usage rows: keys, entity, field, key, share; counts: keys, entity, n).

    A missing section has no rows; a missing tera section becomes ``Nothing`` with share 1.
    """
    blocks = materialise(_report_blocks(reports, keys, content), "report-blocks")  # read three times below
    count = F.regexp_extract("head", r":\s*(\d+)", 1).try_cast("bigint")
    counts = blocks.where(F.col("head").startswith("Raw count")).groupBy(*keys, "entity").agg(F.max(count).alias("n"))
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    cells = blocks.where(F.col("head").isin(*SECTIONS)).select(
        *keys, "entity", F.try_element_at(names, F.col("head")).alias("field"), F.posexplode(tx.after_first(F.col("lines"))).alias("at", "line"))
    check = F.col("field") == "checks"
    cells = cells.where(~check | (F.col("at") % 2 == 0))
    key = F.when(check, F.regexp_extract("line", r"^(.*)\s+\S+\s+\S+$", 1)).otherwise(F.regexp_extract("line", r"^(.*)\s+[-+]?[0-9.]+%$", 1))
    number = F.when(check, F.regexp_extract("line", r"\s(\S+)\s+\S+$", 1)).otherwise(F.regexp_extract("line", r"[-+]?([0-9.]+)%$", 1))
    usage = cells.select(*keys, "entity", "field", F.trim(key).alias("key"), (number.try_cast("double") / 100).alias("share")).where(
        "share IS NOT NULL AND key <> ''")
    no_tera = blocks.select(*keys, "entity").where("entity IS NOT NULL").distinct().join(
        usage.where("field = 'tera_types'").select(*keys, "entity"), [*keys, "entity"], "left_anti")
    nothing = no_tera.select(*keys, "entity", F.lit("tera_types").alias("field"), F.lit("Nothing").alias("key"), F.lit(1.0).alias("share"))
    return usage.unionByName(nothing), counts


def write_usage(usage: DataFrame, path: str, mode: str = "append") -> None:
    """Store by generation, tier, rank and month (columns gen, tier, rank, month)."""
    cols = ["gen", "tier", "rank", "month"]
    usage.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)


def checks_projection(usage: DataFrame) -> DataFrame:
    return usage.where("field = 'checks'").drop("field")
