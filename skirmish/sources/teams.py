"""Team text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read_team_files(spark: SparkSession, roots: Sequence[str], glob: str = "*_team") -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .text(list(roots), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def parse_teams(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """One row per member: slot 0 is the lead.  Facts a block does not state are null."""
    text = F.regexp_replace(F.regexp_replace(content, "​", ""), "\r", "")
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: F.trim(b) != "")
    rows = files.select(*keys, F.posexplode(blocks).alias("slot", "_b"))
    lines = F.filter(F.transform(F.split(F.trim("_b"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("_l", lines)
    head, rest = F.col("_l")[0], tx.after_first(F.col("_l"))
    ability = tx.labelled(rest, "Ability")
    nature = F.try_element_at(F.filter(rest, lambda x: x.endswith("Nature")), F.lit(1))
    return rows.select(
        *keys, "slot", tx.member_species(head).alias("name"), tx.member_item(head).alias("item"),
        F.when(ability == "No Ability", "<none>").otherwise(ability).alias("ability"),
        tx.labelled(rest, "Tera Type").alias("tera_type"), F.split(nature, r"\s+")[0].alias("nature"),
        spread(tx.labelled(rest, "EVs")).alias("evs"), spread(tx.labelled(rest, "IVs")).alias("ivs"),
        tx.member_moves(rest).alias("moves"))


# Stat names of a spread in order.
SPREAD_STATS = ("HP", "Atk", "Def", "SpA", "SpD", "Spe")


def spread(text):
    """Six numbers from ``252 HP / 4 Def``; null when the line is absent, null inside for a stat not written."""
    parts = F.transform(F.split(text, "/"), lambda p: F.split(F.trim(p), r"\s+"))
    one = lambda s: F.try_element_at(F.transform(F.filter(parts, lambda p: (F.size(p) == 2) & (p[1] == s)),
                                                 lambda p: p[0].try_cast("int")), F.lit(1))
    return F.when(text.isNotNull(), F.array(*[one(s) for s in SPREAD_STATS]))
