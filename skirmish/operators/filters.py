"""Selections on metadata, scores and sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name

UNRATED_AS = 1000


@dataclass(frozen=True)
class BattleFilter:
    """Bounds on outcome, rating and date.

    ``zero_is_bound`` and ``dates_required`` choose between the trajectory mode
    (a bound of 0 is no bound; a bad date drops a row only when a date bound is
    set) and the team-file mode (0 is a bound; bad dates are always dropped).
    """
    outcome: str = "both"
    min_rating: int | None = None
    max_rating: int | None = None
    min_date: date | None = None
    max_date: date | None = None
    zero_is_bound: bool = False
    dates_required: bool = False

    def condition(self, outcome: Column, rating: Column, played: Column) -> Column:
        keep = F.lit(True)
        if self.outcome == "wins":
            keep = keep & (outcome == "WIN")
        elif self.outcome == "losses":
            keep = keep & (outcome == "LOSS")
        value = F.coalesce(rating.try_cast("int"), F.lit(UNRATED_AS))
        bound = (lambda b: b is not None) if self.zero_is_bound else bool
        if bound(self.min_rating):
            keep = keep & (value >= self.min_rating)
        if bound(self.max_rating):
            keep = keep & (value <= self.max_rating)
        if self.min_date:
            keep = keep & (played >= F.lit(self.min_date))
        if self.max_date:
            keep = keep & (played <= F.lit(self.max_date))
        if self.dates_required or self.min_date or self.max_date:
            keep = keep & played.isNotNull()
        return keep


def elite(df: DataFrame, rating: Column, tournament: Column, played: Column, min_rating: int,
          min_date: date | None = None) -> DataFrame:
    """High rating or tournament source, with the same earliest date for both."""
    fresh = played >= F.lit(min_date) if min_date else F.lit(True)
    return df.where(fresh & ((F.coalesce(rating.try_cast("int"), F.lit(UNRATED_AS)) >= min_rating) | tournament))


def elite_sizes(df: DataFrame, by: Sequence[str], rating: Column, tournament: Column, min_rating: int) -> DataFrame:
    """Sizes of both selections, their overlap and their union in one pass."""
    a = F.coalesce(rating.try_cast("int"), F.lit(UNRATED_AS)) >= min_rating
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*by).agg(n(a).alias("high"), n(tournament).alias("tournament"),
                               n(a & tournament).alias("both"), n(a | tournament).alias("either"))


def keyed_threshold(df: DataFrame, thresholds: DataFrame, key: str, bound: str, value: Column,
                    default: float) -> DataFrame:
    """Rows at or above the threshold of their key, or the default where the key has none."""
    return df.join(thresholds, key, "left").where(value >= F.coalesce(F.col(bound), F.lit(default))).drop(bound)


def team_set(df: DataFrame, kind: str, rating: Column, tournament: Column, played: Column, since: date,
             until: date, min_rating: int) -> DataFrame:
    """General (``gl``) or high-ladder (``hl``) selection inside a date window."""
    window = df.where((played >= F.lit(since)) & (played <= F.lit(until)))
    if kind == "gl":
        return window
    if kind == "hl":
        return elite(window, rating, tournament, played, min_rating)
    raise ValueError(f"unknown set kind {kind}")


def format_alias(fmt: Column, aliases: Mapping[str, str]) -> Column:
    """Lower-case canonical name of a format; unknown names pass through."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(fmt)), F.lower(fmt))


def format_generation(fmt: Column) -> Column:
    return F.regexp_extract(F.lower(fmt), r"gen([0-9]+)", 1).try_cast("int")


def eligible_entities(counts: DataFrame, by: Sequence[str], count: str, options: Column, min_share: float,
                      min_options: int = 4) -> DataFrame:
    """Entities with a large enough usage share and enough options."""
    totals = counts.groupBy(*by).agg(F.sum(count).alias("_all"))
    return counts.join(totals, [*by]).withColumn("share", F.col(count) / F.col("_all")).where(
        (F.col("share") >= min_share) & (options >= min_options)).drop("_all")


def supported_keys(df: DataFrame, key: str, min_count: int) -> DataFrame:
    """Rows whose key occurs at least ``min_count`` times."""
    kept = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count).select(key)
    return df.join(kept, key, "left_semi")


def legal_in_tier(df: DataFrame, legality: DataFrame, key: str, tier: str, at_least: int) -> DataFrame:
    """Rows whose entity is legal at tier order ``at_least``."""
    return df.join(legality.where(F.col(tier) >= at_least), key, "left_semi")


def without_sentinels(df: DataFrame, value: Column, sentinels: Sequence[str] = ("missing", "none", "")) -> DataFrame:
    return df.where(value.isNotNull() & ~F.lower(value).isin(*sentinels))


def conflict_free(rows: DataFrame, key: Sequence[str], item: str, conflicts: DataFrame) -> DataFrame:
    """Keys of sets (one row per item) without repeats and without a forbidden pair.

    ``conflicts`` has columns ``x``, ``y``; a set of any size stays in rows.
    """
    counted = rows.groupBy(*key, item).agg(F.count("*").alias("_n"))
    plain = counted.groupBy(*key).agg(F.max("_n").alias("_n")).where("_n = 1").select(*key)
    have = counted.select(*key, F.col(item).alias("x"))
    wants = have.join(conflicts, "x").select(*key, F.col("y").alias("x"))
    hit = wants.join(have, [*key, "x"], "left_semi").select(*key)
    return plain.join(hit, [*key], "left_anti")


def score_floor(df: DataFrame, score: Column, floor: float | None) -> DataFrame:
    return df if floor is None else df.where(score >= floor)


def clause_legality(rows: DataFrame, team: Sequence[str], clause: Column, name: str = "legal") -> DataFrame:
    """Whether a team (one row per member) has one member per clause group."""
    groups = rows.groupBy(*team, clause.alias("_c")).agg(F.count("*").alias("_n"))
    return groups.groupBy(*team).agg((F.max("_n") == 1).alias(name))


def one_per_clause(team: Column, clause_of: Mapping[str, str] | None = None) -> Column:
    """True when no two members share a clause key; by default the key is the cleaned name."""
    if clause_of is None:
        keys = F.transform(team, lambda m: clean_name(m))
    else:
        table = F.create_map(*[F.lit(x) for kv in clause_of.items() for x in kv])
        keys = F.transform(team, lambda m: F.coalesce(F.try_element_at(table, m), m))
    return F.size(F.array_distinct(keys)) == F.size(team)
