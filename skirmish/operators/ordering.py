"""Orders: rankings, natural ids, canonical member order, seeded shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw_key
from ..functions.text import clean_name, natural_number


def by_generation_and_score(df: DataFrame, gen: str, score: str, tie: str) -> DataFrame:
    return df.orderBy(gen, F.desc(score), tie)


def by_win_rate(df: DataFrame, rate: str, games: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(rate), F.desc(games), tie)


def newest(df: DataFrame, played: str, tie: str, n: int) -> DataFrame:
    """The ``n`` newest rows (each task keeps ``n``, no full sort)."""
    return df.orderBy(F.desc(played), tie).limit(n)


def natural_key(id_col: Column) -> Column:
    """Sort key: ids with a number first, by that number, then by text."""
    n = natural_number(id_col)
    return F.struct(n.isNull().alias("no_number"), n.alias("number"), id_col.alias("text"))


def top_entries(weights: Column, k: int, skip: Sequence[str] = ("other", "nothing")) -> Column:
    """Names of the ``k`` heaviest map entries, by weight then name, both descending."""
    good = F.filter(F.map_entries(weights), lambda e: (e["value"] > 0) & ~F.lower(e["key"]).isin(*skip))
    ranked = F.sort_array(F.transform(good, lambda e: F.struct(e["value"], e["key"])), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda e: e["key"])


def canonical_order(members: Column, name: str | None = None) -> Column:
    """Array sorted by cleaned name, so that positions are stable action indices."""
    key = lambda m: clean_name(m[name] if name else m)
    keyed = F.transform(members, lambda m: F.struct(key(m).alias("k"), m.alias("m")))
    return F.transform(F.sort_array(keyed), lambda s: s["m"])


def reveal_order(pairs: Column) -> Column:
    """Sort (seen, truth) pairs: seen by name, hidden with a label, hidden without one, empty slots last.

    Unknown values are null and an empty slot is the literal ``<none>``.
    """
    def rank(p: Column) -> Column:
        return (F.when(p["seen"] == "<none>", 3).when(p["seen"].isNotNull(), 0)
                .when(p["truth"].isNotNull(), 1).otherwise(2))
    keyed = F.transform(pairs, lambda p: F.struct(
        rank(p).alias("c"), F.coalesce(p["seen"], p["truth"]).alias("n"), p.alias("p")))
    return F.transform(F.sort_array(keyed), lambda s: s["p"])


def seeded_sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """First ``n`` rows of a seeded shuffle."""
    return df.withColumn("_d", draw_key(seed, key)).orderBy("_d", key).limit(n).drop("_d")
