"""Partial records: null is unknown, ``<none>`` is known to be empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_name

NONE = "<none>"

# Entities with an unusual number of moves, by (name, generation).
SMALL_SETS = {
    ("ditto", 1): 1, ("magikarp", 1): 1, ("caterpie", 1): 1, ("weedle", 1): 1, ("metapod", 1): 1, ("kakuna", 1): 1,
    ("unown", 2): 1, ("ditto", 2): 1, ("magikarp", 2): 1, ("smeargle", 2): 1,
    ("ditto", 3): 1, ("magikarp", 3): 1, ("unown", 3): 1, ("smeargle", 3): 1, ("beldum", 3): 1,
    ("wobbuffet", 3): 4, ("wynaut", 3): 4,
    ("ditto", 4): 1, ("magikarp", 4): 1, ("unown", 4): 1, ("smeargle", 4): 1, ("beldum", 4): 1,
    ("wobbuffet", 4): 4, ("wynaut", 4): 4, ("combee", 4): 2}


def known_fields(fields: Sequence[Column], moves: Column) -> Column:
    """Number of known fields, moves included."""
    n = F.size(F.array_compact(moves))
    for f in fields:
        n = n + f.isNotNull().cast("int")
    return n


def gap_fill(known: Column, predicted: Column) -> Column:
    return F.coalesce(known, predicted)


def gap_fill_moves(known: Column, predicted: Column, size: int = 4) -> Column:
    """Known moves, then predicted ones not yet known, up to ``size``."""
    return F.slice(F.concat(F.array_compact(known), F.array_except(F.array_compact(predicted), F.array_compact(known))), 1, size)


def added_details(known: Mapping[str, Column], fuller: Mapping[str, Column]) -> Column:
    """Map of the fields that ``fuller`` has and ``known`` lacks."""
    cells = [x for name, c in fuller.items() for x in (F.lit(name), F.when(known[name].isNull(), c))]
    return F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull())


def canonical_team(ids: Column) -> Column:
    return F.sort_array(F.array_distinct(ids))


def team_error(ids: Column, size: int | None = None) -> Column:
    """Reason a team is not valid: repeated members or a wrong size; null for a good one."""
    bad = F.when(F.size(F.array_distinct(ids)) != F.size(ids), "DuplicateMember")
    return bad if size is None else bad.when(F.size(ids) != size, "TeamSize")


def canonical_teams(rows: DataFrame, team: str, member: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Teams of exactly ``size`` different members as sorted arrays, and the others with a reason.

    Sizes are counted before members are gathered, so an oversized team is never collected.
    """
    counts = rows.groupBy(team, member).agg(F.count("*").alias("_n")).groupBy(team).agg(
        F.max("_n").alias("_most"), F.count("*").alias("_members"))
    reason = F.when(F.col("_most") > 1, "DuplicateMember").when(F.col("_members") != size, "TeamSize")
    judged = counts.select(team, reason.alias("reason"))
    good = rows.join(judged.where("reason IS NULL").select(team), team, "left_semi").groupBy(team).agg(
        F.sort_array(F.collect_list(member)).alias("members"))
    return good, judged.where("reason IS NOT NULL")


def parse_team_ids(raw: Column) -> Column:
    """Ids from text separated by commas or blanks."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(raw, ",", " ")), r"\s+"), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("bigint"))


def clause_key(number: Column, base: Column, name: Column) -> Column:
    """Clause group of an entity: number, else base form, else own name."""
    return F.coalesce(F.concat(F.lit("num:"), number.cast("string")),
                      F.concat(F.lit("base:"), F.nullif(clean_name(base), F.lit(""))),
                      F.concat(F.lit("name:"), clean_name(name)))


def expected_moves(name: Column, gen: Column, n_options: Column,
                   exceptions: Mapping[tuple[str, int], int] = SMALL_SETS) -> Column:
    """Moves a full set has: an exception, else at most four of the known options, else four.
    Generations from 5 on also use the exceptions of generation 4."""
    table = F.create_map(*[F.lit(x) for (n, g), v in exceptions.items() for x in (f"{n}:{g}", v)])
    key = lambda g: F.concat_ws(":", name, g.cast("string"))
    return F.coalesce(F.try_element_at(table, key(gen)),
                      F.when(gen >= 5, F.try_element_at(table, key(F.lit(4)))),
                      F.least(F.lit(4), n_options), F.lit(4))


def default_moves(moves: Column, size: Column) -> Column:
    """Moves padded with unknown up to the expected size and with ``<none>`` up to four."""
    unknown = F.array_repeat(F.lit(None).cast("string"), F.greatest(size - F.size(moves), F.lit(0)))
    return F.concat(moves, unknown, F.array_repeat(F.lit(NONE), F.greatest(4 - F.greatest(size, F.size(moves)), F.lit(0))))


def overwrite_field(members: Column, field: str, value: str) -> Column:
    """Members with one field set to a constant."""
    return F.transform(members, lambda m: m.withField(field, F.lit(value)))


def team_name(path: Column) -> Column:
    """Name of a team file from its last three path parts: ``folder-folder-stem``; the stem alone for
    shorter paths."""
    parts = F.split(F.trim(path), "/")
    stem = F.split(F.element_at(parts, -1), r"\.")[0]
    return (F.when(path.isNull() | (path == ""), "UNKNOWN")
            .when(F.size(parts) >= 3, F.concat_ws("-", F.try_element_at(parts, F.lit(-3)),
                                                  F.try_element_at(parts, F.lit(-2)), stem))
            .otherwise(stem))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
