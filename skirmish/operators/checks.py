"""Quality checks: offending rows with a reason, ready for a quarantine table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import legal_actions
from ..functions.text import clean_name
from .ordered import neighbours, running

# How servers in different languages announce the clause.
SPECIES_CLAUSE_MARKERS = ("species clause", "especie", "espèce", "artenklausel", "soortclausule", "specie",
                          "物种", "物種", "種族", "종족")


def unfinished(lines: DataFrame, battle: str = "battle_id", min_turns: int = 5) -> DataFrame:
    """Battles without an outcome or with too few turns."""
    t = F.col("type")
    rows = lines.groupBy(battle).agg(F.max(t.isin("win", "tie").cast("int")).alias("_done"),
                                     F.count(F.when(t == "turn", 1)).alias("turns"))
    return rows.where((F.col("_done") == 0) | (F.col("turns") < min_turns)).select(
        battle, "turns", F.lit("Unfinished").alias("reason"))


def rule_violations(headers: DataFrame, battle: str = "battle_id", rules: str = "rules") -> DataFrame:
    """Battles with a forbidden mod or without a declared species clause."""
    modded = F.exists(rules, lambda r: r.startswith("Scalemons Mod"))
    declared = F.exists(rules, lambda r: F.lower(r).rlike("|".join(SPECIES_CLAUSE_MARKERS)))
    return headers.select(battle, F.when(modded, "Scalemons").when(~declared, "NoSpeciesClause").alias("reason")).where(
        F.col("reason").isNotNull())


def duplicate_names(members: DataFrame, team: Sequence[str], name: str) -> DataFrame:
    """Names that occur more than once in a team and turn."""
    return members.groupBy(*team, name).agg(F.count("*").alias("n")).where("n > 1").withColumn(
        "reason", F.lit("DuplicateName"))


def side_changes(members: DataFrame, battle: Sequence[str], entity: str, side: str) -> DataFrame:
    """Entities seen on more than one side."""
    return members.groupBy(*battle, entity).agg(F.min(side).alias("_a"), F.max(side).alias("_b")).where(
        "_a <> _b").select(*battle, entity, F.lit("SideChanged").alias("reason"))


def vanished(members: DataFrame, battle: Sequence[str], entity: str, turn: str) -> DataFrame:
    """Entities absent from a turn between their first and last."""
    turns = members.select(*battle, entity, turn).distinct().groupBy(*battle, entity).agg(
        F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count("*").alias("turns"))
    return turns.where(F.col("turns") != F.col("last_turn") - F.col("first_turn") + 1).withColumn(
        "reason", F.lit("Vanished"))


def forgotten(rows: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], fact: Column) -> DataFrame:
    """Rows where a fact that was known is unknown again."""
    known = fact.isNotNull().cast("int")
    out = running(rows.withColumn("_k", known), key, seg, order, {"_ever": ("max", F.col("_k"))})
    return out.where("_ever = 1 AND _k = 0").drop("_k", "_ever").withColumn("reason", F.lit("FactLost"))


def misspelled(rows: DataFrame, value: Column) -> DataFrame:
    """Values equal to their cleaned form: probably lower-cased logs."""
    return rows.where(value == clean_name(value)).withColumn("reason", F.lit("Spelling"))


def tera_regained(turns: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], can_tera: Column,
                  gen: Column) -> DataFrame:
    """Rows where the once-per-battle boost is available in a wrong generation or again after its loss."""
    prev = neighbours(turns.withColumn("_can", can_tera), key, seg, order, lag={"_before": F.col("_can")})
    reason = F.when((gen != 9) & F.col("_can"), "TeraOutsideGen9").when(
        ~F.col("_before") & F.col("_can"), "TeraRegained")
    return prev.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_can", "_before")


def unfilled(members: DataFrame, gen: Column, name: Column, moves: Column, item: Column, ability: Column,
             tera: Column, max_moves: int = 4) -> DataFrame:
    """Own members with a fact missing that their generation requires."""
    reason = (F.when(name.isNull(), "MissingName")
              .when(F.size(moves) > max_moves, "TooManyMoves")
              .when(F.size(moves) == 0, "MissingMoves")
              .when((gen >= 2) & item.isNull(), "MissingItem")
              .when((gen >= 3) & ability.isNull(), "MissingAbility")
              .when((gen == 9) & tera.isNull(), "MissingTera"))
    return members.withColumn("reason", reason).where(F.col("reason").isNotNull())


def illegal_actions(steps: DataFrame, action: Column, name: Column, is_switch: Column, forced: Column,
                    can_tera: Column, gen: Column, n_moves: Column, n_switches: Column) -> DataFrame:
    """Steps whose action index breaks a rule of its state; hidden actions pass."""
    legal = legal_actions(forced, can_tera, n_moves, n_switches)
    reason = (F.when((action > 13) | (action < -1), "OutOfBounds")
              .when((action >= 9) & (gen != 9), "TeraOutsideGen9")
              .when(name.isin("Struggle", "Recharge", "Fight") & (action != 0), "NoOpIndex")
              .when(forced & ~is_switch, "ForcedSwitchIgnored")
              .when((action > 9) & ~can_tera, "TeraUnavailable")
              .when(is_switch & ~action.between(4, 8), "SwitchIndex")
              .when(~is_switch & action.between(4, 8), "MoveIndex")
              .when(~F.array_contains(legal, action), "NotLegal"))
    return steps.withColumn("reason", F.when(action != -1, reason)).where(F.col("reason").isNotNull())


def repeated_tera(steps: DataFrame, battle: Sequence[str], action: Column) -> DataFrame:
    """Battles with more than one boosted move."""
    return steps.groupBy(*battle).agg(F.count(F.when(action >= 9, 1)).alias("uses")).where("uses > 1").withColumn(
        "reason", F.lit("MultipleTera"))


def unanswered_switches(rows: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], forced: Column,
                        answered: Column) -> DataFrame:
    """Forced switches whose next message of the side is not a switch."""
    nxt = neighbours(rows.withColumn("_forced", forced), key, seg, order, lead={"_answer": answered})
    return nxt.where(F.col("_forced") & ~F.coalesce(F.col("_answer"), F.lit(False))).drop("_forced", "_answer").withColumn(
        "reason", F.lit("SwitchUnanswered"))


def oversized_observations(obs: DataFrame, words: Column, numbers: Column, bench: Column, max_words: int = 336,
                           n_numbers: int = 63, max_bench: int = 5) -> DataFrame:
    reason = (F.when(words > max_words, "TooManyWords").when(numbers != n_numbers, "NumberCount")
              .when(bench > max_bench, "BenchSize"))
    return obs.withColumn("reason", reason).where(F.col("reason").isNotNull())
