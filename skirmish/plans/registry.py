"""Named observation builders, action spaces, rewards and predictors; users add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions, encoding
from ..operators import matching, rewards, sampling


class Registry:
    """Name -> function, with an error that lists what is known."""

    def __init__(self, what: str):
        self.what = what
        self.items: dict[str, Callable] = {}

    def register(self, name: str):
        def add(fn):
            if name in self.items:
                raise ValueError(f"{self.what} {name} is registered already")
            self.items[name] = fn
            return fn
        return add

    def get(self, name: str) -> Callable:
        if name not in self.items:
            raise KeyError(f"unknown {self.what} {name}; known: {sorted(self.items)}")
        return self.items[name]

    def names(self) -> list[str]:
        return sorted(self.items)


OBSERVATIONS = Registry("observation builder")   # DataFrame -> DataFrame with ``text``
ACTIONS = Registry("action space")               # index Column -> index Column
REWARDS = Registry("reward")                     # (previous state, state) Columns -> Column
PREDICTORS = Registry("predictor")               # (members DataFrame, usage options DataFrame) -> DataFrame


@OBSERVATIONS.register("Default")
def default_observation(steps: DataFrame) -> DataFrame:
    """Fixed-order text.  Needs fmt, forced_switch and the word arrays player, opponent, conditions,
    player_prev, foe_prev, and arrays of word arrays moves, switches."""
    return steps.withColumn("text", encoding.observation_text(
        F.col("fmt"), F.col("forced_switch"), F.col("player"), F.col("moves"), F.col("switches"), F.col("opponent"),
        F.col("conditions"), F.col("player_prev"), F.col("foe_prev")))


@OBSERVATIONS.register("TeamPreview")
def preview_observation(steps: DataFrame) -> DataFrame:
    """The default text followed by the previewed opponent names, sorted and padded to six."""
    shown = encoding.pad_words(F.slice(F.sort_array("preview"), 1, 6), 6)
    return default_observation(steps).withColumn("text", F.concat_ws(" ", "text", F.array_join(shown, " ")))


@OBSERVATIONS.register("Grouped")
def grouped_observation(steps: DataFrame) -> DataFrame:
    """Global words apart from entity words: format, choice, conditions, previous moves, revealed and previewed
    names.  Needs ``seen`` (names revealed so far) and ``preview``."""
    misc = F.concat(
        F.array(F.concat(F.lit("<"), "fmt", F.lit(">")), F.when(F.col("forced_switch"), "<forcedswitch>").otherwise("<anychoice>")),
        F.col("conditions"), F.col("player_prev"), F.col("foe_prev"),
        encoding.pad_words(F.slice(F.sort_array("seen"), 1, 6), 6), encoding.pad_words(F.slice(F.sort_array("preview"), 1, 6), 6))
    return steps.withColumn("text_misc", F.array_join(misc, " ")).withColumn(
        "text_active", F.array_join("player", " ")).withColumn("text_opponent", F.array_join("opponent", " "))


@ACTIONS.register("Default")
def default_actions(index: Column) -> Column:
    return index


@ACTIONS.register("Minimal")
def minimal_actions(index: Column) -> Column:
    return actions.without_tera(index)


@REWARDS.register("Shaped")
def shaped(prev: Column, cur: Column) -> Column:
    return rewards.transition_reward(prev, cur, rewards.SHAPED)


@REWARDS.register("Aggressive")
def aggressive(prev: Column, cur: Column) -> Column:
    return rewards.transition_reward(prev, cur, rewards.AGGRESSIVE)


@REWARDS.register("Binary")
def binary(prev: Column, cur: Column) -> Column:
    return rewards.transition_reward(prev, cur, rewards.TERMINAL)


@PREDICTORS.register("none")
def no_prediction(members: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Unknown facts stay null."""
    return members


@PREDICTORS.register("usage")
def usage_prediction(members: DataFrame, options: DataFrame, seed: str = "usage") -> DataFrame:
    """Gaps filled by draws from usage statistics (columns team_id, slot, entity, item, ability, moves)."""
    return sampling.complete_members(members, ["team_id", "slot"], "entity", options,
                                     {"item": "items", "ability": "abilities"}, "moves", seed)


@PREDICTORS.register("replay")
def replay_prediction(members: DataFrame, weighted: DataFrame) -> DataFrame:
    """Gaps filled from the heaviest known record that the member fits (``weighted`` from leaf_weights on
    entity, item, ability, moves)."""
    keys, fields = ["entity"], ["item", "ability"]
    known = members.withColumn("pattern", matching.pattern([F.col("entity")], [F.col(f) for f in fields], F.col("moves")))
    best = matching.best_candidates(known.select("pattern", *keys, *fields, "moves").dropDuplicates(["pattern"]), weighted, keys, fields, "moves", 1)
    full = best.join(weighted.select(F.col("pattern").alias("candidate"), *[F.col(c).alias(f"_p_{c}") for c in [*fields, "moves"]]), "candidate")
    rows = known.join(full.drop("candidate", "weight", "place"), "pattern", "left")
    from ..functions.records import gap_fill_moves
    none = F.array().cast("array<string>")
    return rows.withColumns({**{f: F.coalesce(f, f"_p_{f}") for f in fields},
                             "moves": gap_fill_moves(F.col("moves"), F.coalesce("_p_moves", none))}).drop(
        "pattern", "_p_item", "_p_ability", "_p_moves")
