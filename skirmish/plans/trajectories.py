"""From log messages to point-of-view steps, and from steps to training samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import actions
from ..functions import text as tx
from ..operators import rewards, sampling, windows
from ..operators.events import arg, message_columns
from ..session import materialise
from ..operators.ordered import neighbours, running


def replay_steps(log: DataFrame, battle: str, seg: str, order: Sequence[str]) -> DataFrame:
    """Two rows per battle and turn: what each side knows at the end of the turn and what it does next.

    The log has (battle, seg, order, type, args).  State columns are carried forward over messages, the last
    message of a turn gives the turn's state, and the action of a state is the first one of the next turn.
    """
    key = [battle]
    turned = windows.turn_numbers(log, key, seg, order, F.col("type") == "turn", arg(0).try_cast("int"))
    msg = message_columns(turned)
    one, down = {}, {}
    for side in ("p1", "p2"):
        mine = F.col("slot_side") == side
        one[f"active_{side}"] = ("last", F.when(mine & F.col("switched_to").isNotNull(), tx.slot_name(arg(0))))
        hp = F.coalesce("hp", F.when(F.col("switched_to").isNotNull(), tx.hp_fraction(arg(2))))
        one[f"hp_{side}"] = ("last", F.when(mine, hp))
        down[f"down_{side}"] = F.when(mine, F.col("fainted"))
    one["weather_now"] = ("last", F.when(F.col("type") == "-weather", F.when(F.col("weather") == "none", "noweather").otherwise(
        tx.clean_letters(F.col("weather")))))
    filled = windows.distinct_so_far(materialise(running(msg, key, seg, order, one), "replay-messages"), key, seg, order, down)
    at = F.struct(*order)
    used = F.when(F.col("type") == "move", F.concat(F.lit("move:"), tx.move_id(F.col("move")))).when(
        F.col("type") == "switch", F.concat(F.lit("switch:"), tx.slot_name(arg(0))))
    did = lambda side: F.min_by(used, F.when(used.isNotNull() & (F.col("slot_side") == side), at)).alias(f"did_{side}")
    state = [F.max_by(c, at).alias(c) for c in one]
    left = [(6 - F.max(f"down_{s}")).cast("int").alias(f"left_{s}") for s in ("p1", "p2")]
    turns = filled.groupBy(battle, "turn").agg(*state, *left, did("p1"), did("p2"))
    acted = neighbours(turns.withColumn("_tseg", F.floor(F.col("turn") / 1024)), key, "_tseg", ["turn"],
                       lead={"next_p1": F.col("did_p1"), "next_p2": F.col("did_p2")})
    names = ["active", "hp", "left", "next"]
    both = windows.both_sides(acted, [f"{n}_p1" for n in names], [f"{n}_p2" for n in names],
                              ["own", "own_hp", "own_left", "action"], ["foe", "foe_hp", "foe_left", "_foe_action"])
    return both.select(battle, "pov", "turn", "own", F.coalesce("own_hp", F.lit(1.0)).alias("own_hp"), "own_left", "foe",
                       F.coalesce("foe_hp", F.lit(1.0)).alias("foe_hp"), "foe_left",
                       F.coalesce("weather_now", F.lit("noweather")).alias("weather"), F.coalesce("action", F.lit("hidden")).alias("action"))


def training_samples(steps: DataFrame, battle: str, seg: str, order: Sequence[str], state: str, action: str,
                     weights: rewards.RewardWeights, test_fraction: float, seed: str) -> DataFrame:
    """Transitions with reward, done flag, legal actions and split; battles never straddle a split.

    ``steps`` also has forced_switch, can_tera, n_moves and n_switches.
    """
    nxt = neighbours(steps, [battle], seg, order, lead={"_next": F.col(state), "_more": F.lit(True)})
    more = neighbours(nxt, [battle], seg, order, lead={"_then": F.col("_more")})
    rows = more.where("_more").withColumn("reward", rewards.transition_reward(F.col(state), F.col("_next"), weights)).withColumn(
        "done", F.col("_then").isNull()).withColumn("missing", actions.is_missing(F.col(action))).withColumn(
        "legal", actions.legal_actions(F.col("forced_switch"), F.col("can_tera"), F.col("n_moves"), F.col("n_switches")))
    split = sampling.train_test_split(steps.select(battle).distinct(), [battle], test_fraction, seed)
    return rows.join(split, battle).drop("_next", "_more", "_then")
