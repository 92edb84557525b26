"""Rewards of a transition between two state structs.

A state struct has ``own`` and ``foe`` (base, hp, status), ``bench`` (array of
the same), ``n_switches``, ``foes_left``, ``won`` and ``lost``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RewardWeights:
    hp: float = 1.0
    status: float = 0.5
    knockout: float = 1.0
    win: float = 100.0
    loss: float = 100.0


SHAPED = RewardWeights()
AGGRESSIVE = RewardWeights(status=0.0, knockout=2.0, win=200.0, loss=0.0)
TERMINAL = RewardWeights(hp=0.0, status=0.0, knockout=0.0)


def _afflicted(now: Column, before: Column) -> Column:
    return ((now != "nostatus") & (before == "nostatus")).cast("double")


def transition_reward(prev: Column, cur: Column, w: RewardWeights = SHAPED) -> Column:
    """Weighted sum of damage, own recovery, status, knock-outs and outcome.

    The own active entity is looked up by base name among the previous active
    and bench; without a match its hp and status terms are zero.
    """
    known = F.concat(F.array(prev["own"]), prev["bench"])
    before = F.try_element_at(F.filter(known, lambda m: m["base"] == cur["own"]["base"]), F.lit(1))
    gain = F.coalesce(cur["own"]["hp"] - before["hp"], F.lit(0.0))
    taken = F.coalesce(_afflicted(cur["own"]["status"], before["status"]), F.lit(0.0))
    same_foe = cur["foe"]["base"] == prev["foe"]["base"]
    damage = F.when(same_foe, prev["foe"]["hp"] - cur["foe"]["hp"]).otherwise(0.0)
    given = F.when(same_foe, _afflicted(cur["foe"]["status"], prev["foe"]["status"])).otherwise(0.0)
    lost_member = (prev["n_switches"] > cur["n_switches"]).cast("double")
    removed = (prev["foes_left"] > cur["foes_left"]).cast("double")
    outcome = F.when(cur["won"], w.win).when(cur["lost"], -w.loss).otherwise(0.0)
    return w.hp * (damage + gain) + w.status * (given - taken) + w.knockout * (removed - lost_member) + outcome
