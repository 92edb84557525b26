"""Curated team sets: select, complete, score, keep the complete enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, filters
from ..session import materialise
from .registry import PREDICTORS


def build_team_set(members: DataFrame, meta: DataFrame, options: DataFrame, selection: filters.BattleFilter,
                   predictor: str, min_score: float | None) -> DataFrame:
    """Members of the selected teams with gaps filled, and the share of facts known after completion.

    ``members`` has team_id, slot, gen, entity, item, ability, tera_type, moves; ``meta`` has team_id, result,
    rating, played.  Teams whose completed score is under ``min_score`` go.
    """
    chosen = meta.where(selection.condition(F.col("result"), F.col("rating"), F.col("played"))).select("team_id")
    rows = members.join(chosen, "team_id", "left_semi")
    filled = materialise(PREDICTORS.get(predictor)(rows, options), "team-set")
    known, possible = aggregates.completeness(F.col("gen"), F.col("entity"), F.col("moves"), F.col("item"),
                                              F.col("ability"), F.col("tera_type"))
    scores = filled.groupBy("team_id").agg((F.sum(known) / F.sum(possible)).alias("score"))
    kept = filters.score_floor(scores, F.col("score"), min_score)
    return filled.join(kept, "team_id")
