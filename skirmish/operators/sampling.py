"""Seeded splits, draws, mixtures, masks and completions.

All randomness comes from digests of seed and key, so a rerun or a lost task
gives the same rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.hashing import draw_key, fast_uniform, shuffle_segment, uniform
from ..session import materialise, spread
from .ordered import ranked, top_per
from .pairs import unordered_pairs

# The draw functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# -- splits ----------------------------------------------------------------------

def _shuffled(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int | str) -> DataFrame:
    """Place of each row in a seeded shuffle of its group, and the group's size."""
    rows = df.withColumn("_draw", draw_key(seed, *key))
    return ranked(rows, by, shuffle_segment(F.col("_draw")), ["_draw", *key], "_place", total="_n").drop("_draw")


def train_test_split(df: DataFrame, key: Sequence[str], test_fraction: float, seed: int | str) -> DataFrame:
    """Adds ``split``: exactly int(n * (1 - f)) rows are train, stable for a seed."""
    rows = _shuffled(df, [], key, seed)
    cut = F.floor(F.col("_n") * (1 - test_fraction))
    return rows.withColumn("split", F.when(F.col("_place") <= cut, "train").otherwise("test")).drop("_place", "_n")


def group_split(df: DataFrame, group: Sequence[str], key: Sequence[str], val_fraction: float, seed: int | str) -> DataFrame:
    """Adds ``split`` per group: int(n * r) rows are validation."""
    rows = _shuffled(df, group, key, seed)
    return rows.withColumn("split", F.when(F.col("_place") <= F.floor(F.col("_n") * val_fraction), "val").otherwise(
        "train")).drop("_place", "_n")


def split_originals(df: DataFrame, key: Sequence[str], val_fraction: float, seed: int | str) -> DataFrame:
    """Adds ``split`` before augmentation; the validation size is rounded half to even."""
    rows = _shuffled(df, [], key, seed)
    return rows.withColumn("split", F.when(F.col("_place") <= F.bround(F.col("_n") * val_fraction), "val").otherwise(
        "train")).drop("_place", "_n")


# -- mixtures ----------------------------------------------------------------------

def flatten_mixture(name: str, configs: Mapping[str, Mapping]) -> list[dict]:
    """Sources of a nested mixture config with their weights.

    A config has ``sources`` (name -> weight) and may have ``previous`` and ``prev_weight``: the previous
    entries are scaled to ``prev_weight`` in total and this config's sources are new.
    """
    config = configs[name]
    nested = "previous" in config
    out = []
    if nested:
        before = flatten_mixture(config["previous"], configs)
        total = sum(e["weight"] for e in before)
        if total > 0:
            out = [{"source": e["source"], "weight": config["prev_weight"] * e["weight"] / total, "is_new": False}
                   for e in before]
    out += [{"source": s, "weight": float(w), "is_new": nested} for s, w in config.get("sources", {}).items()]
    return out


def mixture_table(spark: SparkSession, entries: Sequence[Mapping], human: str | None = None,
                  human_weight: float = 0.0) -> DataFrame:
    """Config entries as a small table with normalised weights, the human share added when given."""
    rows = [(e["source"], float(e["weight"]), bool(e["is_new"])) for e in entries]
    if human:
        rows.append((human, float(human_weight), False))
    total = sum(r[1] for r in rows)
    return spark.createDataFrame([(s, w, n, w / total if total else 0.0) for s, w, n in rows],
                                 "source string, weight double, is_new boolean, normalised double")


def row_weights(files: DataFrame, source: str, mixture: DataFrame) -> DataFrame:
    """Sampling weight of each file: its source's share divided by the source's files; 0 for sources that the
    mixture does not list."""
    sizes = files.groupBy(source).agg(F.count("*").alias("_n"))
    per_file = sizes.join(mixture.select(source, "normalised"), source, "left").select(
        source, (F.coalesce("normalised", F.lit(0.0)) / F.col("_n")).alias("row_weight"))
    return files.join(per_file, source)


def annealed_weights(mixture: DataFrame, epochs: int, ramp: int, human: str) -> DataFrame:
    """Weight of each source at each epoch: clamp(w0 + (e + 1) (w1 - w0) / ramp).

    New sources start at 0 and old ones start inflated to fill the gap; the human share is constant.
    """
    is_human = F.col("source") == human
    w = F.col("normalised")
    old = mixture.agg(F.sum(F.when(~F.col("is_new") & ~is_human, w))).scalar()
    new = mixture.agg(F.coalesce(F.sum(F.when(F.col("is_new"), w)), F.lit(0.0))).scalar()
    start = F.when(is_human, w).when(F.col("is_new"), 0.0).otherwise(w * (1 + new / old))
    grid = mixture.withColumn("_w0", start).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    raw = F.col("_w0") + (F.col("epoch") + 1) * (w - F.col("_w0")) / ramp
    value = F.greatest(F.least(raw, F.greatest("_w0", w)), F.least("_w0", w))
    return grid.select("source", "epoch", value.alias("weight"))


# -- draws ---------------------------------------------------------------------------

def race(seed: int | str, weight: Column, *key: Column | str) -> Column:
    """Arrival time of an exponential race: the n smallest are a weighted draw without replacement."""
    return -F.ln(uniform(seed, *key)) / weight


def weighted_draw(df: DataFrame, by: Sequence[str], key: str, weight: str, n: int, seed: int | str,
                  skip: Sequence[str] = ("Other", "Nothing")) -> DataFrame:
    """``n`` keys per group drawn by weight without replacement."""
    rows = df.where((F.col(weight) > 0) & ~F.col(key).cast("string").isin(*skip))
    rows = rows.withColumn("_t", race(seed, F.col(weight), *by, key))
    return top_per(rows, by, ["_t", key], n, "pick").drop("_t")


def draw_from_top(df: DataFrame, by: Sequence[str], key: str, weight: str, k: int, seed: int | str) -> DataFrame:
    """One key per group drawn from its ``k`` heaviest."""
    best = top_per(df, by, [F.desc(weight), key], k, "place")
    rows = best.withColumn("_t", race(seed, F.col(weight), *by, key))
    return top_per(rows, by, ["_t", key], 1, "_pick").drop("_t", "_pick")


def group_quotas(df: DataFrame, group: str, key: Sequence[str], n: int, seed: int | str,
                 weights: DataFrame | None = None, weight: str = "weight") -> DataFrame:
    """About ``n`` rows split over groups by weight, or by natural size, in seeded order."""
    rows = _shuffled(df, [group], key, seed)
    if weights is None:
        share = df.groupBy(group).agg(F.count("*").alias("_w"))
    else:
        share = weights.select(group, F.col(weight).alias("_w"))
    quota = share.select(group, F.round(n * F.col("_w") / share.agg(F.sum("_w")).scalar()).alias("_q"))
    return rows.join(quota, group).where(F.col("_place") <= F.col("_q")).drop("_place", "_n", "_q")


def _first(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, n)


def random_teams(samples: DataFrame, key: str, pool: DataFrame, member: str, clause: str, size: int,
                 seed: int | str) -> DataFrame:
    """One random legal team per row of ``samples``: ``size`` clause groups, one member of each."""
    return samples.join(drawn_teams(samples, key, pool, member, clause, size, seed), key)


def drawn_teams(samples: DataFrame, key: str, pool: DataFrame, member: str, clause: str, size: int,
                seed: int | str) -> DataFrame:
    """key, team: the random team of each key of ``samples``.

    The clauses travel with each row, and the drawn place in a clause is looked up in the ranked pool: no row
    holds the pool.
    """
    ranks = Window.partitionBy(clause).orderBy(member)
    placed = pool.select(member, clause).distinct().select(
        F.col(member).alias("_m"), F.col(clause).cast("string").alias("_c"), (F.row_number().over(ranks) - 1).alias("_at"))
    listed = placed.groupBy("_c").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col("_c").alias("g"), "n"))))
    id_ = F.col(key).cast("string")
    keyed = F.transform("_pool", lambda p: F.struct(
        F.md5(F.concat_ws(":", F.lit(f"{seed}g"), id_, p["g"])).alias("h"), p.alias("p")))
    drawn = (spread(samples, key).withColumn("_pool", listed.scalar())
             .select(key, F.explode(_first(F.sort_array(keyed), size)).alias("x"))
             .select(key, F.col("x.p.g").alias("_c"), F.col("x.p.n").alias("_n")))
    at = F.floor(uniform(f"{seed}m", F.col(key), F.col("_c")) * F.col("_n")).cast("int")
    at = F.coalesce(at, F.lit(-1))  # never null, so that the join does not work it out a second time to test that
    return drawn.withColumn("_at", at).join(placed, ["_c", "_at"]).groupBy(key).agg(F.sort_array(F.collect_list("_m")).alias("team"))


def uncertain_pairs(bank: DataFrame, team: str, score: str, n: int, seed: int | str, uniform_mix: float = 0.25,
                    floor: float = 1e-6) -> DataFrame:
    """``n`` pairs of candidate teams, drawn by uncertainty max(floor, 4p(1-p)); a seeded share is drawn evenly."""
    item = bank.select(F.struct(F.col(team).alias("id"), F.col(score).alias("s")).alias("item"))
    pairs = unordered_pairs(item, [], "item").select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"), (1 / (1 + F.exp(F.col("b.s") - F.col("a.s")))).alias("p"))
    p = F.least(F.greatest(F.when(F.isnan("p"), 0.5).otherwise(F.col("p")), F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = pairs.withColumn("weight", F.greatest(4 * p * (1 - p), F.lit(floor)))
    even = int(round(n * uniform_mix))
    by_weight = rows.withColumn("_t", race(f"{seed}w", F.col("weight"), "a", "b")).orderBy("_t", "a", "b").limit(n - even)
    by_chance = rows.withColumn("_t", uniform(f"{seed}u", "a", "b")).orderBy("_t", "a", "b").limit(even)
    return by_weight.withColumn("mode", F.lit("uncertain")).unionByName(
        by_chance.withColumn("mode", F.lit("uniform"))).drop("_t")


# -- posterior draws -------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values from counters."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _u(state: np.ndarray, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = _mix(state ^ _mix(np.full_like(state, stream)))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _gamma(shape: np.ndarray, state: np.ndarray, salt: int) -> np.ndarray:
    """Gamma draws for shapes >= 1 by squeeze-free rejection, one counter stream per key and try."""
    d = shape - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    out = np.zeros_like(shape)
    todo = np.ones(len(shape), dtype=bool)
    step = 0
    while todo.any():
        s, base = state[todo], salt + 3 * step
        x = np.sqrt(-2 * np.log(_u(s, base))) * np.cos(2 * math.pi * _u(s, base + 1))
        v = (1 + c[todo] * x) ** 3
        good = v > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            good &= np.log(_u(s, base + 2)) < 0.5 * x * x + d[todo] * (1 - v + np.log(v))
        at = np.flatnonzero(todo)[good]
        out[at] = d[at] * v[good]
        todo[at] = False
        step += 1
    return out


@pandas_udf(DoubleType())
def beta_draw(alpha: pd.Series, beta: pd.Series, state: pd.Series) -> pd.Series:
    """Beta draws fixed by their 64-bit state, the same in any partitioning."""
    s = state.to_numpy().astype(np.int64).view(np.uint64)
    a, b = alpha.to_numpy(float), beta.to_numpy(float)
    x, y = _gamma(a, s, 1_000_003), _gamma(b, s, 2_000_003)
    return pd.Series(x / (x + y))


def posterior_draws(posteriors: DataFrame, key: str, seed: int | str, rounds: int = 1) -> DataFrame:
    """One Beta draw per key and round (needs alpha and beta of at least 1): round, key, draw."""
    rows = posteriors.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    state = F.xxhash64(F.lit(str(seed)), F.col(key).cast("string"), "round")
    return rows.select("round", key, beta_draw("alpha", "beta", state).alias("draw"))


def candidates(teams: DataFrame, team: str, rounds: int, pool_size: int, seed: int | str) -> DataFrame:
    """round, team, place: up to ``pool_size`` teams per round, drawn by place in a seeded order of all teams.

    Only the drawn places meet the teams, never all teams all rounds.
    """
    keyed = teams.select(team).distinct().withColumn("_h", draw_key(seed, team))
    listed = ranked(keyed, [], shuffle_segment(F.col("_h")), ["_h", team], "_at").select(team, "_at")
    slots = keyed.agg(F.count("*").alias("_n")).where("_n > 0").select(
        "_n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).select(
        "_n", "round", F.explode(F.sequence(F.lit(0), F.lit(pool_size - 1))).alias("place"))
    drawn = slots.withColumn("_at", F.floor(uniform(f"{seed}c", "round", "place") * F.col("_n")) + 1)
    return drawn.join(listed, "_at").groupBy("round", team).agg(F.min("place").alias("place"))


def thompson_scores(chosen: DataFrame, team: str, team_draws: DataFrame, members: DataFrame, member_draws: DataFrame,
                    moves: DataFrame, move_draws: DataFrame, weights: tuple[float, float, float] = (0.35, 0.40, 0.25)) -> DataFrame:
    """Blend of a team's draw with the mean draws of its distinct members and moves; one half where it has none.

    ``chosen`` has round, team and place; ``members`` and ``moves`` are (team, key); draws are (round, key, draw).
    """
    wt, wm, wv = weights

    def mean(rows: DataFrame, draws: DataFrame, name: str) -> DataFrame:
        wanted = chosen.select("round", team).join(rows.distinct(), team)
        return wanted.join(draws, ["round", "key"]).groupBy("round", team).agg(F.avg("draw").alias(name))

    on = ["round", team]
    out = (chosen.join(team_draws.withColumnRenamed("key", team).withColumnRenamed("draw", "_t"), on, "left")
           .join(mean(members, member_draws, "_m"), on, "left").join(mean(moves, move_draws, "_v"), on, "left"))
    half = F.lit(0.5)
    return out.select("round", team, "place", ((wt * F.coalesce("_t", half) + wm * F.coalesce("_m", half) + wv * F.coalesce("_v", half))
                                               / (wt + wm + wv)).alias("score"))


def propose(scores: DataFrame, team: str, score: str, epsilon: float, seed: int | str) -> DataFrame:
    """Chosen team per round: the best of its candidates, or with probability epsilon the first drawn."""
    explore = uniform(f"{seed}e", "round") < epsilon
    best = scores.groupBy("round").agg(F.max_by(team, F.struct(score, F.negate("place"))).alias("_best"),
                                       F.min_by(team, "place").alias("_any"))
    return best.select("round", F.when(explore, F.col("_any")).otherwise(F.col("_best")).alias(team),
                       F.when(explore, "explore_random").otherwise("exploit_thompson").alias("mode"))


# -- masks ----------------------------------------------------------------------------

def masked_fields(key: Sequence[Column | str], known: Column, low: float, high: float, seed: int | str) -> Column:
    """Names of the fields to hide in a record: k of the known ones, k uniform in a share range.

    ``known`` is an array of field names; at least one field is hidden when any is known.
    """
    n = F.size(known)
    least = F.greatest(F.bround(low * n), F.lit(1))
    most = F.greatest(least, F.bround(high * n))
    k = F.least(least + F.floor(uniform(f"{seed}k", *key) * (most - least + 1)), n).cast("int")
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in key]
    order = F.sort_array(F.transform(known, lambda f: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), *parts, f)).alias("h"), f.alias("f"))))
    return F.transform(F.slice(order, F.lit(1), k), lambda x: x["f"])


def curriculum_range(step: int, warmup: int = 20_000, low: float = 0.25, high: float = 1.0) -> tuple[float, float]:
    """Share range of masked fields at a training step, growing from ``low`` to ``high``."""
    progress = min(step / max(warmup, 1), 1.0)
    return 0.0, low + progress * (high - low)


def mask_record(df: DataFrame, key: Sequence[str], fields: Sequence[str], low: float, high: float,
                seed: int | str) -> DataFrame:
    """Null out the chosen fields; ``hidden`` lists them."""
    known = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    rows = df.withColumn("hidden", F.when(F.size(known) > 0, masked_fields(key, known, low, high, seed)).otherwise(
        F.array().cast("array<string>")))
    return rows.withColumns({f: F.when(~F.array_contains("hidden", f), F.col(f)) for f in fields})


def mask_names(df: DataFrame, team: Sequence[str], member: str, name: str, seed: int | str) -> DataFrame:
    """Hide the names of k members of each team, k uniform from 1 to its size."""
    rows = _shuffled(df, team, [*team, member], seed)
    k = 1 + F.floor(uniform(f"{seed}k", *team) * F.col("_n"))
    return rows.withColumn(name, F.when(F.col("_place") > k, F.col(name))).drop("_place", "_n")


def drop_tokens(tokens: Column, key: Sequence[Column | str], rate: float, unknown: Column, seed: int | str) -> Column:
    """Replace a random share of tokens by the unknown token."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in key]
    limit = int(rate * 2 ** 32)
    bits = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts, i.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.transform(tokens, lambda t, i: F.when(bits(i) < limit, unknown).otherwise(t))


# -- usage-based completion -------------------------------------------------------------

def option_lists(usage: DataFrame, entity: str, skip: Sequence[str] = ("Other", "Nothing")) -> DataFrame:
    """Options of each entity and field as one array of (key, share): one entry per option of one entity."""
    good = usage.where((F.col("share") > 0) & ~F.col("key").isin(*skip))
    return good.groupBy(entity, "field").agg(F.sort_array(F.collect_list(F.struct("key", "share"))).alias("options"))


def _timed(options: Column, seed: int | str, *key: Column) -> Column:
    """Options with the arrival times of an exponential race."""
    return F.transform(options, lambda o: F.struct(
        (-F.ln(fast_uniform(seed, *key, o["key"])) / o["share"]).alias("t"), o["key"].alias("k")))


def _arrivals(options: Column, seed: int | str, *key: Column) -> Column:
    """Option keys in the order of a weighted draw without replacement."""
    return F.transform(F.sort_array(_timed(options, seed, *key)), lambda x: x["k"])


def _earliest(options: Column, seed: int | str, *key: Column) -> Column:
    """The first of the arrivals, without putting the others in order."""
    return F.array_min(_timed(options, seed, *key))["k"]


def form_free(name: Column) -> Column:
    """Name without its form suffix."""
    return F.split(name, "-")[0]


def complete_roster(teams: DataFrame, team: str, members: str, teammates: DataFrame, entity: str, size: int,
                    seed: int | str) -> DataFrame:
    """Teams filled up to ``size`` members, one weighted teammate draw per round.

    In each round a seeded member is the starter and its teammates are drawn by usage, skipping every name
    whose form-free part is present; a starter with no options passes the round to the next member.
    ``teammates`` comes from :func:`option_lists`; a team that no member can extend keeps its gaps.
    """
    lists = materialise(teammates.where("field = 'teammates'").select(
        F.col(entity).alias("_starter"), F.transform("options", lambda o: F.struct(
            o["key"].alias("key"), o["share"].alias("share"), form_free(o["key"]).alias("form"))).alias("_o")), "teammates")
    rows = spread(teams, team).withColumn("_id", F.col(team).cast("string"))
    for r in range(size * 2 - 2):
        at = F.pmod(F.floor(uniform(f"{seed}s{r}", team) * F.size(members)) + r, F.size(members))
        rows = rows.withColumn("_starter", F.when(F.size(members) < size, F.try_element_at(members, at.cast("int") + 1)))
        rows = rows.withColumn("_have", F.transform(members, form_free)).join(lists, "_starter", "left")
        fresh = F.filter("_o", lambda o: ~F.array_contains("_have", o["form"]))
        pick = _earliest(fresh, f"{seed}t{r}", F.col("_id"))
        rows = rows.withColumn(members, F.concat(F.col(members), F.array_compact(F.array(pick)))).drop("_o", "_starter", "_have")
    return rows.drop("_id")


def complete_moves(known: Column, options: Column, seed: int | str, key: Sequence[Column],
                   conflicts: Mapping[str, Sequence[str]], size: int = 4) -> Column:
    """Known moves plus weighted draws up to ``size``; an option that conflicts with a taken move is removed.

    At most one option of a family named ``Hidden Power`` is kept.
    """
    table = F.create_map(*[x for k, v in conflicts.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]) if conflicts else None
    family = lambda m: m.startswith("Hidden Power")

    def blocked(acc: Column, m: Column) -> Column:
        bad = F.array_contains(acc, m) | (family(m) & F.exists(acc, family))
        if table is not None:
            bad = bad | F.coalesce(F.arrays_overlap(F.try_element_at(table, m), acc), F.lit(False))
        return bad

    start = F.array_compact(known)
    return F.aggregate(_arrivals(options, seed, *key), start, lambda acc, m: F.when(
        (F.size(acc) >= size) | blocked(acc, m), acc).otherwise(F.concat(acc, F.array(m))))


def complete_field(known: Column, options: Column, seed: int | str, key: Sequence[Column]) -> Column:
    """Known value, else one weighted draw."""
    return F.coalesce(known, _earliest(options, seed, *key))


def complete_members(members: DataFrame, key: Sequence[str], entity: str, options: DataFrame, fields: Mapping[str, str],
                     moves: str, seed: int | str, conflicts: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Gaps of each member filled by usage draws.  ``fields`` maps a column to its usage field.

    The options are written once, so that their size is known when they are joined and a few of them don't shuffle the members.
    """
    wide = options.groupBy(entity).agg(*[
        F.first(F.when(F.col("field") == f, F.col("options")), ignorenulls=True).alias(f"_o_{f}")
        for f in [*fields.values(), "moves"]])
    ids = {f"_k{i}": F.col(k).cast("string") for i, k in enumerate(key)}
    rows = spread(members, *key).withColumns(ids).join(materialise(wide, "options"), entity, "left")
    parts = [F.col(i) for i in ids]
    empty = F.array().cast("array<struct<key:string,share:double>>")
    opt = lambda f: F.coalesce(F.col(f"_o_{f}"), empty)
    rows = rows.withColumns({c: complete_field(F.col(c), opt(f), f"{seed}{f}", parts) for c, f in fields.items()})
    rows = rows.withColumn(moves, complete_moves(F.col(moves), opt("moves"), f"{seed}moves", parts, conflicts or {}))
    return rows.drop(*ids, *[f"_o_{f}" for f in [*fields.values(), "moves"]])
