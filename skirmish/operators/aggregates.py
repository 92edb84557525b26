"""Statistics on usage, results, corpora and predictions.

All groupings aggregate partially before the shuffle; nothing collects an
unbounded group into one row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import range_segments, ranked, running, top_per
from .pairs import unordered_pairs


# -- usage -----------------------------------------------------------------------

#: Members of a team that are paired in one row, and rows of one task.
TEAM, TASK_ROWS = 64, 200_000


def merge_usage(usage: DataFrame, counts: DataFrame, unit: Sequence[str], by: Sequence[str], parts: int | None = None) -> DataFrame:
    """Count-weighted merge of distributions.

    ``usage`` has unit + field, key, share and ``counts`` has unit + n, one row per
    unit and entity.  A unit without a key adds nothing to the numerator but its
    full count to the denominator.  ``usage`` may bring its unit's n along, which saves a join;
    ``parts`` is the number of tasks.
    """
    total = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    counted = usage if "n" in usage.columns else usage.join(counts, [*unit])
    weighted = counted.repartition(*([parts] if parts else []), *by).groupBy(*by, "field", "key").agg(F.sum(F.col("share") * F.col("n")).alias("_w"))
    return weighted.join(total, [*by]).select(
        *by, "field", "key", F.try_divide(F.col("_w"), F.col("n")).alias("share"), "n")


def usage_ranking(counts: DataFrame, by: Sequence[str], entity: str, n: str = "n") -> DataFrame:
    """Usage share and place of each entity."""
    totals = counts.groupBy(*by).agg(F.sum(n).alias("_all"))
    placed = ranked(counts, by, -F.col(n), [entity], "place")
    return placed.join(totals, [*by]).withColumn("share", F.col(n) / F.col("_all")).drop("_all")


def completeness(gen: Column, name: Column, moves: Column, item: Column, ability: Column,
                 tera: Column) -> tuple[Column, Column]:
    """Known and possible relevant fields of a member; which ones count depends on the generation.
    The score of a member or team is the sum of the first over the sum of the second."""
    one = lambda applies, c: F.when(applies & c.isNotNull(), 1).otherwise(0)
    known = (one(gen <= 4, name) + one(gen >= 2, item) + one(gen >= 3, ability) + one(gen == 9, tera)
             + F.size(F.filter(moves, lambda m: m.isNotNull() & (m != "<none>"))))
    possible = (4 + (gen <= 4).cast("int") + (gen >= 2).cast("int") + (gen >= 3).cast("int")
                + (gen == 9).cast("int"))
    return known, possible


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation, extremes and exact quartiles with linear interpolation.

    Quartiles come from running counts of the distinct values, so a value that a third of all rows share is one row;
    the running count goes by segments of equally many distinct values.
    """
    basic = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = running(range_segments(values, *by, value), by, "_seg", [value], {"_upto": ("sum", F.col("_c"))})
    rows = upto.join(basic.select(*by, F.col("n").alias("_n")), [*by])
    quartiles = {"q25": 0.25, "median": 0.5, "q75": 0.75}

    def at(q: float) -> Column:
        """Its two neighbours weighted, each where the running count first reaches its place."""
        pos = (F.col("_n") - 1) * q + 1
        lo, frac = F.floor(pos), pos - F.floor(pos)
        covers = lambda place: (F.col("_upto") - F.col("_c") < place) & (place <= F.col("_upto"))
        weight = F.when(covers(lo), 1 - frac).otherwise(0.0) + F.when(covers(lo + 1), frac).otherwise(0.0)
        return F.sum(F.when(weight > 0, F.col(value) * weight))

    parts = rows.groupBy(*by).agg(*[at(q).alias(n) for n, q in quartiles.items()])
    return basic.join(parts, [*by])


# -- results ---------------------------------------------------------------------

def canonical_result(raw: Column) -> Column:
    """WIN, DRAW, LOSS or UNKNOWN from the spellings that logs use."""
    r = F.upper(F.trim(raw))
    # fixed values: spellings of results
    return (F.when(r.isin("WIN", "WON", "1"), "WIN").when(r.isin("DRAW", "TIE", "0.5"), "DRAW")
            .when(r.isin("LOSS", "LOSE", "LOST", "0"), "LOSS").otherwise("UNKNOWN"))


def win_rates(df: DataFrame, by: Sequence[str], result: Column) -> DataFrame:
    """Games, wins, losses (= games - wins) and win rate."""
    out = df.groupBy(*by).agg(F.count("*").alias("games"), F.count(F.when(result == "WIN", 1)).alias("wins"))
    return out.withColumn("losses", F.col("games") - F.col("wins")).withColumn(
        "win_rate", F.col("wins") / F.col("games"))


def result_summary(df: DataFrame, by: Sequence[str], raw: Column) -> DataFrame:
    """Wins, draws, losses, unknown; the rate counts a draw as one half and leaves unknown out."""
    r = canonical_result(raw)
    n = lambda v: F.count(F.when(r == v, 1))
    out = df.groupBy(*by).agg(n("WIN").alias("wins"), n("DRAW").alias("draws"), n("LOSS").alias("losses"),
                              n("UNKNOWN").alias("unknown"))
    scored = F.col("wins") + F.col("draws") + F.col("losses")
    return out.withColumn("scored", scored).withColumn(
        "win_rate", F.coalesce(F.try_divide(F.col("wins") + 0.5 * F.col("draws"), scored), F.lit(0.0)))


def matchup_record(log: DataFrame, by: Sequence[str], player: str, challenger: str, result: Column) -> DataFrame:
    """Wins of both sides counted from the challenger's rows only, since both sides log."""
    own = log.where(F.col(player) == F.col(challenger))
    return own.groupBy(*by).agg(
        F.count(F.when(result == "WIN", 1)).alias("a_wins"), F.count(F.when(result == "LOSS", 1)).alias("b_wins"),
        F.count("*").alias("total"))


def win_table(pairs: DataFrame, a: str, b: str, a_wins: str, total: str) -> DataFrame:
    """Long win matrix: the other direction is one minus the rate; unplayed pairs are absent."""
    rate = F.try_divide(F.col(a_wins), F.col(total))
    cells = F.array(F.struct(F.col(a).alias("row"), F.col(b).alias("col"), rate.alias("rate")),
                    F.struct(F.col(b).alias("row"), F.col(a).alias("col"), (1 - rate).alias("rate")))
    return pairs.select(F.explode(cells).alias("c")).select("c.row", "c.col", "c.rate")


def win_matrix(cells: DataFrame, policies: Sequence) -> DataFrame:
    """Pivoted win matrix for a known list of policies, null where unplayed."""
    return cells.groupBy("row").pivot("col", list(policies)).agg(F.first("rate"))


def mean_percentages(df: DataFrame, by: Sequence[str], run: str, result: Column) -> DataFrame:
    """Win, loss and tie percent of each run, averaged over runs."""
    share = lambda v: F.avg((result == v).cast("double"))
    runs = df.groupBy(*by, run).agg(share("WIN").alias("w"), share("LOSS").alias("l"), share("DRAW").alias("t"))
    return runs.groupBy(*by).agg((F.avg("w") * 100).alias("win_pct"), (F.avg("l") * 100).alias("loss_pct"),
                                 (F.avg("t") * 100).alias("tie_pct"), F.count("*").alias("runs"))


def throughput(df: DataFrame, agent: Sequence[str], ts: str, failed: Column) -> DataFrame:
    """Battles, failures and battles per hour of activity."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    out = df.groupBy(*agent).agg(F.count("*").alias("battles"), F.count(F.when(failed, 1)).alias("failures"),
                                 ((seconds(F.max(ts)) - seconds(F.min(ts))) / 3600).alias("hours"))
    return out.withColumn("per_hour", F.try_divide(F.col("battles"), F.col("hours")))


# -- corpora ---------------------------------------------------------------------

def key_frequencies(df: DataFrame, corpus: Sequence[str], dims: Mapping[str, Column]) -> DataFrame:
    """Occurrences of each key per dimension; dimensions are array columns, read in one scan."""
    def tagged(dim: str, keys: Column) -> Column:
        return F.transform(keys.cast("array<string>"), lambda k: F.struct(F.lit(dim).alias("dim"), k.alias("key")))

    pairs = F.concat(*[tagged(dim, keys) for dim, keys in dims.items()])
    rows = df.select(*corpus, F.explode(pairs).alias("_p")).where(F.col("_p.key").isNotNull())
    return rows.groupBy(*corpus, F.col("_p.dim").alias("dim"), F.col("_p.key").alias("key")).agg(
        F.count("*").alias("n"))


def presence_curve(freq: DataFrame, teams: DataFrame, corpus: Sequence[str], dim: str, n: str, n_teams: str,
                   thresholds: Sequence[float]) -> DataFrame:
    """Number of keys present in at least T percent of a corpus's teams, per threshold T."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = freq.join(teams, [*corpus]).withColumn(
        "_hit", F.filter(marks, lambda t: F.col(n) >= t / 100.0 * F.col(n_teams)))
    counts = rows.groupBy(*corpus, dim).agg(*[
        F.count(F.when(F.array_contains("_hit", float(t)), 1)).alias(f"_{i}") for i, t in enumerate(thresholds)])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("keys"))
                      for i, t in enumerate(thresholds)])
    return counts.select(*corpus, dim, F.explode(cells).alias("_c")).select(*corpus, dim, "_c.threshold", "_c.keys")


def entropy_bits(freq: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Shannon entropy of counts: log2(N) - sum(n log2 n) / N, in one aggregation; 0 for empty input."""
    c = F.col(n)
    total = F.sum(c)
    bits = F.log2(total) - F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / total
    return freq.groupBy(*by).agg(F.coalesce(bits, F.lit(0.0)).alias("bits"))


def rank_frequency(freq: DataFrame, by: Sequence[str], key: str, n: str = "n") -> DataFrame:
    """Place of each count in descending order (ties by key), without one task per corpus."""
    rows = range_segments(freq, *by, F.desc(n), key)
    return ranked(rows, by, F.col("_seg"), [F.desc(n), key], "place").drop("_seg")


def jaccard(keys: DataFrame, corpus: str, key: str) -> DataFrame:
    """Jaccard overlap of the distinct key sets of all corpus pairs; two empty sets give 1.

    Corpora are few: each key lists the corpora that hold it, and pairs are counted from those lists.
    """
    distinct = keys.select(corpus, key).distinct()
    sizes = distinct.groupBy(corpus).agg(F.count(key).alias("n"))
    lists = distinct.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(corpus)).alias("_c"))
    shared = (lists.where(F.size("_c") > 1).groupBy("_c").agg(F.count("*").alias("_n"))
              .select("_n", F.posexplode("_c").alias("_i", "a"), "_c")
              .select("_n", "a", F.explode(F.slice("_c", F.col("_i") + 2, F.size("_c"))).alias("b"))
              .groupBy("a", "b").agg(F.sum("_n").alias("shared")))
    pairs = unordered_pairs(sizes.select(F.struct(F.col(corpus).alias("c"), "n").alias("item")), [], "item")
    rows = pairs.select(F.col("a.c").alias("a"), F.col("b.c").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    both = F.coalesce("shared", F.lit(0))
    union = F.col("na") + F.col("nb") - both
    return rows.join(shared, ["a", "b"], "left").select(
        "a", "b", both.alias("shared"), F.when(union == 0, 1.0).otherwise(both / union).alias("jaccard"))


def exclusives(freq: DataFrame, corpus: str, dim: Sequence[str], key: str, n: str, top: int) -> DataFrame:
    """Most frequent keys of each corpus that no other corpus holds."""
    lone = freq.groupBy(*dim, key).agg(F.min(corpus).alias("_a"), F.max(corpus).alias("_b"),
                                       F.sum(n).alias(n)).where("_a = _b")
    return top_per(lone.select(F.col("_a").alias(corpus), *dim, key, n), [corpus, *dim], [F.desc(n), key], top, "place")


def distinct_teams(members: DataFrame, corpus: Sequence[str], team: str, key: Column) -> DataFrame:
    """Number of teams and of different member-key sets.

    A set is identified by size and two order-free 128-bit sums of its keys' digests, so a large team
    needs no list.  A team's members meet in one task, and tasks are as many as the rows ask for.
    """
    parts = task_count(members)
    distinct = members.select(*corpus, team, key.alias("_k")).repartition(parts, *corpus, team).distinct()
    part = lambda salt, i: F.sum(F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("_k"))), i, 15), 16, 10)
                                 .cast("decimal(20,0)"))
    prints = distinct.groupBy(*corpus, team).agg(
        F.count("*").alias("_n"), *[part(s, i).alias(f"_{s}{i}") for s in ("x", "y") for i in (1, 17)])
    names = ["_n", "_x1", "_x17", "_y1", "_y17"]
    kinds = prints.repartition(parts, *corpus, *names).groupBy(*corpus, *names).agg(F.count("*").alias("_teams"))
    return kinds.groupBy(*corpus).agg(F.sum("_teams").alias("teams"), F.count("*").alias("distinct_teams"))


def task_count(rows: DataFrame) -> int:
    """Tasks for a shuffle of ``rows``: as many as the rows ask for, so that what one holds does not grow with the input."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / TASK_ROWS))


def top_pairs(members: DataFrame, team: str, member: str, k: int, copies: str | None = None) -> DataFrame:
    """Most frequent member pairs of all teams; a team may stand for ``copies`` equal ones.

    A team of up to ``TEAM`` members pairs them in its row, larger ones by blocks.  Tasks are as many as the rows ask for, so
    that what one holds does not grow with the input.
    """
    parts = task_count(members)
    of = [team] if copies is None else [team, copies]
    distinct = members.select(*of, member).where(F.col(team).isNotNull() & F.col(member).isNotNull()).repartition(parts, team).distinct()
    sized = distinct.join(distinct.groupBy(team).agg(F.count("*").alias("_size")).where("_size > 1"), team)
    rows = sized.where(F.col("_size") <= TEAM).groupBy(*of).agg(F.array_sort(F.collect_list(member)).alias("_m")).select("_m", *of[1:])
    two = F.flatten(F.transform("_m", lambda x, i: F.transform(F.slice(F.col("_m"), i + 2, TEAM), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = rows.select(F.explode(two).alias("p"), *of[1:]).select("p.a", "p.b", *of[1:])
    large = unordered_pairs(sized.where(F.col("_size") > TEAM).select(*of, member), of, member).select("a", "b", *of[1:])
    pairs = small.unionByName(large).repartition(parts, "a", "b")
    n = F.count("*") if copies is None else F.sum(copies)
    return pairs.groupBy("a", "b").agg(n.alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)


def error_histogram(errors: DataFrame, stage: str = "stage", reason: str = "reason") -> DataFrame:
    return errors.groupBy(stage, reason).agg(F.count("*").alias("n"))


# -- predictions -----------------------------------------------------------------

def binary_metrics(df: DataFrame, by: Sequence[str], y: Column, p: Column, eps: float = 1e-9, copies: Column | None = None) -> DataFrame:
    """Log loss, accuracy at one half and Brier score of clipped probabilities; a row may stand for ``copies`` equal ones."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    mean = F.avg if copies is None else lambda x: F.sum(x * copies) / F.sum(F.when(x.isNotNull(), copies))
    return df.groupBy(*by).agg(
        (-mean(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        mean(((q >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        mean((q - y) * (q - y)).alias("brier"))


# Importance of each attribute in weighted accuracy.
ATTRIBUTE_WEIGHTS = {"Mon": 3.0, "Move": 2.0, "Ability": 1.5, "Item": 1.5, "Tera Type": 1.5, "Nature": 1.0,
                     "EV": 0.5, "IV": 0.5}


def prediction_accuracy(df: DataFrame, attr: str, gen: str, correct: Column,
                        weights: Mapping[str, float] = ATTRIBUTE_WEIGHTS) -> DataFrame:
    """Plain and weighted accuracy overall, per attribute, per generation and crossed, in one pass."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    rows = df.select(attr, gen, correct.cast("double").alias("_ok"),
                     F.coalesce(F.try_element_at(table, F.col(attr)), F.lit(1.0)).alias("_w"))
    return rows.groupingSets([[], [F.col(attr)], [F.col(gen)], [F.col(gen), F.col(attr)]], F.col(attr), F.col(gen)).agg(
        F.avg("_ok").alias("accuracy"), (F.sum(F.col("_ok") * F.col("_w")) / F.sum("_w")).alias("weighted"),
        F.count("*").alias("n"))


def topk_accuracy(df: DataFrame, by: Sequence[str], ranking: Column, truth: Column,
                  ks: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """Share of rows whose truth is among the first k of a ranked array."""
    return df.groupBy(*by).agg(*[
        F.avg(F.array_contains(F.slice(ranking, 1, k), truth).cast("double")).alias(f"top{k}") for k in ks])


def calibration(df: DataFrame, by: Sequence[str], conf: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Mean confidence and expected calibration error over bins (lo, hi]; zero confidence is in no bin."""
    rows = df.select(*by, conf.alias("_c"), correct.cast("double").alias("_a")).withColumn("_b", F.ceil(F.col("_c") * bins))
    cells = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.sum("_c").alias("_sc"), F.sum("_a").alias("_sa"))
    gap = F.when(F.col("_b") > 0, F.abs(F.col("_sc") - F.col("_sa"))).otherwise(0.0)
    return cells.groupBy(*by).agg((F.sum("_sc") / F.sum("_n")).alias("confidence"),
                                  (F.sum(gap) / F.sum("_n")).alias("ece"), F.sum("_n").alias("n"))


def semantic_accuracy(df: DataFrame, seen: str, pred: str, truth: str) -> DataFrame:
    """Order-free accuracy of hidden fields with a real label.

    The three columns are structs (name, moves, ability, item); unknown is null and a known-empty
    field is ``<none>``.  Attributes count only where the name is visible or was predicted right.
    """
    s, p, t = F.col(seen), F.col(pred), F.col(truth)
    hidden_name = s["name"].isNull() & t["name"].isNotNull()
    right_name = s["name"].isNotNull() | (hidden_name & p["name"].eqNullSafe(t["name"]))
    cell = lambda attr, ok: F.struct(F.lit(attr).alias("attr"), ok.cast("int").alias("ok"))
    none = F.array().cast("array<struct<attr:string,ok:int>>")

    def single(f: str) -> Column:
        asked = right_name & s[f].isNull() & t[f].isNotNull() & (t[f] != "<none>")
        return F.when(asked, F.array(cell(f, F.coalesce(p[f] == t[f], F.lit(False))))).otherwise(none)

    hidden = F.filter(F.arrays_zip(s["moves"].alias("x"), t["moves"].alias("y")),
                      lambda z: z["x"].isNull() & z["y"].isNotNull() & (z["y"] != "<none>"))
    asked_moves = F.array_distinct(F.transform(hidden, lambda z: z["y"]))
    known = F.array_compact(p["moves"])
    moves = F.when(right_name, F.transform(asked_moves, lambda m: cell("move", F.array_contains(known, m)))).otherwise(none)
    names = F.when(hidden_name, F.array(cell("name", p["name"].eqNullSafe(t["name"])))).otherwise(none)
    rows = df.select(F.explode(F.concat(names, moves, single("ability"), single("item"))).alias("_c"))
    return rows.groupBy(F.col("_c.attr").alias("attr")).agg(F.avg("_c.ok").alias("accuracy"), F.count("*").alias("total"))


def beta_posteriors(outcomes: DataFrame, key: str, result: Column) -> DataFrame:
    """Beta-Bernoulli posterior per key from one row per key and match side."""
    n = lambda v: F.count(F.when(result == v, 1))
    out = outcomes.groupBy(key).agg(n("WIN").alias("wins"), n("LOSS").alias("losses"), n("DRAW").alias("draws"))
    out = out.withColumn("alpha", 1.0 + F.col("wins") + 0.5 * F.col("draws")).withColumn(
        "beta", 1.0 + F.col("losses") + 0.5 * F.col("draws"))
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("draws")


def vocabulary(words: DataFrame, word: str, known: DataFrame | None = None) -> DataFrame:
    """Ids of distinct words in sorted order after those of ``known`` (word, id), which keep theirs."""
    fresh = words.select(word).where(F.col(word).isNotNull()).distinct()
    if known is None:
        return ranked(range_segments(fresh, word), [], F.col("_seg"), [word], "id").drop("_seg")
    fresh = fresh.join(known.select(word), word, "left_anti")
    base = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    placed = ranked(range_segments(fresh, word), [], F.col("_seg"), [word], "_r")
    return known.select(word, F.col("id").cast("bigint").alias("id")).unionByName(
        placed.select(word, (F.col("_r") + base).alias("id")))


def mixture_summary(files: DataFrame, source: str, weights: DataFrame, weight: str = "weight") -> DataFrame:
    """Files, weight and normalised weight per source, and a total row (null source)."""
    rows = files.groupBy(source).agg(F.count("*").alias("files")).join(weights, source, "left").withColumn(
        "_norm", F.col(weight) / weights.agg(F.sum(weight)).scalar())
    return rows.rollup(source).agg(F.sum("files").alias("files"), F.sum(weight).alias("weight"),
                                   F.sum("_norm").alias("normalised"))


def trajectory_sizes(steps: DataFrame, battle: Sequence[str], size: Column) -> DataFrame:
    """Transitions, longest state and mean state length over all battles."""
    per = steps.groupBy(*battle).agg(F.count("*").alias("_n"), F.max(size).alias("_m"), F.sum(size).alias("_s"))
    return per.agg(F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("transitions"), F.max("_m").alias("longest"),
                   (F.sum("_s") / F.sum("_n")).alias("mean_size"))


def symmetry_error(pairs: DataFrame, a: str, b: str, value: str, target: float = 0.0) -> DataFrame:
    """Mean and largest abs(v_ab + v_ba - target): 1 for probabilities, 0 for payoffs."""
    flipped = pairs.select(F.col(b).alias(a), F.col(a).alias(b), F.col(value).alias("_o"))
    gap = F.abs(F.col(value) + F.col("_o") - target)
    return pairs.join(flipped, [a, b]).agg(F.avg(gap).alias("mean_error"), F.max(gap).alias("max_error"))


def expected_payoff(payoff: DataFrame, team: str, opponent: str, value: str, weights: DataFrame | None = None,
                    weight: str = "weight") -> DataFrame:
    """Mean payoff of each team against an opponent pool, uniform or weighted.  A negative weight is an error."""
    rows = payoff
    w = F.lit(1.0)
    if weights is not None:
        checked = F.when(F.col(weight) < -1e-12, F.raise_error(F.lit("negative mixture weight"))).otherwise(
            F.greatest(F.col(weight), F.lit(0.0)))
        rows = payoff.join(weights.select(opponent, checked.alias("_w")), opponent)
        w = F.col("_w")
    return rows.groupBy(team).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("expected"))


def interaction_report(pairs: DataFrame, a: str, b: str, score: str, k: int) -> DataFrame:
    """Best k columns per row (counters) and best k rows per column (countered by)."""
    rows = top_per(pairs, [a], [F.desc(score), b], k, "place").select(
        F.col(a).alias("entity"), F.lit("counters").alias("role"), "place", F.col(b).alias("other"), score)
    cols = top_per(pairs, [b], [F.desc(score), a], k, "place").select(
        F.col(b).alias("entity"), F.lit("countered_by").alias("role"), "place", F.col(a).alias("other"), score)
    return rows.unionByName(cols)


def largest_token(df: DataFrame, tokens: str) -> DataFrame:
    return df.agg(F.max(F.array_max(tokens)).alias("largest"))


