"""Joins that look up, match and complete partly known records."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import half_year_start
from ..functions.records import gap_fill_moves
from ..session import materialise
from .aggregates import task_count
from .containment import contained, key_of, known_tokens
from .ordered import top_per
from .pairs import unordered_pairs  # noqa: F401  (policy pairs)

DEFAULT_RANK = 1500
EPS = 1e-6
#: Longs in a filter of codes, at most: 8 MB.
FILTER_WORDS = 1 << 20


# -- statistics by skill and time ---------------------------------------------------

def _ranks_per_format(ranks: DataFrame, fmt: str, rank: str) -> DataFrame:
    """Skill cut-offs of each format as a small array."""
    return ranks.groupBy(fmt).agg(F.sort_array(F.collect_set(rank)).alias("_ranks"))


def usage_rank(battles: DataFrame, ranks: DataFrame, fmt: str, rank: str, rating: Column, tournament: Column,
               name: str = "usage_rank") -> DataFrame:
    """Largest available rank not above the effective rating, else the smallest one.

    The effective rating is the rating, else the highest positive rank for tournament games, else 1500.
    Battles of a format without ranks stay, with a null rank.
    """
    rows = battles.join(_ranks_per_format(ranks, fmt, rank), fmt, "left")
    top = F.array_max(F.filter("_ranks", lambda r: r > 0))
    effective = F.coalesce(rating, F.when(tournament, top), F.lit(DEFAULT_RANK))
    fits = F.array_max(F.filter("_ranks", lambda r: r <= effective))
    return rows.withColumn(name, F.coalesce(fits, F.array_min("_ranks"))).drop("_ranks")


def nearest_lower_rank(wanted: DataFrame, ranks: DataFrame, fmt: str, rank: str, target: str,
                       name: str = "loaded_rank") -> DataFrame:
    """The wanted rank where it exists, else the nearest strictly lower one; null when there is none."""
    rows = wanted.join(_ranks_per_format(ranks, fmt, rank), fmt, "left")
    exact = F.when(F.array_contains("_ranks", F.col(target)), F.col(target))
    lower = F.array_max(F.filter("_ranks", lambda r: r < F.col(target)))
    return rows.withColumn(name, F.coalesce(exact, lower)).drop("_ranks")


def half_year_lookup(battles: DataFrame, stats: DataFrame, on: Sequence[str], played: Column, bin_start: str,
                     first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Statistics of the half-year of each battle.

    ``stats`` has one row per ``on`` and half-year (``bin_start``); battles outside the known span use its
    first or last half-year.  The span is that of ``stats`` unless ``first`` and ``last`` name it.
    """
    first = stats.agg(F.min(bin_start)).scalar() if first is None else first
    last = stats.agg(F.max(bin_start)).scalar() if last is None else last
    rows = battles.withColumn(bin_start, F.greatest(F.least(half_year_start(played), last), first))
    return rows.join(stats, [*on, bin_start], "left")


def layered_fallback(layers: Sequence[DataFrame], entity: Sequence[str]) -> DataFrame:
    """Per field, the distribution of the first layer that has one.

    Layers are ordered (tier, lower ranks, all tiers, all tiers of lower ranks); each has entity, field, key,
    share.  A field that only says ``Nothing`` counts as absent unless no layer knows more.
    """
    parts = [layer.select(*entity, "field", "key", "share", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    return best_layer(reduce(DataFrame.unionByName, parts), entity)


def best_layer(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """The same on one table with a ``layer`` number; one shuffle, groups hold the options of one field."""
    field = Window.partitionBy(*entity, "field")
    inside = Window.partitionBy(*entity, "field", "layer")
    empty = (F.count("*").over(inside) == 1) & (F.col("key") == "Nothing") & (F.col("share") == 1.0)
    scored = rows.withColumn("_empty", empty).withColumn("_best", F.min(F.struct("_empty", "layer")).over(field))
    return scored.where(F.col("_best.layer") == F.col("layer")).drop("_empty", "_best")


def two_step_lookup(df: DataFrame, stats: DataFrame, key: str, species: Column, base: Column) -> DataFrame:
    """Statistics by species, and by base species where the species has none; null where neither has any."""
    names = stats.select(key).distinct().withColumn("_known", F.lit(True))
    rows = df.withColumn("_species", species).withColumn("_base", base)
    rows = rows.join(names.withColumnRenamed(key, "_species"), "_species", "left")
    found = rows.withColumn(key, F.when(F.col("_known"), F.col("_species")).otherwise(F.col("_base"))).drop(
        "_known", "_species", "_base")
    return found.join(stats, key, "left")


# -- partial records ------------------------------------------------------------------
#
# A record fits a candidate when every known field is equal and every known set member is contained.  Records are
# keys and tokens, and the search is that of ``containment``.

_HIDDEN = "\x00"


def pattern(keys: Sequence[Column], fields: Sequence[Column], members: Column) -> Column:
    """What is known about a record, as an array that compares by value."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(_HIDDEN))
    known = F.sort_array(F.array_distinct(F.array_compact(members.cast("array<string>"))))
    return F.concat(F.array(*[text(c) for c in [*keys, *fields]]), known)


def fits(record: Column, candidate: Column, fields: Sequence[str], sets: Sequence[str]) -> Column:
    """Predicate form of the same test on two structs (unknown is null)."""
    ok = F.lit(True)
    for s in sets:
        ok = ok & (F.size(F.array_except(F.array_compact(record[s]), F.array_compact(candidate[s]))) == 0)
    for f in fields:
        ok = ok & (record[f].isNull() | record[f].eqNullSafe(candidate[f]))
    return ok


def distinct_records(df: DataFrame, keys: Sequence[str], fields: Sequence[str], members: str, store: bool = False) -> DataFrame:
    """Distinct records with their number of copies and a ``pattern`` key; repeats never reach a join.

    ``store`` writes them to shared storage, for callers that use them several times.
    """
    tidy = F.sort_array(F.array_distinct(F.array_compact(members)))
    out = df.groupBy(*keys, *fields, tidy.alias(members)).agg(F.count("*").alias("copies"))
    out = out.withColumn("pattern", pattern([F.col(k) for k in keys], [F.col(f) for f in fields], F.col(members)))
    return materialise(out, "records") if store else out


def _known(records: DataFrame, keys: Sequence[str], fields: Sequence[str], members: str, *payload: str) -> DataFrame:
    """Key and tokens of records, and the columns to return of them as one."""
    return records.select(key_of(*[F.col(k) for k in keys]).alias("key"),
                          known_tokens({f: F.col(f) for f in fields}, {members: F.col(members)}).alias("tokens"),
                          F.struct(*payload).alias("payload"))


def consistent_pairs(records: DataFrame, candidates: DataFrame, keys: Sequence[str], fields: Sequence[str],
                     members: str) -> DataFrame:
    """All (record, candidate) pairs where the record fits; columns ``record`` and ``candidate`` are structs
    of pattern and copies.  Both inputs come from :func:`distinct_records`."""
    left, right = (_known(r, keys, fields, members, "pattern", "copies", *keys, *fields, members) for r in (records, candidates))
    return contained(left, right, F.col("payload"), F.col("payload"))


def leaves(records: DataFrame, keys: Sequence[str], fields: Sequence[str], members: str) -> DataFrame:
    """Distinct records that no other record extends."""
    known = _known(records, keys, fields, members, "pattern")
    wider = contained(known, known, F.col("payload.pattern"), F.col("payload.pattern")).where(F.col("record") != F.col("candidate"))
    return records.join(wider.select(F.col("record").alias("pattern")).distinct(), "pattern", "left_anti")


def leaf_weights(records: DataFrame, keys: Sequence[str], fields: Sequence[str], members: str) -> DataFrame:
    """Leaves with the number of records, repeats included, that fit them."""
    columns = ["pattern", *keys, *fields, members, "copies"]
    tips = _known(leaves(records, keys, fields, members), keys, fields, members, *columns)
    fits = contained(_known(records, keys, fields, members, "pattern", "copies"), tips, F.col("payload"), F.col("payload"))
    return fits.groupBy("candidate").agg(F.sum("record.copies").alias("weight")).select("candidate.*", "weight")


def best_candidates(records: DataFrame, weighted: DataFrame, keys: Sequence[str], fields: Sequence[str],
                    members: str, k: int) -> DataFrame:
    """Top-``k`` fitting candidates by weight for each distinct record."""
    fits = contained(_known(records, keys, fields, members, "pattern"), _known(weighted, keys, fields, members, "pattern", "weight"),
                     F.col("payload.pattern"), F.col("payload"))
    pairs = fits.select(F.col("record").alias("pattern"), F.col("candidate.pattern").alias("candidate"), "candidate.weight")
    return top_per(pairs, ["pattern"], [F.desc("weight"), "candidate"], k, "place")


def detail_scores(pairs: DataFrame, diffs: DataFrame, usage: DataFrame, by: Sequence[str], entity: str, gaps: str) -> DataFrame:
    """Likelihood of what each candidate adds (log_score): the product of the usage shares of its details, 1e-6 for an
    unknown detail and once more per kind of gap the candidate leaves.  A candidate of an entity without
    statistics scores 1e-6 as a whole, one that adds nothing only its gaps.

    ``pairs`` has a row per record and candidate (by, entity, ``gaps`` the number of kinds left open), ``diffs`` one per
    added detail (by, field, key), ``usage`` entity, field, key, share.
    """
    p = F.greatest(F.coalesce("share", F.lit(EPS)), F.lit(EPS))
    known = usage.select(entity, F.lit(True).alias("_known")).distinct()
    judged = pairs.select(*by, entity, F.col(gaps).alias("_gaps")).join(known, entity, "left")
    rows = judged.join(diffs.select(*by, "field", "key"), by, "left").join(usage, [entity, "field", "key"], "left")
    added = F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.ln(p))), F.lit(0.0))
    score = F.when(F.max("_known").isNull(), F.lit(math.log(EPS))).otherwise(added + F.max("_gaps") * math.log(EPS))
    return rows.groupBy(*by).agg(score.alias("log_score"))


def teammate_shares(rosters: DataFrame, team: str, name: str) -> DataFrame:
    """name, mate, share: of the teams with ``name``, the share that also has ``mate``.  A team's names are its group."""
    counts = rosters.select(team, name).repartition(task_count(rosters), team).distinct()
    mates = counts.join(counts.withColumnRenamed(name, "mate"), team).where(F.col(name) != F.col("mate"))
    teams = counts.groupBy(name).agg(F.count("*").alias("_teams"))
    return mates.groupBy(name, "mate").agg(F.count("*").alias("_both")).join(teams, name).select(
        name, "mate", (F.col("_both") / F.col("_teams")).alias("share"))


def roster_scores(pairs: DataFrame, by: Sequence[str], lead: str, known: str, candidate: str, shares: DataFrame,
                  size: int = 6) -> DataFrame:
    """Likelihood of the names a candidate roster adds (log_score): for each the largest share it has beside a known name,
    1e-6 at least, and 1e-6 once more when the candidate leaves the team incomplete.

    ``pairs`` has a row per partial roster and candidate: ``by``, the lead's name, the known and the candidate's other names
    (arrays); ``shares`` comes from :func:`teammate_shares`.
    """
    own = F.array_compact(F.concat(F.array(lead), known))
    fresh = F.array_except(candidate, known)
    rows = pairs.select(*by, own.alias("_own"), fresh.alias("_fresh"))
    added = (rows.select(*by, "_own", F.explode("_fresh").alias("mate")).select(*by, "mate", F.explode("_own").alias("name"))
             .join(shares, ["name", "mate"], "left").groupBy(*by, "mate").agg(F.greatest(F.max("share"), F.lit(EPS)).alias("best"))
             .groupBy(*by).agg(F.sum(F.ln("best")).alias("_added")))
    gap = F.when(F.size("_fresh") < size - F.size("_own"), F.lit(math.log(EPS))).otherwise(0.0)
    return rows.join(added, by, "left").select(*by, (F.coalesce("_added", F.lit(0.0)) + gap).alias("log_score"))


# -- teams -------------------------------------------------------------------------------

def inverted_index(members: DataFrame, member: str, team: str, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Team count per member, and its sorted team ids in blocks of at most ``block`` consecutive ids.

    A member of a third of all teams has many blocks, never one long row.
    """
    distinct = members.select(member, team).distinct()
    counts = distinct.groupBy(member).agg(F.count("*").alias("teams"))
    postings = distinct.groupBy(member, F.floor(F.col(team) / block).alias("block")).agg(
        F.sort_array(F.collect_list(team)).alias("ids"))
    return counts, postings


def move_set_index(members: DataFrame, member: str, moves: str, team: str, block: int = 1024) -> DataFrame:
    """Team ids by member and set of moves, in the blocks of ids of :func:`inverted_index`.

    The order of the moves and repeats among them don't matter; a null set is a key of its own.
    """
    distinct = members.select(member, F.sort_array(F.array_distinct(moves)).alias(moves), team).distinct()
    return distinct.groupBy(member, moves, F.floor(F.col(team) / block).alias("block")).agg(
        F.sort_array(F.collect_list(team)).alias("ids"))


def _choices(items: Column, k: int, place: str) -> Column:
    """All choices of ``k`` of the structs in ``items``, each in order of the field ``place``, whose values differ."""
    out = F.transform(items, lambda x: F.array(x))
    for _ in range(k - 1):
        longer = lambda c: F.transform(F.filter(items, lambda y: y[place] > F.element_at(c, -1)[place]),
                                       lambda y: F.concat(c, F.array(y)))
        out = F.flatten(F.transform(out, longer))
    return out


def _link(code: Column, value: Column) -> Column:
    """Code of a list of values, made from the code of all but its last."""
    return F.xxhash64(code, value)


def _may_hold(codes: DataFrame, code: str) -> Callable[[Column], Column]:
    """Test of codes: true for all of ``codes`` and, as two may share a bit, for some others.

    The bits are one value of at most 8 * ``FILTER_WORDS`` bytes; with more codes they fill up and let more others through.
    """
    words = 64
    n = codes.count()
    while words < min(n / 4, FILTER_WORDS):
        words *= 2
    word = lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    marked = codes.groupBy(word(F.col(code)).alias("_w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(code)))).alias("_b"))
    every = codes.sparkSession.range(words).select(F.col("id").cast("int").alias("_w")).join(marked, "_w", "left")
    ordered = F.sort_array(F.collect_list(F.struct("_w", F.coalesce("_b", F.lit(0).cast("long")).alias("_b"))))
    bits = materialise(every.agg(ordered.alias("_s")).select(F.col("_s._b").alias("_bits")), "code-bits").scalar()
    return lambda c: F.getbit(F.get(bits, word(c)), bit(c)) == 1


def _asked_choices(teams: DataFrame, k: int, names: str, may_hold: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``teams`` with each choice of ``k`` of its ``names`` whose first 1, 2, ... k names pass the test (_picked, from 0)."""
    rows = teams.where(F.size(names) >= k).withColumns({"_at": F.lit(0), "_code": F.lit(0).cast("long"), "_picked": F.array().cast("array<int>")})
    for left in range(k - 1, -1, -1):
        rest = F.slice(names, F.col("_at") + 1, F.size(names) - left - F.col("_at"))
        rows = rows.select(*teams.columns, "_at", "_code", "_picked", F.posexplode(rest).alias("_i", "_name")).select(
            *teams.columns, (F.col("_at") + F.col("_i") + 1).alias("_at"), _link(F.col("_code"), F.col("_name")).alias("_code"),
            F.concat("_picked", F.array(F.col("_at") + F.col("_i"))).alias("_picked")).where(may_hold(F.col("_code")))
    return rows.drop("_at", "_code")


def best_retrieval(wanted: DataFrame, members: DataFrame, request: str, team: str, name: str) -> DataFrame:
    """Best team per request: most wanted members, then best move overlap, then earlier names, then lowest id.

    ``wanted`` has request, name (once per request), position and wanted_moves; ``members`` has team, name, moves.
    A request with no name that any team has gets no row.

    Equal requests are answered once.  From the largest number of names down, the choices of so many names of a request meet
    the same names of teams by equality, and only requests without an answer go on.  A team's choices grow name by name and
    end where no open request goes on, so nearly none is made or shuffled that isn't asked for.  Teams enter as the different
    sets of moves under the same names with their lowest id, so that a name many teams have costs what its
    sets of moves do, not its teams.  Members that are partitioned by team are not shuffled again.
    """
    kind = wanted.select(name).union(members.select(name)).schema[name].dataType
    wanted, members = (df.withColumn(name, F.col(name).cast(kind)) for df in (wanted, members))
    item = F.struct("position", name, "wanted_moves")
    asked = wanted.groupBy(request).agg(F.array_sort(F.collect_list(item)).alias("_wants"))
    asked = materialise(asked, "requests")
    ids = open_ = materialise(asked.groupBy("_wants").agg(F.min(request).alias("_id")), "requests-distinct")
    start = F.lit(0).cast("long")
    names = open_.select(F.explode(f"_wants.{name}").alias("_n"))
    named = _may_hold(names.select(_link(start, F.col("_n")).alias("_code")), "_code")
    sets = members.where(F.col(name).isNotNull() & named(_link(start, F.col(name)))).groupBy(team, name).agg(
        F.sort_array(F.collect_set("moves")).alias("_sets"))
    has = sets.groupBy(team).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("n"), F.col("_sets").alias("s")))).alias("_has"))
    teams = materialise(has.select(team, F.col("_has.n").alias("_all"), F.col("_has.s").alias("_each")), "teams-asked")
    most = min(open_.agg(F.max(F.size("_wants"))).first()[0] or 0, teams.agg(F.max(F.size("_all"))).first()[0] or 0)
    overlap = F.aggregate(F.zip_with("_wanted", "_sets", lambda w, options: F.array_max(
        F.transform(options, lambda m: F.size(F.array_intersect(w, m))))), F.lit(0), lambda acc, x: acc + x)
    picked = lambda c: F.transform("_picked", lambda i: F.get(F.col(c), i))
    answers = []
    for k in range(most, 0, -1):
        choice = F.array_sort(F.transform("_choice", lambda x: F.struct(x[name].alias("n"), x["position"].alias("p"), x["wanted_moves"].alias("w"))))
        asks = open_.select("_id", F.explode(_choices(F.col("_wants"), k, "position")).alias("_choice")).select(
            "_id", F.transform(choice, lambda x: x["n"]).alias("_names"), F.transform(choice, lambda x: x["w"]).alias("_wanted"),
            F.transform("_choice", lambda x: x["position"]).alias("_places"))
        begun = [F.aggregate(F.slice("_names", 1, j), start, _link) for j in range(1, k + 1)]
        shared = _asked_choices(teams, k, "_all", _may_hold(asks.select(F.explode(F.array(*begun)).alias("_code")), "_code"))
        index = shared.select(team, picked("_all").alias("_names"), picked("_each").alias("_sets")).groupBy("_names", "_sets").agg(F.min(team).alias(team))
        best = asks.join(index, "_names").groupBy("_id").agg(
            F.min(F.struct(F.negate(overlap).alias("o"), F.col("_places"), F.col(team).alias("t"))).alias("_best"))
        found = materialise(best.select("_id", F.col("_best.t").alias(team), F.lit(k).cast("long").alias("matched"),
                                        F.negate("_best.o").alias("_o")), f"retrieved-{k}")
        answers.append(found)
        if k > 1:
            open_ = materialise(open_.join(found.select("_id"), "_id", "left_anti"), "requests-open")
            if open_.isEmpty():
                break
    if not answers:
        return asked.select(request, F.lit(None).cast(members.schema[team].dataType).alias(team), F.lit(0).cast("long").alias("matched"),
                            F.lit(0.0).alias("ratio")).where("1 = 0")
    total = F.aggregate("_wants", F.lit(0), lambda acc, x: acc + F.size(x["wanted_moves"]))
    joined = asked.join(ids, "_wants").join(reduce(DataFrame.unionByName, answers), "_id")
    return joined.select(request, team, "matched", F.coalesce(F.try_divide(F.col("_o"), total), F.lit(0.0)).alias("ratio"))


def payoff_table(scores: DataFrame, id_col: str, score: str, win: Callable[[Column, Column], Column]) -> DataFrame:
    """Payoff 2p - 1 of every ordered pair: negated for the mirror, 0 on the diagonal."""
    pairs = unordered_pairs(scores.select(F.struct(F.col(id_col).alias("id"), F.col(score).alias("s")).alias("item")), [], "item")
    value = 2 * win(F.col("a.s"), F.col("b.s")) - 1
    rows = pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), value.alias("v"))
    cells = F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("v").alias("payoff")),
                    F.struct(F.col("y").alias("a"), F.col("x").alias("b"), (-F.col("v")).alias("payoff")))
    off = rows.select(F.explode(cells).alias("c")).select("c.*")
    return off.unionByName(scores.select(F.col(id_col).alias("a"), F.col(id_col).alias("b"), F.lit(0.0).alias("payoff")))


def with_team_files(results: DataFrame, files: DataFrame, path: str, key: Callable[[Column], Column]) -> DataFrame:
    """Results joined to team files on the name made of the last path parts."""
    return results.withColumn("_k", key(F.col(path))).join(
        files.withColumn("_k", key(F.col("file_path"))), "_k", "left").drop("_k")


def apply_sheet(revealed: DataFrame, sheet: DataFrame, predicted: DataFrame, on: Sequence[str],
                fields: Sequence[str], gen: Column, tera_field: str | None = None) -> DataFrame:
    """Known truth first, then what was revealed, then the prediction.  The sheet's tera type counts in
    generation 9 only."""
    rows = revealed.join(sheet.select(*on, *[F.col(f).alias(f"_s_{f}") for f in fields]), [*on], "left").join(
        predicted.select(*on, *[F.col(f).alias(f"_p_{f}") for f in fields]), [*on], "left")

    def pick(f: str) -> Column:
        truth = F.when(gen == 9, F.col(f"_s_{f}")) if f == tera_field else F.col(f"_s_{f}")
        return F.coalesce(truth, F.col(f), F.col(f"_p_{f}")).alias(f)

    rest = [c for c in revealed.columns if c not in fields]
    return rows.select(*rest, *[pick(f) for f in fields])


def fill_gaps(known: DataFrame, predicted: DataFrame, on: Sequence[str], fields: Sequence[str], moves: str) -> DataFrame:
    """Prediction merged into gaps only."""
    rows = known.join(predicted.select(*on, *[F.col(f).alias(f"_p_{f}") for f in [*fields, moves]]), [*on], "left")
    rest = [c for c in known.columns if c not in {*fields, moves}]
    return rows.select(*rest, *[F.coalesce(F.col(f), F.col(f"_p_{f}")).alias(f) for f in fields],
                       gap_fill_moves(F.col(moves), F.coalesce(F.col(f"_p_{moves}"), F.array().cast("array<string>"))).alias(moves))


def contradictions(revealed: DataFrame, predicted: DataFrame, on: Sequence[str], fields: Sequence[str],
                   sets: Sequence[str]) -> DataFrame:
    """Records whose prediction contradicts what was revealed."""
    left = revealed.select(*on, F.struct(*fields, *sets).alias("_r"))
    right = predicted.select(*on, F.struct(*fields, *sets).alias("_c"))
    return left.join(right, [*on]).where(~fits(F.col("_r"), F.col("_c"), fields, sets)).select(
        *on, F.lit("PredictionContradictsReveal").alias("reason"))


def enrich(df: DataFrame, dimension: DataFrame, key: str, forms: str | None = None) -> DataFrame:
    """Attributes of an entity; ``forms`` lists cosmetic names that share its entry."""
    own = dimension.drop(forms) if forms else dimension
    if forms:
        own = dimension.withColumn("_names", F.array_union(F.array(key), F.coalesce(forms, F.array().cast("array<string>")))).drop(
            key, forms).withColumn(key, F.explode("_names")).drop("_names")
    return df.join(own, key, "left")


def match_by_length(packed: DataFrame, source: DataFrame, packed_id: str, source_id: str) -> DataFrame:
    """Source battle with the same number of states, preferring an equal outcome, then the lowest id.

    The source is reduced to its lowest id per (length, outcome), so equal lengths cannot blow up the join.
    """
    exact = source.groupBy("n_states", "won").agg(F.min(source_id).alias("_same"))
    loose = source.groupBy("n_states").agg(F.min(source_id).alias("_any"))
    return packed.join(exact, ["n_states", "won"], "left").join(loose, "n_states", "left").select(
        packed_id, F.coalesce("_same", "_any").alias(source_id), F.col("_same").isNotNull().alias("same_outcome"))


def complete_attribute(rows: DataFrame, key: Sequence[str], entity: str, order: Sequence[str], value: str,
                       draws: DataFrame) -> DataFrame:
    """First known value per entity of a battle, else its drawn value (``draws``: key + entity + drawn),
    set on every row of the entity."""
    v = F.col(value)
    first = rows.groupBy(*key, entity).agg(F.min_by(v, F.when(v.isNotNull(), F.struct(*order))).alias("_first"))
    chosen = first.join(draws, [*key, entity], "left").select(*key, entity, F.coalesce("_first", "drawn").alias("_v"))
    return rows.join(chosen, [*key, entity], "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def names_to_ids(teams: DataFrame, ids: DataFrame, team: str, name: Column) -> tuple[DataFrame, DataFrame]:
    """Sorted ids per team, and the names that have none.  ``ids`` has cleaned name ``key`` and ``id``."""
    rows = teams.withColumn("key", name).join(ids, "key", "left")
    good = rows.where(F.col("id").isNotNull()).select(team, "id").distinct().groupBy(team).agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    return good, rows.where(F.col("id").isNull()).select(team, "key", F.lit("UnknownName").alias("reason"))
