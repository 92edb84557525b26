"""Queries on lookups, partial-record matching and completion."""

from __future__ import annotations

from collections import Counter
from itertools import batched

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import records
from ..operators import containment as ct
from ..operators import matching as mt
from ..operators.aggregates import task_count
from ..session import materialise
from .base import query, table, view
from .stats import USAGE_SQL, counted_usage


def rated_orders(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", (1 + k % 3).cast("int").alias("gen"), F.when(k % 4 > 0, (F.floor(F.col("o_totalprice")) % 2500).cast("int")).alias("rating"),
        (k % 8 == 0).alias("tournament"), F.col("o_orderdate").cast("date").alias("played"), "o_custkey")


RATED_SQL = """rated AS (SELECT o_orderkey, CAST(1 + o_orderkey % 3 AS INT) AS gen, CASE WHEN o_orderkey % 4 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 2500 END AS rating,
 o_orderkey % 8 = 0 AS tournament, CAST(o_orderdate AS DATE) AS played, o_custkey FROM orders),
ranks AS (SELECT DISTINCT gen, usage_rank FROM picks)"""


@query("J1_usage_rank", f"""WITH {RATED_SQL}, e AS (SELECT o_orderkey, gen, coalesce(rating, CASE WHEN tournament THEN
 (SELECT max(usage_rank) FROM ranks r WHERE r.gen = rated.gen AND usage_rank > 0) END, 1500) AS eff FROM rated)
SELECT o_orderkey, coalesce((SELECT max(usage_rank) FROM ranks r WHERE r.gen = e.gen AND usage_rank <= eff),
 (SELECT min(usage_rank) FROM ranks r WHERE r.gen = e.gen)) AS usage_rank FROM e""", ("picks",))
def j1(spark, d):
    ranks = view(spark, d, "picks").select("gen", "usage_rank").distinct()
    return mt.usage_rank(rated_orders(spark, d), ranks, "gen", "usage_rank", F.col("rating"), F.col("tournament")).select(
        "o_orderkey", "usage_rank")


@query("J2_half_year_lookup", f"""WITH {RATED_SQL},
s AS (SELECT gen, make_date(year(month), CASE WHEN month(month) <= 6 THEN 1 ELSE 7 END, 1) AS b, sum(qty) AS qty FROM picks
  GROUP BY 1, 2),
r AS (SELECT *, greatest(least(make_date(year(played), CASE WHEN month(played) <= 6 THEN 1 ELSE 7 END, 1), DATE '2000-07-01'), DATE '1996-01-01') AS b FROM rated)
SELECT o_orderkey, CAST(b AS VARCHAR) AS half_year, CAST(qty AS BIGINT) AS qty FROM r LEFT JOIN s USING (gen, b)""", ("picks",))
def j2(spark, d):
    from ..functions.dates import half_year_start
    stats = view(spark, d, "picks").groupBy(
        "gen", half_year_start(F.col("month")).alias("half_year")).agg(F.sum("qty").alias("qty"))
    out = mt.half_year_lookup(rated_orders(spark, d), stats, ["gen"], F.col("played"), "half_year",
                              F.lit("1996-01-01").cast("date"), F.lit("2000-07-01").cast("date"))
    return out.select("o_orderkey", F.col("half_year").cast("string").alias("half_year"), "qty")


@query("J3_nearest_lower_rank", f"""WITH {RATED_SQL}, w AS (SELECT o_orderkey, gen, CAST(CASE o_orderkey % 4 WHEN 0 THEN -5 WHEN 1 THEN 1500 WHEN 2 THEN 1630 ELSE 2000 END AS INT) AS wanted FROM rated)
SELECT o_orderkey, (SELECT max(usage_rank) FROM ranks r WHERE r.gen = w.gen AND usage_rank <= wanted) AS loaded_rank FROM w""", ("picks",))
def j3(spark, d):
    ranks = view(spark, d, "picks").select("gen", "usage_rank").distinct()
    k = F.col("o_orderkey") % 4
    wanted = rated_orders(spark, d).withColumn("wanted", F.when(k == 0, -5).when(k == 1, 1500).when(k == 2, 1630).otherwise(2000))
    return mt.nearest_lower_rank(wanted, ranks, "gen", "usage_rank", "wanted").select("o_orderkey", "loaded_rank")


@query("J4_layered_fallback", f"""WITH {USAGE_SQL},
m AS (SELECT usage_rank, tier, entity, field, key, sum(share * n) AS w FROM usage JOIN counts USING (gen, tier, usage_rank, month, entity) GROUP BY ALL),
l AS (SELECT *, CASE usage_rank WHEN 1760 THEN 0 WHEN 1500 THEN 1 ELSE 2 END + CASE WHEN tier = 'ou' THEN 0 ELSE 3 END AS layer FROM m),
e AS (SELECT entity, field, layer, CASE WHEN layer = 0 AND entity % 3 = 0 AND field = 'moves' THEN 'Nothing' ELSE key END AS key,
  CASE WHEN layer = 0 AND entity % 3 = 0 AND field = 'moves' THEN 1.0 ELSE w END AS share FROM l),
u AS (SELECT DISTINCT * FROM e), g AS (SELECT entity, field, layer, bool_and(key = 'Nothing') AS empty FROM u GROUP BY ALL),
b AS (SELECT entity, field, arg_min(layer, (empty::INT) * 10 + layer) AS layer FROM g GROUP BY ALL)
SELECT entity, field, layer, key, round(share, 4) AS share FROM u JOIN b USING (entity, field, layer)""", ("picks",))
def j4(spark, d):
    usage, _ = counted_usage(spark, d)
    m = usage.groupBy("usage_rank", "tier", "entity", "field", "key").agg(
        F.sum(F.col("share") * F.col("n")).alias("w"))
    rank = F.col("usage_rank")
    layer = F.when(F.col("tier") == "ou", 0).otherwise(3) + F.when(rank == 1760, 0).when(rank == 1500, 1).otherwise(2)
    blank = (F.col("layer") == 0) & (F.col("entity") % 3 == 0) & (F.col("field") == "moves")
    rows = m.withColumn("layer", layer).groupBy("entity", "field", "layer", F.when(blank, "Nothing").otherwise(F.col("key")).alias("key")).agg(
        F.max(F.when(blank, 1.0).otherwise(F.col("w"))).alias("share"))
    return mt.best_layer(rows, ["entity"]).withColumn("share", F.round("share", 4))


@query("J5_two_step_lookup", """WITH s AS (SELECT p_brand AS key, count(*) AS n, sum(p_size) AS total FROM part GROUP BY 1),
q AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '-Form' END AS species, p_brand AS base FROM part)
SELECT p_partkey, coalesce(a.n, b.n) AS n, CAST(coalesce(a.total, b.total) AS BIGINT) AS total FROM q LEFT JOIN s a ON species = a.key LEFT JOIN s b ON base = b.key""")
def j5(spark, d):
    part = table(spark, d, "part")
    stats = part.groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
    species = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("-Form")))
    return mt.two_step_lookup(part.select("p_partkey", "p_brand"), stats, "key", species, F.col("p_brand")).select(
        "p_partkey", "n", "total")


_KEYS, _FIELDS = ["name"], ["item", "ability", "nature"]
RECORD_SQL = """r AS (SELECT name, item, ability, nature, list_sort(list_distinct(list_filter([mv0, mv1, mv2, mv3], lambda x: x IS NOT NULL))) AS moves,
 count(*) AS copies FROM records GROUP BY ALL)"""
_SHOW = "{0}.name || '/' || coalesce({0}.item, '?') || coalesce({0}.ability, '?') || coalesce({0}.nature, '?') || '/' || array_to_string({0}.moves, ',')"
_FITS = """p.name = c.name AND len(p.moves) <= len(c.moves) AND (p.item IS NULL OR p.item IS NOT DISTINCT FROM c.item)
 AND (p.ability IS NULL OR p.ability IS NOT DISTINCT FROM c.ability) AND (p.nature IS NULL OR p.nature IS NOT DISTINCT FROM c.nature) AND list_has_all(c.moves, p.moves)"""


def distinct_records(spark, d):
    r = view(spark, d, "records").select("name", *_FIELDS, F.array("mv0", "mv1", "mv2", "mv3").alias("moves"))
    return mt.distinct_records(r, _KEYS, _FIELDS, "moves", store=True)


def shown(c=None):
    f = lambda n: F.col(f"{c}.{n}" if c else n)
    q = lambda n: F.coalesce(f(n), F.lit("?"))
    return F.concat(f("name").cast("string"), F.lit("/"), q("item"), q("ability"), q("nature"), F.lit("/"), F.array_join(f("moves"), ","))


@query("J6_consistent_pairs", f"WITH {RECORD_SQL} SELECT {_SHOW.format('p')} AS record, {_SHOW.format('c')} AS candidate, c.copies FROM r p JOIN r c ON {_FITS}", ("records",))
def j6(spark, d):
    r = distinct_records(spark, d)
    out = mt.consistent_pairs(r, r, _KEYS, _FIELDS, "moves")
    return out.select(shown("record").alias("record"), shown("candidate").alias("candidate"), F.col("candidate.copies").alias("copies"))


LEAF_SQL = f"""{RECORD_SQL}, leaf AS (SELECT * FROM r p WHERE NOT EXISTS (SELECT 1 FROM r c WHERE {_FITS}
 AND (len(c.moves), c.item, c.ability, c.nature) IS DISTINCT FROM (len(p.moves), p.item, p.ability, p.nature)))"""


@query("J7_leaves", f"WITH {LEAF_SQL} SELECT {_SHOW.format('leaf')} AS record, copies FROM leaf", ("records",))
def j7(spark, d):
    return mt.leaves(distinct_records(spark, d), _KEYS, _FIELDS, "moves").select(shown().alias("record"), "copies")


@query("J8_leaf_weights", f"""WITH {LEAF_SQL} SELECT {_SHOW.format('c')} AS record, CAST(sum(p.copies) AS BIGINT) AS weight FROM leaf c JOIN r p ON {_FITS} GROUP BY 1""", ("records",))
def j8(spark, d):
    return mt.leaf_weights(distinct_records(spark, d), _KEYS, _FIELDS, "moves").select(shown().alias("record"), "weight")


@query("J9_best_candidates", f"""WITH {LEAF_SQL}, w AS (SELECT c.*, x.weight FROM leaf c JOIN (SELECT c.name, c.item, c.ability, c.nature, c.moves, CAST(sum(p.copies) AS BIGINT) AS weight
  FROM leaf c JOIN r p ON {_FITS} GROUP BY ALL) x ON (c.name, c.item, c.ability, c.nature, c.moves) IS NOT DISTINCT FROM (x.name, x.item, x.ability, x.nature, x.moves)),
g AS (SELECT p.name, p.item, p.ability, p.nature, p.moves, c.weight, row_number() OVER (PARTITION BY p.name, p.item, p.ability, p.nature, p.moves ORDER BY c.weight DESC,
   {_SHOW.format('c')}) AS place FROM r p JOIN w c ON {_FITS})
SELECT {_SHOW.format('g')} AS record, CAST(place AS INT) AS place, weight FROM g WHERE place <= 3""", ("records",))
def j9(spark, d):
    r = distinct_records(spark, d)
    best = mt.best_candidates(r, mt.leaf_weights(r, _KEYS, _FIELDS, "moves"), _KEYS, _FIELDS, "moves", 3)
    return best.join(r, "pattern").select(shown().alias("record"), "place", "weight")


@query("J10_detail_scores", """
WITH n AS (SELECT entity, sum(qty) AS n FROM picks GROUP BY 1), u AS (SELECT entity, 'moves' AS field, 'm' || pick AS key, sum(qty) / any_value(n.n) AS share FROM picks JOIN n USING (entity) GROUP BY 1, 2, 3),
p AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_orderkey % 11 = 0 THEN -1 - l_suppkey ELSE l_suppkey END AS entity, max(l_linenumber % 3) AS gaps FROM lineitem GROUP BY ALL),
d AS (SELECT l_orderkey, l_suppkey, 'moves' AS field, 'm' || (l_partkey % 50) AS key FROM lineitem WHERE l_linenumber > 1)
SELECT l_orderkey, l_suppkey, round(CASE WHEN entity NOT IN (SELECT entity FROM n) THEN ln(1e-6)
 ELSE coalesce(sum(CASE WHEN d.key IS NOT NULL THEN ln(greatest(coalesce(share, 1e-6), 1e-6)) END), 0) + max(gaps) * ln(1e-6) END, 4) AS log_score
FROM p LEFT JOIN d USING (l_orderkey, l_suppkey) LEFT JOIN u USING (entity, field, key) GROUP BY l_orderkey, l_suppkey, entity""", ("picks",))
def j10(spark, d):
    picks = view(spark, d, "picks")
    n = picks.groupBy("entity").agg(F.sum("qty").alias("n"))
    usage = picks.groupBy("entity", F.lit("moves").alias("field"), F.concat(F.lit("m"), F.col("pick").cast("string")).alias("key")).agg(
        F.sum("qty").alias("w")).join(n, "entity").select("entity", "field", "key", (F.col("w") / F.col("n")).alias("share"))
    lines = table(spark, d, "lineitem")
    entity = F.when(F.col("l_orderkey") % 11 == 0, -1 - F.col("l_suppkey")).otherwise(F.col("l_suppkey"))
    pairs = lines.groupBy("l_orderkey", "l_suppkey", entity.alias("entity")).agg(F.max(F.col("l_linenumber") % 3).alias("gaps"))
    diffs = lines.where("l_linenumber > 1").select("l_orderkey", "l_suppkey", F.lit("moves").alias("field"),
                                                   F.concat(F.lit("m"), (F.col("l_partkey") % 50).cast("string")).alias("key"))
    scores = mt.detail_scores(pairs, diffs, usage, ["l_orderkey", "l_suppkey"], "entity", "gaps")
    return scores.withColumn("log_score", F.round("log_score", 4))


# Teams of an order: one member per name, the first line leads.
TEAM_SQL = """d AS (SELECT *, CAST(name AS VARCHAR) AS who, list_filter([mv0, mv1, mv2, mv3], lambda x: x IS NOT NULL) AS moves,
  row_number() OVER (PARTITION BY team_id, name ORDER BY l_linenumber, l_partkey, l_quantity) AS nth FROM records),
m AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY l_linenumber, l_partkey, l_quantity, name) AS place FROM d WHERE nth = 1),
t AS (SELECT team_id, place, who, list_concat(CASE WHEN place = 1 THEN []::VARCHAR[] ELSE [who] END,
  list_transform(list_concat(list_filter(['item=' || item, 'ability=' || ability, 'nature=' || nature], lambda x: x IS NOT NULL), list_transform(moves, lambda x: 'moves=' || x)),
    lambda x: CASE WHEN place = 1 THEN '' ELSE who END || '.' || x)) AS tok FROM m),
teams AS (SELECT team_id, max(CASE WHEN place = 1 THEN who END) AS lead, list_sort(list_distinct(flatten(list(tok)))) AS tokens FROM t GROUP BY team_id),
r AS (SELECT lead, tokens, count(*) AS copies FROM teams GROUP BY ALL)"""
_TEAM_FITS = "p.lead = c.lead AND len(p.tokens) <= len(c.tokens) AND list_has_all(c.tokens, p.tokens)"
_TEAM_SHOW = "{0}.lead || ':' || array_to_string({0}.tokens, ',')"


def _members(batches):
    """Rows (team_id, name, member as JSON) by team and place -> each team and its members as JSON; the first row of a name stays."""
    team, members = None, {}
    for batch in batches:
        for of, name, member in zip(*[c.to_pylist() for c in batch.columns]):
            if of != team:
                if members:
                    yield team, [*members.values()]
                team, members = of, {}
            members.setdefault(name, member)
    if members:
        yield team, [*members.values()]


def _team_rows(batches):
    for some in batched(_members(batches), 4096):
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in some], pa.int64()), pa.array([f"[{','.join(m)}]" for _, m in some], pa.string())], ["team_id", "team"])


def _team_counts(batches):
    """Different teams and their copies: the lead is first, the others' order says nothing and goes by text."""
    for some in batched(_members(batches), 1 << 16):
        copies = Counter(f"[{','.join([m[0], *sorted(m[1:])])}]" for _, m in some)
        yield pa.RecordBatch.from_arrays([pa.array(copies.keys(), pa.string()), pa.array(copies.values(), pa.int64())], ["team", "n"])


def _teams(spark, d, run, kept):
    """``kept`` columns, lead and reserve of what ``run`` makes of the lines, which are shuffled once, without what is not told."""
    place = ["l_linenumber", "l_partkey", "l_quantity", "name"]
    lines = view(spark, d, "records").withColumns({"team_id": F.col("team_id").cast("long"), "moves": F.array_compact(F.array("mv0", "mv1", "mv2", "mv3"))})
    lines = lines.select("team_id", *place, F.to_json(F.struct("name", *_FIELDS, "moves")).alias("member"))
    by_place = lines.repartition(task_count(lines), "team_id").sortWithinPartitions("team_id", *place)
    texts = by_place.select("team_id", "name", "member").mapInArrow(run, f"team string, {kept} long" if kept == "n" else f"{kept} long, team string")
    if kept == "n":
        texts = texts.groupBy("team").agg(F.sum("n").alias("n"))
    member = StructType([StructField("name", lines.schema["name"].dataType), *[StructField(f, StringType()) for f in _FIELDS], StructField("moves", ArrayType(StringType()))])
    both = texts.select(kept, F.from_json("team", ArrayType(member)).alias("members"))
    return both.select(kept, F.col("members")[0].alias("lead"), F.expr("slice(members, 2, size(members))").alias("reserve"))


def teams(spark, d):
    """team_id, lead, reserve of every order."""
    return _teams(spark, d, _team_rows, "team_id")


def different_teams(spark, d):
    """n, lead, reserve of the different teams; ``n`` is the number of orders that have it."""
    return _teams(spark, d, _team_counts, "n")


def known_teams(spark, d):
    rows = materialise(different_teams(spark, d), "teams")  # tokens are dear
    tokens = ct.team_tokens(rows["lead"], rows["reserve"], _FIELDS, ["moves"])
    return ct.distinct_known(rows, rows["lead.name"].cast("string"), tokens, copies="n")


def shown_team(key, tokens):
    plain = F.sort_array(F.transform(tokens, lambda t: F.translate(t, "\x01", ".")))
    return F.concat(key, F.lit(":"), F.array_join(plain, ","))


@query("J6_team_pairs", f"WITH {TEAM_SQL} SELECT {_TEAM_SHOW.format('p')} AS record, {_TEAM_SHOW.format('c')} AS candidate, c.copies FROM r p JOIN r c ON {_TEAM_FITS}", ("records",))
def j6_teams(spark, d):
    known = known_teams(spark, d)
    text = shown_team(F.col("key"), F.col("tokens"))
    shown_known = materialise(known.select("key", "tokens", text.alias("text"), "copies"), "shown")
    pairs = ct.contained(shown_known, shown_known, F.col("text"), F.struct("text", "copies"))
    return pairs.select("record", F.col("candidate.text").alias("candidate"), F.col("candidate.copies").alias("copies"))


@query("J8_team_weights", f"""WITH {TEAM_SQL}, leaf AS (SELECT * FROM r p WHERE NOT EXISTS (SELECT 1 FROM r c WHERE {_TEAM_FITS} AND c.tokens <> p.tokens))
SELECT {_TEAM_SHOW.format('c')} AS record, CAST(sum(p.copies) AS BIGINT) AS weight FROM leaf c JOIN r p ON {_TEAM_FITS} GROUP BY 1""", ("records",))
def j8_teams(spark, d):
    weighted = ct.leaf_weights(known_teams(spark, d), carry=False)
    return weighted.select(shown_team(F.col("key"), F.col("tokens")).alias("record"), "weight")


ROSTER_SQL = f"""{TEAM_SQL}, n AS (SELECT team_id, max(CASE WHEN place = 1 THEN who END) AS lead,
  list_sort(coalesce(list(who) FILTER (WHERE place > 1), []::VARCHAR[])) AS tokens FROM t GROUP BY team_id),
q AS (SELECT lead, tokens, count(*) AS copies FROM n GROUP BY ALL),
tip AS (SELECT * FROM q p WHERE NOT EXISTS (SELECT 1 FROM q c WHERE {_TEAM_FITS} AND c.tokens <> p.tokens)),
w AS (SELECT c.lead, c.tokens, CAST(sum(p.copies) AS BIGINT) AS weight FROM tip c JOIN q p ON {_TEAM_FITS} GROUP BY ALL),
best AS (SELECT p.lead, p.tokens, c.tokens AS candidate, c.weight, row_number() OVER (PARTITION BY p.lead, p.tokens ORDER BY c.weight DESC, c.tokens) AS place
  FROM q p JOIN w c ON {_TEAM_FITS} QUALIFY place <= 3)"""


def rosters(spark, d):
    """team_id, names (the lead's first) of every order: as in :func:`teams`, without the members' details."""
    lines = view(spark, d, "records").select("team_id", "name", "l_linenumber", "l_partkey", "l_quantity")
    lines = lines.repartition(task_count(lines), "team_id")
    first = lines.groupBy("team_id", "name").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("place"))
    both = first.groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("members"))
    return materialise(both.select("team_id", F.transform("members", lambda m: m["name"].cast("string")).alias("names")), "rosters")


def roster_candidates(rows):
    """Distinct rosters, and their three heaviest candidates."""
    known = ct.distinct_known(rows, F.col("names")[0], F.slice("names", 2, 100))
    weighted = materialise(ct.leaf_weights(known), "roster-weights")
    best = ct.best_fits(known, weighted, 3)
    own = known.select("id", F.col("key").alias("lead"), "tokens")
    full = weighted.select(F.col("id").alias("candidate"), F.col("tokens").alias("full"))
    return best.join(own, "id").join(full, "candidate")


@query("J9_roster_candidates", f"""WITH {ROSTER_SQL} SELECT lead, array_to_string(tokens, ',') AS roster, array_to_string(candidate, ',') AS candidate, weight, CAST(place AS INT) AS place FROM best""", ("records",))
def j9_rosters(spark, d):
    return roster_candidates(rosters(spark, d)).select(
        "lead", F.array_join("tokens", ",").alias("roster"), F.array_join("full", ",").alias("candidate"), "weight", "place")


@query("J10_roster_scores", f"""WITH {ROSTER_SQL}, o AS (SELECT who, count(*) AS teams FROM t GROUP BY 1),
s AS (SELECT a.who AS name, b.who AS mate, count(*) / any_value(o.teams) AS share FROM t a JOIN t b ON a.team_id = b.team_id AND a.who <> b.who JOIN o ON o.who = a.who GROUP BY 1, 2),
f AS (SELECT lead, tokens, candidate, place, unnest(list_filter(candidate, lambda x: NOT list_contains(tokens, x))) AS mate FROM best),
g AS (SELECT f.lead, f.tokens, place, f.mate, greatest(coalesce(max(share), 1e-6), 1e-6) AS top FROM f LEFT JOIN s ON s.mate = f.mate AND list_contains(list_concat([lead], tokens), s.name) GROUP BY ALL),
h AS (SELECT lead, tokens, place, sum(ln(top)) AS added FROM g GROUP BY ALL)
SELECT best.lead, array_to_string(best.tokens, ',') AS roster, CAST(best.place AS INT) AS place, round(coalesce(added, 0)
 + CASE WHEN len(list_filter(candidate, lambda x: NOT list_contains(best.tokens, x))) < 5 - len(best.tokens) THEN ln(1e-6) ELSE 0 END, 4) AS log_score
FROM best LEFT JOIN h ON h.lead = best.lead AND h.tokens = best.tokens AND h.place = best.place""", ("records",))
def j10_rosters(spark, d):
    rows = rosters(spark, d)
    names = rows.select("team_id", F.explode(F.slice("names", 1, 101)).alias("name"))
    pairs = materialise(roster_candidates(rows), "roster-candidates")
    scores = mt.roster_scores(pairs, ["id", "place"], "lead", "tokens", "full", mt.teammate_shares(names, "team_id", "name"))
    return scores.join(pairs, ["id", "place"]).select(
        "lead", F.array_join("tokens", ",").alias("roster"), "place", F.round("log_score", 4).alias("log_score"))


@query("J11_inverted_index", """WITH m AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), c AS (SELECT l_suppkey, count(*) AS teams FROM m GROUP BY 1)
SELECT l_suppkey, teams, CAST(floor(l_orderkey / 1024) AS BIGINT) AS block, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS ids FROM m JOIN c USING (l_suppkey) GROUP BY ALL""")
def j11(spark, d):
    counts, postings = mt.inverted_index(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")
    return postings.join(counts, "l_suppkey").select("l_suppkey", "teams", "block", F.array_join(
        F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("J11_move_set_index", """WITH m AS (SELECT l_orderkey AS team, l_suppkey, array_to_string(list_sort(list_distinct(list(l_partkey % 20))), ',') AS moves FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, moves, CAST(floor(team / 1024) AS BIGINT) AS block, string_agg(team::VARCHAR, ',' ORDER BY team) AS ids FROM m GROUP BY ALL""")
def j11_move_sets(spark, d):
    members = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("moves"))
    index = mt.move_set_index(members, "l_suppkey", "moves", "l_orderkey")
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return index.select("l_suppkey", text("moves"), "block", text("ids"))


@query("J12_best_retrieval", """
WITH m AS (SELECT l_orderkey AS team, l_suppkey AS name, list_distinct(list(l_partkey % 20)) AS moves FROM lineitem GROUP BY 1, 2),
w AS (SELECT c_custkey AS req, unnest([0, 1, 2]) AS position FROM customer),
q AS (SELECT req, position, (req * 7 + position * 13) % (SELECT count(*) FROM supplier) AS name, [req % 20, (req + position) % 20] AS wm FROM w),
a AS (SELECT req, sum(len(wm)) AS asked FROM q GROUP BY 1),
h AS (SELECT req, team, count(*) AS matched, sum(len(list_intersect(list_distinct(wm), moves))) AS o, list(position ORDER BY position) AS positions FROM q JOIN m USING (name) GROUP BY 1, 2)
SELECT req, team, matched, round(CAST(o / asked AS DOUBLE), 6) AS ratio FROM h JOIN a USING (req)
QUALIFY row_number() OVER (PARTITION BY req ORDER BY matched DESC, o / asked DESC, positions, team) = 1""")
def j12(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("team"), F.col("l_suppkey").alias("name"), (F.col("l_partkey") % 20).alias("move"))
    members = lines.repartition(task_count(lines), "team").groupBy("team", "name").agg(F.collect_set("move").alias("moves"))
    n = table(spark, d, "supplier").agg(F.count("*")).scalar()
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("req"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position")).withColumn("n", n)
    wanted = asked.select("req", "position", ((F.col("req") * 7 + F.col("position") * 13) % F.col("n")).alias("name"),
                          F.array(F.col("req") % 20, (F.col("req") + F.col("position")) % 20).alias("wanted_moves"))
    out = mt.best_retrieval(wanted, members, "req", "team", "name")
    return out.select("req", "team", "matched", F.round("ratio", 6).alias("ratio"))


@query("J15_team_file_join", """SELECT o_orderkey, c_custkey, 'teams-gen1ou-team_' || o_custkey AS team FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0""")
def j15(spark, d):
    path = lambda root, k, ext: F.concat(F.lit(f"{root}/teams/gen1ou/team_"), F.col(k).cast("string"), F.lit(ext))
    results = table(spark, d, "orders").select("o_orderkey", path("/home/a", "o_custkey", ".txt").alias("path"))
    files = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", path("/data/x/y", "c_custkey", ".team.gz").alias("file_path"))
    out = mt.with_team_files(results, files, "path", records.team_name)
    return out.select("o_orderkey", "c_custkey", records.team_name(F.col("path")).alias("team"))


@query("J16_sheet_override", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'sheet' WHEN p_partkey % 2 = 0 THEN p_type ELSE 'pred' END AS item,
 CASE WHEN p_partkey % 3 = 0 AND 1 + p_partkey % 9 = 9 THEN 'sheettera' WHEN p_partkey % 5 = 0 THEN 'seen' ELSE 'predtera' END AS tera FROM part""")
def j16(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    revealed = part.select("p_partkey", (1 + k % 9).alias("gen"), F.when(k % 2 == 0, F.col("p_type")).alias("item"), F.when(k % 5 == 0, "seen").alias("tera"))
    sheet = part.where(k % 3 == 0).select("p_partkey", F.lit("sheet").alias("item"), F.lit("sheettera").alias("tera"))
    predicted = part.select("p_partkey", F.lit("pred").alias("item"), F.lit("predtera").alias("tera"))
    return mt.apply_sheet(revealed, sheet, predicted, ["p_partkey"], ["item", "tera"], F.col("gen"), "tera").select("p_partkey", "item", "tera")


def merged_records(spark, d, on):
    """One record per key; lines that repeat a key are merged."""
    return view(spark, d, "records").groupBy(*on).agg(
        F.min("item").alias("item"), F.array(F.min("mv0"), F.min("mv1"), F.min("mv2")).alias("moves"))


@query("J17_fill_gaps", """WITH k AS (SELECT team_id, l_partkey, l_linenumber, min(item) AS item, list_filter([min(mv0), min(mv1), min(mv2)], lambda x: x IS NOT NULL) AS mv FROM records GROUP BY 1, 2, 3)
SELECT team_id, l_partkey, l_linenumber, coalesce(item, 'P') AS item, array_to_string(list_concat(mv, list_filter(['a1', 'b0', 'z1', 'z2', 'z3'], lambda x: NOT list_contains(mv, x)))[1:4], ',') AS moves FROM k""", ("records",))
def j17(spark, d):
    on = ["team_id", "l_partkey", "l_linenumber"]
    known = merged_records(spark, d, on)
    predicted = known.select(*on, F.lit("P").alias("item"), F.array(*[F.lit(m) for m in ("a1", "b0", "z1", "z2", "z3")]).alias("moves"))
    return mt.fill_gaps(known, predicted, on, ["item"], "moves").withColumn("moves", F.array_join("moves", ","))


@query("J18_enriched", """SELECT l_orderkey, l_linenumber, l_partkey, n_name, n_regionkey FROM lineitem LEFT JOIN
 (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation) ON k = l_suppkey % 25 + CASE WHEN l_partkey % 2 = 0 THEN 100 ELSE 0 END""")
def j18(spark, d):
    dim = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity"), F.array(F.col("n_nationkey").cast("bigint") + 100).alias("forms"), "n_name", "n_regionkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 25 + F.when(F.col("l_partkey") % 2 == 0, 100).otherwise(0)).alias("entity"))
    return mt.enrich(rows, dim, "entity", "forms").drop("entity")


@query("J20_match_by_length", """WITH s AS (SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS won FROM conversations GROUP BY 1),
p AS (SELECT l_orderkey AS packed, count(*) AS n, l_orderkey % 2 = 0 AS won FROM lineitem GROUP BY 1)
SELECT packed, coalesce((SELECT min(conv_id) FROM s WHERE s.n = p.n AND s.won = p.won), (SELECT min(conv_id) FROM s WHERE s.n = p.n)) AS conv_id,
 CAST(EXISTS (SELECT 1 FROM s WHERE s.n = p.n AND s.won = p.won) AS INT) AS same_outcome FROM p""")
def j20(spark, d):
    source = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_states"), F.max(F.col("role") == "system").alias("won"))
    packed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("packed")).agg(F.count("*").alias("n_states")).withColumn("won", F.col("packed") % 2 == 0)
    return mt.match_by_length(packed, source, "packed", "conv_id").withColumn("same_outcome", F.col("same_outcome").cast("int"))


@query("J21_completed_attribute", """
WITH r AS (SELECT event_id, battle_id, ts, base, CASE WHEN k % 10 = 0 THEN 't' || (k % 4) END AS tera FROM steps0),
f AS (SELECT battle_id, base, arg_min(tera, ts) FILTER (tera IS NOT NULL) AS first FROM r GROUP BY 1, 2),
u AS (SELECT base, tera AS key, count(*) AS share FROM r WHERE tera IS NOT NULL GROUP BY 1, 2),
g AS (SELECT f.battle_id, f.base, u.key, -ln((CAST('0x' || substr(md5('tera:' || f.battle_id || ':' || f.base || ':' || u.key), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / share AS t FROM f JOIN u USING (base)),
dr AS (SELECT battle_id, base, arg_min(key, t) AS drawn FROM g GROUP BY 1, 2)
SELECT event_id, coalesce(first, drawn) AS tera FROM r LEFT JOIN f USING (battle_id, base) LEFT JOIN dr USING (battle_id, base)""", ("steps0",))
def j21(spark, d):
    from ..operators.sampling import weighted_draw
    k = F.col("k")
    rows = view(spark, d, "steps0").select("event_id", "battle_id", "ts", "base", F.when(k % 10 == 0, F.concat(F.lit("t"), (k % 4).cast("string"))).alias("tera"))
    usage = rows.where("tera is not null").groupBy("base", F.col("tera").alias("key")).agg(F.count("*").alias("share"))
    options = rows.select("battle_id", "base").distinct().join(usage, "base")
    draws = weighted_draw(options, ["battle_id", "base"], "key", "share", 1, "tera").select("battle_id", "base", F.col("key").alias("drawn"))
    return mt.complete_attribute(rows, ["battle_id"], "base", ["ts"], "tera", draws).select("event_id", "tera")


@query("J22_names_to_ids", """WITH n AS (SELECT l_orderkey, 'nation' || (l_suppkey % 30) AS key FROM lineitem), i AS (SELECT 'nation' || n_nationkey AS key, n_nationkey AS id FROM nation),
g AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM n JOIN i USING (key) GROUP BY 1)
SELECT l_orderkey, ids, NULL AS unknown FROM g UNION ALL SELECT l_orderkey, NULL, key FROM n LEFT JOIN i USING (key) WHERE id IS NULL""")
def j22(spark, d):
    from ..functions.text import clean_name
    teams = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("Nation-"), (F.col("l_suppkey") % 30).cast("string")).alias("name"))
    ids = table(spark, d, "nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").alias("id"))
    good, bad = mt.names_to_ids(teams, ids, "l_orderkey", clean_name(F.col("name")))
    null = F.lit(None).cast("string")
    return good.select("l_orderkey", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), null.alias("unknown")).unionByName(
        bad.select("l_orderkey", null.alias("ids"), F.col("key").alias("unknown")))


@query("Q10_contradictions", """SELECT team_id, l_partkey, l_linenumber, 'PredictionContradictsReveal' AS reason FROM records
GROUP BY 1, 2, 3 HAVING min(item) = 'R' OR min(mv1) = 'b1' OR min(mv2) IS NOT NULL""", ("records",))
def q10(spark, d):
    on = ["team_id", "l_partkey", "l_linenumber"]
    revealed = merged_records(spark, d, on)
    predicted = revealed.select(*on, F.lit("A").alias("item"), F.array(*[F.lit(m) for m in ("a1", "a2", "b0")]).alias("moves"))
    return mt.contradictions(revealed, predicted, on, ["item"], ["moves"])
