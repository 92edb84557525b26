"""Queries on scalar functions, filters, orders and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import actions, dates, encoding, records, text
from ..operators import events, filters, ordering, sequences, sets
from .base import query, table, view

_CLEAN = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_LETTERS = "lower(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"


# -- scalar functions ------------------------------------------------------------

@query("X1_clean_names", f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned, md5({_LETTERS.format('text')}) AS letters FROM documents")
def x1(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_name(t)).alias("cleaned"),
                                               F.md5(text.clean_letters(t)).alias("letters"))


@query("X2_move_ids", f"""WITH m AS (SELECT event_id, {_LETTERS.format('a2')} AS m FROM log WHERE type = 'move')
SELECT event_id, CASE WHEN m LIKE 'hiddenpower%' THEN 'hiddenpower' WHEN m = 'vicegrip' THEN 'visegrip'
 WHEN m LIKE 'return%' THEN 'return' ELSE m END AS move FROM m""", ("log",))
def x2(spark, d):
    return view(spark, d, "log").where("type = 'move'").select("event_id", text.move_id(F.col("a2")).alias("move"))


@query("X3_hp_fractions", """SELECT event_id, CAST(split_part(a2, '/', 1) AS INT) AS hp, 100 AS max_hp,
 round(CAST(split_part(a2, '/', 1) AS INT) / 100, 6) AS share FROM log WHERE type IN ('-damage', '-heal')""", ("log",))
def x3(spark, d):
    raw = F.col("a2")
    return view(spark, d, "log").where("type in ('-damage', '-heal')").select(
        "event_id", text.hp_current(raw).alias("hp"), text.hp_maximum(raw).alias("max_hp"),
        F.round(text.hp_fraction(raw), 6).alias("share"))


@query("X4_annotations", """SELECT event_id, CASE WHEN a3 LIKE '[from] item%' THEN a3[14:] END AS item,
 CASE WHEN a3 LIKE '[from] ability%' THEN a3[17:] END AS ability, CASE WHEN a3 LIKE '[from] move%' THEN a3[14:] END AS move,
 CASE WHEN a4 <> '' THEN a4[6:] END AS entity FROM log WHERE type IN ('-damage', '-heal')""", ("log",))
def x4(spark, d):
    args = F.array("a1", "a2", "a3", "a4")
    return view(spark, d, "log").where("type in ('-damage', '-heal')").select(
        "event_id", text.source_of(args, "item").alias("item"), text.source_of(args, "ability").alias("ability"),
        text.source_of(args, "move").alias("move"), text.entity_of(args).alias("entity"))


_HELD = """CASE WHEN {0} IS NULL THEN 'unknown{1}' WHEN {0} IN ('', 'none') THEN 'no{1}' ELSE {2} END"""


@query("X8_canonical_tokens", f"""
WITH r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'No Item' ELSE s_name END AS item,
 CASE s_suppkey % 3 WHEN 0 THEN 'unknown_ability' WHEN 1 THEN 'noability' ELSE s_name END AS ability,
 CASE WHEN s_suppkey % 2 = 0 THEN 'PAR' END AS status FROM supplier)
SELECT s_suppkey, CASE WHEN item IS NULL THEN 'unknownitem' WHEN item IN ('', 'No Item') THEN 'noitem' ELSE 'supplier' END AS item,
 CASE ability WHEN 'unknown_ability' THEN 'unknownability' WHEN 'noability' THEN 'noability' ELSE 'supplier' END AS ability,
 coalesce(lower(status), 'nostatus') AS status,
 CASE WHEN s_suppkey % 2 = 0 THEN 'fire notype' ELSE 'flying water' END AS types FROM r""")
def x8(spark, d):
    k, name = F.col("s_suppkey"), F.col("s_name")
    item = F.when(k % 4 == 0, None).when(k % 4 == 1, "").when(k % 4 == 2, "No Item").otherwise(name)
    ability = F.when(k % 3 == 0, "unknown_ability").when(k % 3 == 1, "noability").otherwise(name)
    types = F.when(k % 2 == 0, F.array(F.lit("Fire"))).otherwise(F.array(F.lit("Water"), F.lit("Flying")))
    return table(spark, d, "supplier").select(
        "s_suppkey", encoding.held_token(item, "item").alias("item"), encoding.held_token(ability, "ability").alias("ability"),
        encoding.status_token(F.when(k % 2 == 0, "PAR")).alias("status"), encoding.types_token(types).alias("types"))


@query("X9_scaled_features", """SELECT p_partkey, round(p_size / 100.0, 6) AS level, round((p_partkey % 256) / 255.0, 6) AS stat,
 round((p_partkey % 13 - 6) / 6.0, 6) AS boost, round((p_partkey % 200) / 200.0, 6) AS power, -2.0::DOUBLE AS padding, 10 AS width FROM part""")
def x9(spark, d):
    k = F.col("p_partkey")
    member = encoding.scale_member(F.lit(0.5), F.col("p_size"), [k % 256], [k % 13 - 6])
    move = encoding.scale_move(k % 200, F.lit(1.0), F.lit(0))
    nums = encoding.pad_numbers(F.concat(member, move), 10)
    at = lambda i, n: F.round(F.element_at("x", i), 6).alias(n)
    return table(spark, d, "part").select("p_partkey", nums.alias("x")).select(
        "p_partkey", at(2, "level"), at(3, "stat"), at(4, "boost"), at(5, "power"), at(10, "padding"), F.size("x").alias("width"))


@query("X10_resource_buckets", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 50 >= 0.5 THEN 3 WHEN l_quantity / 50 >= 0.25 THEN 2
 WHEN l_quantity > 0 THEN 1 ELSE 0 END AS bucket FROM lineitem""")
def x10(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", encoding.resource_bucket(
        F.col("l_quantity"), F.lit(50.0)).alias("bucket"))


@query("X11_observation_text", """
SELECT event_id, '<gen1ou> ' || CASE WHEN forced_switch THEN '<forcedswitch>' ELSE '<anychoice>' END || ' <player> ' || base || ' ' || status
 || ' <move> mv' || (k % 4) || ' physical normal' || repeat(' <move> <blank> <blank> <blank>', 3)
 || ' <switch> ' || bench_base || repeat(' <blank>', 7) || repeat(' <switch>' || repeat(' <blank>', 8), 4)
 || ' <opponent> ' || foe_base || ' ' || foe_status || ' <conditions> noweather noconditions noconditions'
 || ' <player_prev> nomove <opp_prev> nomove' AS text FROM steps0""", ("steps0",))
def x11(spark, d):
    lit = lambda *w: F.array(*[F.lit(x) for x in w])
    move = F.array(F.concat(F.lit("mv"), (F.col("k") % 4).cast("string")), F.lit("physical"), F.lit("normal"))
    switch = encoding.pad_words(F.array("bench_base"), 8)
    obs = encoding.observation_text(
        F.lit("gen1ou"), F.col("forced_switch"), F.array("base", "status"), F.array(move), F.array(switch),
        F.array("foe_base", "foe_status"), lit("noweather", "noconditions", "noconditions"), lit("nomove"), lit("nomove"))
    return view(spark, d, "steps0").select("event_id", obs.alias("text"))


@query("X12_hp_characters", """SELECT event_id, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE
 array_to_string(string_split(printf('%.2f', hp), ''), ' ') END AS chars FROM steps0""", ("steps0",))
def x12(spark, d):
    hp = F.when(F.col("k") % 5 != 0, F.col("hp"))
    return view(spark, d, "steps0").select("event_id", encoding.hp_characters(hp).alias("chars"))


@query("X13_tokenise", """
WITH v AS (SELECT w, row_number() OVER (ORDER BY w) AS id FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark)),
r AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations)
SELECT conv_id, turn, md5(string_agg(CAST(coalesce(id, 0) AS VARCHAR), ' ' ORDER BY pos)) AS tokens, count(*) AS n,
 count(CASE WHEN id IS NULL THEN 1 END) AS unknown FROM r LEFT JOIN v USING (w) GROUP BY 1, 2""")
def x13(spark, d):
    from ..operators.aggregates import vocabulary
    split = lambda t: F.split(t, " ")
    words = table(spark, d, "benchmark").select(F.explode(split(F.col("text"))).alias("word"))
    out = sequences.tokenise_rows(table(spark, d, "conversations"), ["conv_id", "turn"], split(F.col("text")),
                                  vocabulary(words, "word"), 0)
    return out.select("conv_id", "turn", F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ")).alias("tokens"),
                      F.size("tokens").cast("bigint").alias("n"),
                      F.size(F.filter("tokens", lambda t: t == 0)).cast("bigint").alias("unknown"))


@query("X14_action_index", """
WITH a AS (SELECT event_id, k, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'Recharge' WHEN k % 9 < 4 THEN 'Switch' ELSE chr(97 + k % 5) END AS nm,
 k % 2 = 0 AS tera, 'm' || (k % 7) AS target, base, bench_base FROM steps0)
SELECT event_id, CAST(CASE WHEN nm IS NULL THEN -1 WHEN nm = 'Recharge' THEN 0 WHEN nm = 'Switch' AND target = base THEN -1
 WHEN nm = 'Switch' THEN CASE WHEN target = bench_base THEN 4 END
 WHEN nm = 'e' THEN NULL ELSE ascii(nm) - 97 + CASE WHEN tera THEN 9 ELSE 0 END END AS INT) AS action FROM a""", ("steps0",))
def x14(spark, d):
    k = F.col("k")
    name = F.when(k % 9 == 0, None).when(k % 9 == 1, "Recharge").when(k % 9 < 4, "Switch").otherwise(F.chr(97 + k % 5))
    moves = ordering.canonical_order(F.array(*[F.lit(m) for m in "dbca"]))
    idx = actions.action_index(name, k % 2 == 0, name == "Switch", F.concat(F.lit("m"), (k % 7).cast("string")),
                               F.col("base"), moves, F.array("bench_base"))
    return view(spark, d, "steps0").select("event_id", idx.alias("action"))


@query("X15_legal_actions", """
WITH l AS (SELECT event_id, list_concat(CASE WHEN forced_switch THEN [] ELSE range(0, 1 + k % 4) END, list_concat(range(4, 4 + n_switches),
  CASE WHEN forced_switch OR NOT can_tera THEN [] ELSE range(9, 10 + k % 4) END)) AS legal, k % 14 - 1 AS act FROM steps0)
SELECT event_id, array_to_string(legal, ',') AS legal,
 array_to_string(list_transform(range(13), lambda i: CASE WHEN list_contains(legal, i) THEN '0' ELSE '1' END), '') AS illegal_mask,
 array_to_string(list_transform(range(13), lambda i: CASE WHEN i = greatest(act, 0) THEN '1' ELSE '0' END), '') AS chosen,
 CAST(act = -1 AS INT) AS missing FROM l""", ("steps0",))
def x15(spark, d):
    legal = actions.legal_actions(F.col("forced_switch"), F.col("can_tera"), 1 + F.col("k") % 4, F.col("n_switches"))
    act = F.col("k") % 14 - 1
    s = view(spark, d, "steps0").withColumn("l", legal).withColumn("act", act)
    bits = lambda arr: F.array_join(F.transform(arr, lambda x: x.cast("int").cast("string")), "")
    return s.select("event_id", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("legal"),
                    bits(actions.illegal_mask(F.col("l"))).alias("illegal_mask"),
                    bits(actions.one_hot(F.col("act"))).alias("chosen"),
                    actions.is_missing(F.col("act")).cast("int").alias("missing"))


@query("X16_narrowed_actions", "SELECT event_id, CAST(CASE WHEN k % 13 >= 9 THEN k % 13 - 9 ELSE k % 13 END AS INT) AS action FROM steps0", ("steps0",))
def x16(spark, d):
    return view(spark, d, "steps0").select("event_id", actions.without_tera(F.col("k") % 13).alias("action"))


@query("X18_canonical_teams", """
WITH t AS (SELECT l_orderkey, list(l_suppkey % 10) AS ids FROM lineitem GROUP BY 1),
e AS (SELECT *, CASE WHEN len(list_distinct(ids)) <> len(ids) THEN 'DuplicateMember' WHEN len(ids) <> 4 THEN 'TeamSize' END AS error FROM t)
SELECT l_orderkey, CASE WHEN error IS NULL THEN array_to_string(list_sort(ids), ',') END AS team, error FROM e""")
def x18(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("m"))
    good, bad = records.canonical_teams(rows, "l_orderkey", "m", 4)
    null = F.lit(None).cast("string")
    return good.select("l_orderkey", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("team"), null.alias("error")).unionByName(
        bad.select("l_orderkey", null.alias("team"), F.col("reason").alias("error")))


@query("X18_parsed_teams", """SELECT c_custkey, list_sort(list_distinct([c_custkey % 7, c_nationkey, c_custkey % 5]))::VARCHAR AS team,
 CASE WHEN len(list_distinct([c_custkey % 7, c_nationkey, c_custkey % 5])) <> 3 THEN 'DuplicateMember' END AS error FROM customer""")
def x18_parsed(spark, d):
    k = F.col("c_custkey")
    raw = F.concat((k % 7).cast("string"), F.lit(", "), F.col("c_nationkey").cast("string"), F.lit("  "), (k % 5).cast("string"))
    rows = table(spark, d, "customer").select("c_custkey", records.parse_team_ids(raw).alias("ids"))
    shown = F.concat(F.lit("["), F.array_join(F.transform(records.canonical_team(F.col("ids")), lambda i: i.cast("string")), ", "), F.lit("]"))
    return rows.select("c_custkey", shown.alias("team"), records.team_error(F.col("ids")).alias("error"))


_NM = "len(list_filter([mv0, mv1, mv2, mv3], lambda x: x IS NOT NULL))"


@query("X19_known_fields", f"""SELECT team_id, l_partkey, l_linenumber, CAST({_NM} + (item IS NOT NULL)::INT + (ability IS NOT NULL)::INT + (nature IS NOT NULL)::INT AS INT) AS known,
 array_to_string(list_filter([CASE WHEN item IS NULL THEN 'item' END, CASE WHEN nature IS NULL AND l_quantity < 10 THEN 'nature' END], lambda x: x IS NOT NULL), ',') AS added
 FROM records""", ("records",))
def x19(spark, d):
    r = view(spark, d, "records")
    moves = F.array("mv0", "mv1", "mv2", "mv3")
    known = {"item": F.col("item"), "nature": F.col("nature")}
    fuller = {"item": F.lit("A"), "nature": F.when(F.col("l_quantity") < 10, "calm")}
    added = records.added_details(known, fuller)
    return r.select("team_id", "l_partkey", "l_linenumber",
                    records.known_fields([F.col("item"), F.col("ability"), F.col("nature")], moves).alias("known"),
                    F.array_join(F.map_keys(added), ",").alias("added"))


@query("X20_date_bins", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate)::DATE AS VARCHAR) AS month,
 CAST(make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1) AS VARCHAR) AS half_start,
 CAST(make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END, 1) AS VARCHAR) AS half_end,
 CAST(greatest(least(date_trunc('month', o_orderdate)::DATE, DATE '2000-06-01'), DATE '1996-01-01') AS VARCHAR) AS clamped FROM orders""")
def x20(spark, d):
    c = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.month_start(c).cast("string").alias("month"), dates.half_year_start(c).cast("string").alias("half_start"),
        dates.half_year_end(c).cast("string").alias("half_end"),
        dates.clamp_month(c, datetime.date(1996, 1, 1), datetime.date(2000, 6, 1)).cast("string").alias("clamped"))


@query("X21_team_sequences", """
WITH x AS (SELECT *, 'Mon: ' || name AS n, coalesce('Ability: ' || ability, '?') AS a, coalesce('Item: ' || item, '?') AS i,
 array_to_string(list_transform([mv0, mv1, mv2, mv3], lambda m: coalesce('Move: ' || m, '?')), '|') AS m,
 (ability IS NULL)::INT::VARCHAR || (item IS NULL)::INT::VARCHAR AS hid,
 array_to_string(list_transform([mv0, mv1, mv2, mv3], lambda m: CASE WHEN m IS NULL THEN '1' ELSE '0' END), '') AS hm FROM records)
SELECT team_id, l_partkey, l_linenumber, 'Format: gen1ou|' || n || '|' || a || '|' || i || '|?|' || m AS tokens, '00' || hid || '0' || hm AS mask,
 '012384444' AS types FROM x""", ("records",))
def x21(spark, d):
    member = lambda fill: F.struct(
        F.col("name").cast("string").alias("name"), F.coalesce("ability", fill).alias("ability"), F.coalesce("item", fill).alias("item"),
        F.lit(None).cast("string").alias("tera_type"),
        F.transform(F.array("mv0", "mv1", "mv2", "mv3"), lambda m: F.coalesce(m, fill)).alias("moves"))
    seq = lambda fill: sequences.team_sequence(F.lit("gen1ou"), F.array(member(fill)))
    r = view(spark, d, "records").withColumn("x", seq(F.lit(None).cast("string"))).withColumn("y", seq(F.lit("truth")))
    return r.select("team_id", "l_partkey", "l_linenumber",
                    F.array_join(F.transform("x", lambda t: F.coalesce(t["token"], F.lit("?"))), "|").alias("tokens"),
                    F.array_join(F.transform(sequences.prediction_mask(F.col("x"), F.col("y")), lambda b: b.cast("int").cast("string")), "").alias("mask"),
                    F.array_join(F.transform("x", lambda t: t["type"].cast("string")), "").alias("types"))


@query("X22_message_columns", """SELECT event_id, CASE WHEN type = 'move' THEN a2 END AS move,
 CASE WHEN type IN ('switch','drag') THEN split_part(a2, ',', 1) END AS switched_to,
 CASE WHEN type IN ('switch','drag') THEN CAST(regexp_extract(a2, ', L([0-9]+)', 1) AS INT) END AS level,
 CASE WHEN type = 'faint' THEN substr(a1, 6) END AS fainted, CASE WHEN type = '-status' THEN a2 END AS status,
 CASE WHEN a1 LIKE 'p_a:%' THEN substr(a1, 1, 2) END AS side FROM log""", ("log",))
def x22(spark, d):
    rows = view(spark, d, "log").withColumn("args", F.array("a1", "a2", "a3", "a4"))
    return events.message_columns(rows).select("event_id", "move", "switched_to", "level", "fainted", "status", F.col("slot_side").alias("side"))


@query("X23_export_blocks", """SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' @ Item ' || s_nationkey ELSE '' END
 || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || 'Tera Type: Fire' ELSE '' END || chr(10) || 'Ability: A' || s_nationkey
 || chr(10) || 'EVs: 84 HP' || chr(10) || 'Serious Nature' || chr(10) || '- m1' || chr(10) || '- m' || s_nationkey AS block FROM supplier""")
def x23(spark, d):
    n = F.col("s_nationkey").cast("string")
    block = encoding.export_block(
        F.col("s_name"), F.array(F.lit("m1"), F.concat(F.lit("m"), n)), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Item "), n)),
        F.when(F.col("s_suppkey") % 3 == 0, "Fire"), F.concat(F.lit("A"), n), F.lit("84 HP"), F.lit("Serious"))
    return table(spark, d, "supplier").select("s_suppkey", block.alias("block"))


@query("X24_clause_keys", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'num:' || p_size WHEN p_partkey % 3 = 1 THEN
 'base:' || lower(regexp_replace(p_brand, '[^\\p{L}\\p{N}]', '', 'g')) ELSE 'name:' || lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) END AS clause_key FROM part""")
def x24(spark, d):
    k = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", records.clause_key(
        F.when(k == 0, F.col("p_size")), F.when(k == 1, F.col("p_brand")), F.col("p_name")).alias("clause_key"))


@query("X25_expected_moves", """SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 5 = 1 THEN CASE WHEN 1 + p_partkey % 9 >= 4 THEN 2 ELSE least(4, p_size) END
 WHEN p_partkey % 7 = 0 THEN 4 ELSE least(4, p_size) END AS INT) AS size FROM part""")
def x25(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "ditto").when(k % 5 == 1, "combee").otherwise("other")
    options = F.when((k % 5 > 1) & (k % 7 == 0), None).otherwise(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", records.expected_moves(name, 1 + k % 9, options).alias("size"))


@query("X26_overwritten_field", """SELECT event_id, base || ':notype ' || bench_base || ':notype' AS members FROM steps0""", ("steps0",))
def x26(spark, d):
    m = lambda c: F.struct(F.col(c).alias("base"), F.lit("fire").alias("tera_type"))
    out = records.overwrite_field(F.array(m("base"), m("bench_base")), "tera_type", "notype")
    return view(spark, d, "steps0").select("event_id", F.array_join(F.transform(
        out, lambda x: F.concat_ws(":", x["base"], x["tera_type"])), " ").alias("members"))


@query("X27_padded_batches", """
WITH t AS (SELECT conv_id, turn, conv_id % 16 AS batch, list_transform(string_split(text, ' '), lambda w: len(w)) AS tok FROM conversations),
m AS (SELECT batch, least(max(len(tok)) + 1, 200) AS l FROM t GROUP BY 1)
SELECT conv_id, turn, CAST(least(len(tok) + 1, l) AS INT) AS length, CAST(l AS INT) AS width,
 md5(array_to_string(list_resize(list_append(tok, -9), l, 0), ',')) AS tokens FROM t JOIN m USING (batch)""")
def x27(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") % 16).alias("batch"), F.transform(F.split("text", " "), lambda w: F.length(w)).alias("tokens"))
    out = sequences.pad_batches(rows, ["batch"], "tokens", -9, 0, 200)
    return out.select("conv_id", "turn", "length", F.size("tokens").alias("width"),
                      F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("tokens"))


# -- filters -----------------------------------------------------------------------

_RATE = "CASE WHEN o_orderkey % 10 = 0 THEN 'Unrated' ELSE CAST(1000 + o_orderkey % 900 AS VARCHAR) END"
_DATE = "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END"


def meta(spark, d):
    """Battle metadata as text, as file names carry it."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 10 == 0, "Unrated").otherwise((1000 + k % 900).cast("string")).alias("rating"),
        F.when(k % 11 == 0, "someday").when(k % 2 == 0, F.date_format("o_orderdate", "MM-dd-yyyy")).otherwise(
            F.date_format("o_orderdate", "MM-dd-yyyy-HH:mm:ss")).alias("played_text"),
        F.when(F.col("o_orderstatus") == "F", "WIN").otherwise("LOSS").alias("result"),
        (k % 13 == 0).alias("tournament"), F.concat(F.lit("gen"), (1 + k % 9).cast("string"), F.lit("ou")).alias("format"))


META_SQL = f"""meta AS (SELECT o_orderkey, {_RATE} AS rating, coalesce(TRY_CAST({_RATE} AS INT), 1000) AS r, {_DATE} AS played,
 CASE o_orderstatus WHEN 'F' THEN 'WIN' ELSE 'LOSS' END AS result, o_orderkey % 13 = 0 AS tournament, 'gen' || (1 + o_orderkey % 9) || 'ou' AS format FROM orders)"""

def played():
    return dates.parse_battle_date(F.col("played_text"))


@query("F1_battle_filter", f"""WITH {META_SQL} SELECT o_orderkey FROM meta WHERE result = 'WIN' AND r <= 1700
 AND played >= TIMESTAMP '1996-01-01' AND played <= TIMESTAMP '2000-01-01'""")
def f1(spark, d):
    rule = filters.BattleFilter("wins", 0, 1700, datetime.date(1996, 1, 1), datetime.date(2000, 1, 1))
    return meta(spark, d).where(rule.condition(F.col("result"), F.col("rating"), played())).select("o_orderkey")


@query("F2_team_file_filter", f"""WITH {META_SQL} SELECT o_orderkey FROM meta WHERE r >= 0 AND r <= 1500 AND played IS NOT NULL""")
def f2(spark, d):
    rule = filters.BattleFilter(min_rating=0, max_rating=1500, zero_is_bound=True, dates_required=True)
    return meta(spark, d).where(rule.condition(F.col("result"), F.col("rating"), played())).select("o_orderkey")


@query("F3_elite", f"""WITH {META_SQL} SELECT o_orderkey FROM meta WHERE (r >= 1600 OR tournament) AND played >= TIMESTAMP '1997-01-01'""")
def f3(spark, d):
    return filters.elite(meta(spark, d), F.col("rating"), F.col("tournament"), played(), 1600, datetime.date(1997, 1, 1)).select("o_orderkey")


@query("F3_elite_sizes", f"""WITH {META_SQL} SELECT format, count(CASE WHEN r >= 1600 THEN 1 END) AS high, count(CASE WHEN tournament THEN 1 END) AS tournament,
 count(CASE WHEN r >= 1600 AND tournament THEN 1 END) AS "both", count(CASE WHEN r >= 1600 OR tournament THEN 1 END) AS either FROM meta GROUP BY 1""")
def f3_sizes(spark, d):
    return filters.elite_sizes(meta(spark, d), ["format"], F.col("rating"), F.col("tournament"), 1600)


@query("F4_keyed_threshold", """WITH t AS (SELECT lang, max(n_chars) / 4 AS bound FROM documents WHERE lang < 'f' GROUP BY 1)
SELECT doc_id FROM documents LEFT JOIN t USING (lang) WHERE n_chars >= coalesce(bound, 1500)""")
def f4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    bounds = docs.where("lang < 'f'").groupBy("lang").agg((F.max("n_chars") / 4).alias("bound"))
    return filters.keyed_threshold(docs, bounds, "lang", "bound", F.col("n_chars"), 1500).select("doc_id")


@query("F5_team_sets", f"""WITH {META_SQL} SELECT 'gl' AS kind, o_orderkey FROM meta WHERE played BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01'
UNION ALL SELECT 'hl', o_orderkey FROM meta WHERE played BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01' AND (r >= 1500 OR tournament)""")
def f5(spark, d):
    pick = lambda kind: filters.team_set(
        meta(spark, d), kind, F.col("rating"), F.col("tournament"), played(), datetime.date(1996, 1, 1), datetime.date(1999, 1, 1),
        1500).select(F.lit(kind).alias("kind"), "o_orderkey")
    return sets.union_sources(pick("gl"), pick("hl"))


@query("F6_formats", """SELECT battle_id, lower(format) AS fmt, CASE WHEN lower(format) = 'random battle' THEN 'gen1random' ELSE lower(format) END AS alias,
 CAST(nullif(regexp_extract(id, 'gen([0-9]+)', 1), '') AS INT) AS gen FROM raw_battles""", ("raw_battles",))
def f6(spark, d):
    return view(spark, d, "raw_battles").select(
        "battle_id", F.lower("format").alias("fmt"), filters.format_alias(F.col("format"), {"random battle": "gen1random"}).alias("alias"),
        filters.format_generation(F.col("id")).alias("gen"))


@query("F7_eligible_entities", """WITH c AS (SELECT gen, entity, sum(qty) AS n, count(DISTINCT pick) AS options FROM picks GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY gen) AS share FROM c)
SELECT gen, entity, CAST(n AS BIGINT) AS n, round(share, 6) AS share FROM s WHERE share >= 0.02 AND options >= 4""", ("picks",))
def f7(spark, d):
    c = view(spark, d, "picks").groupBy("gen", "entity").agg(F.sum("qty").alias("n"), F.count_distinct("pick").alias("options"))
    return filters.eligible_entities(c, ["gen"], "n", F.col("options"), 0.02).select("gen", "entity", "n", F.round("share", 6).alias("share"))


@query("F8_supported_keys", """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN
 (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 35)""")
def f8(spark, d):
    return filters.supported_keys(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_partkey", 35).select(
        "l_orderkey", "l_partkey", "l_linenumber")


@query("F9_legal_in_tier", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 40")
def f9(spark, d):
    legality = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("tier"))
    return filters.legal_in_tier(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), legality,
                                 "l_partkey", "tier", 40).select("l_orderkey", "l_partkey", "l_linenumber")


@query("F11_sentinels", """SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)
 WHERE lower(w) NOT IN ('the', 'le', '')""")
def f11(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return filters.without_sentinels(words, F.col("w"), ("the", "le", ""))


@query("F12_conflict_free", """
WITH t AS (SELECT l_orderkey, list(l_suppkey % 20 ORDER BY l_suppkey) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey FROM t WHERE len(list_distinct(ids)) = len(ids) AND NOT (list_contains(ids, 3) AND list_contains(ids, 7))
 AND NOT (list_contains(ids, 1) AND list_contains(ids, 2))""")
def f12(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 20).alias("id"))
    conflicts = spark.createDataFrame([(3, 7), (1, 2)], "x long, y long")
    return filters.conflict_free(rows, ["l_orderkey"], "id", conflicts)


@query("F13_score_floor", "SELECT doc_id FROM documents WHERE n_chars >= 1000")
def f13(spark, d):
    return filters.score_floor(table(spark, d, "documents"), F.col("n_chars"), 1000).select("doc_id")


@query("F15_clause_legality", """WITH t AS (SELECT l_orderkey, list(l_suppkey % 30) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(list_distinct(list_transform(ids, lambda i: CASE WHEN i = 5 THEN 4 ELSE i END))) = len(ids) AS INT) AS legal FROM t""")
def f15(spark, d):
    clause = F.when(F.col("l_suppkey") % 30 == 5, 4).otherwise(F.col("l_suppkey") % 30)
    return filters.clause_legality(table(spark, d, "lineitem"), ["l_orderkey"], clause).withColumn("legal", F.col("legal").cast("int"))


# -- orders ------------------------------------------------------------------------

@query("O1_generation_score", "SELECT lang, doc_id, n_chars FROM documents ORDER BY lang, n_chars DESC, doc_id")
def o1(spark, d):
    return ordering.by_generation_and_score(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "n_chars", "doc_id")


@query("O2_win_rate_order", """SELECT o_custkey, count(*) AS games, round(avg(CASE WHEN result = 'WIN' THEN 1.0 ELSE 0 END), 6) AS win_rate
FROM results GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1""", ("results",))
def o2(spark, d):
    from ..operators.aggregates import win_rates
    w = win_rates(view(spark, d, "results"), ["o_custkey"], F.col("result"))
    return ordering.by_win_rate(w, "win_rate", "games", "o_custkey").select("o_custkey", "games", F.round("win_rate", 6).alias("win_rate"))


@query("O3_newest", "SELECT o_orderkey, CAST(o_orderdate::DATE AS VARCHAR) AS played FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def o3(spark, d):
    out = ordering.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 200)
    return out.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("played"))


@query("O4_natural_order", """SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '([0-9]+)', 1) = '',
 TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), source) AS place FROM (SELECT DISTINCT source FROM documents)""")
def o4(spark, d):
    from ..operators.ordered import ranked
    key = ordering.natural_key(F.col("source"))
    src = table(spark, d, "documents").select("source").distinct().withColumn("k", key)
    return ranked(src, [], F.floor(F.coalesce("k.number", F.lit(1 << 40)) / 64), ["k"], "place").select("source", "place")


@query("O5_top_entries", """WITH w AS (SELECT entity, pick, sum(qty) AS n FROM picks GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, 'p' || pick DESC) AS rn FROM w WHERE pick <> 7)
SELECT entity, string_agg('p' || pick, ',' ORDER BY rn) AS best FROM r WHERE rn <= 4 GROUP BY 1""", ("picks",))
def o5(spark, d):
    name = F.when(F.col("pick") == 7, "Other").otherwise(F.concat(F.lit("p"), F.col("pick").cast("string")))
    cells = view(spark, d, "picks").groupBy("entity", name.alias("k")).agg(F.sum("qty").alias("v"))
    m = cells.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return m.select("entity", F.array_join(ordering.top_entries(F.col("m"), 4), ",").alias("best"))


@query("O6_canonical_order", """WITH p AS (SELECT n_regionkey, n_name, lower(regexp_replace(n_name, '[^\\p{L}\\p{N}]', '', 'g')) AS c FROM nation)
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY c, n_name) AS members FROM p GROUP BY 1""")
def o6(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("m"))
    return g.select("n_regionkey", F.array_join(ordering.canonical_order(F.col("m")), ",").alias("members"))


@query("O7_reveal_order", """
WITH s AS (SELECT team_id, l_partkey, l_linenumber, unnest([mv0, mv1, NULL, '<none>']) AS seen, unnest([mv0, mv1, mv2, NULL]) AS truth
 FROM (SELECT DISTINCT team_id, l_partkey, l_linenumber, mv0, mv1, mv2 FROM records))
SELECT team_id, l_partkey, l_linenumber, string_agg(coalesce(seen, '?' || coalesce(truth, '')), ',' ORDER BY
  CASE WHEN seen = '<none>' THEN 3 WHEN seen IS NOT NULL THEN 0 WHEN truth IS NOT NULL THEN 1 ELSE 2 END, coalesce(seen, truth)) AS slots
FROM s GROUP BY 1, 2, 3""", ("records",))
def o7(spark, d):
    r = view(spark, d, "records").select("team_id", "l_partkey", "l_linenumber", "mv0", "mv1", "mv2").dropDuplicates(
        ["team_id", "l_partkey", "l_linenumber"])
    pair = lambda a, b: F.struct(a.cast("string").alias("seen"), b.cast("string").alias("truth"))
    arr = F.array(pair(F.col("mv0"), F.col("mv0")), pair(F.col("mv1"), F.col("mv1")), pair(F.lit(None), F.col("mv2")),
                  pair(F.lit("<none>"), F.lit(None)))
    shown = F.transform(ordering.reveal_order(arr), lambda p: F.coalesce(p["seen"], F.concat(F.lit("?"), F.coalesce(p["truth"], F.lit("")))))
    return r.select("team_id", "l_partkey", "l_linenumber", F.array_join(shown, ",").alias("slots"))


@query("O8_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('team:' || doc_id), doc_id LIMIT 150")
def o8(spark, d):
    return ordering.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 150, "team")


# -- set operations ------------------------------------------------------------------

@query("U1_union", "SELECT s_name AS name, s_nationkey AS nation, NULL AS segment FROM supplier UNION SELECT c_name, c_nationkey, c_mktsegment FROM customer")
def u1(spark, d):
    return sets.union_sources(
        table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
        table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                                           F.col("c_mktsegment").alias("segment")), distinct=True)


@query("U2_difference", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def u2(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return sets.only_in(table(spark, d, "part").select("p_partkey"), used, ["p_partkey"])


@query("U3_intersection", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def u3(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return sets.in_both(table(spark, d, "part").select("p_partkey"), used, ["p_partkey"])


@query("U4_mirrors", """SELECT match_id, 0 AS mirrored, a, b, CASE WHEN result = 'WIN' THEN 1 ELSE 0 END AS y FROM results UNION ALL
SELECT match_id, 1, b, a, CASE WHEN result = 'WIN' THEN 0 ELSE 1 END FROM results""", ("results",))
def u4(spark, d):
    rows = view(spark, d, "results").select("match_id", "a", "b", (F.col("result") == "WIN").cast("int").alias("y"))
    return sets.with_mirror(rows, "a", "b", "y").withColumn("mirrored", F.col("mirrored").cast("int"))


_IDENT = """name || '[' || array_to_string(list_sort(list_distinct(list_filter([mv0, mv1, mv2, mv3], lambda x: x IS NOT NULL))), ',') || ']'
 || coalesce(item, '?') || coalesce(ability, '?')"""


@query("U5_distinct_sets", f"SELECT {_IDENT} AS identity, count(*) AS copies FROM records GROUP BY 1", ("records",))
def u5(spark, d):
    ident = sets.set_identity(F.col("name"), F.array("mv0", "mv1", "mv2", "mv3"), F.col("item"), F.col("ability"))
    out = sets.distinct_sets(view(spark, d, "records"), ident)
    i = F.col("identity")
    shown = F.concat(i["name"].cast("string"), F.lit("["), F.array_join(i["moves"], ","), F.lit("]"),
                     F.coalesce(i["item"], F.lit("?")), F.coalesce(i["ability"], F.lit("?")))
    return out.select(shown.alias("identity"), "copies")
