"""Queries on battle logs: messages, running state, trajectories and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.actions import legal_actions
from ..operators import checks, events, rewards, windows
from ..operators.ordered import neighbours, running
from .base import query, table, view

KEY, SEG, ORDER = ["battle_id"], "seg", ["ts", "event_id"]
W_SQL = "PARTITION BY battle_id ORDER BY ts, event_id"


def log(spark: SparkSession, d: str, name: str = "log") -> DataFrame:
    """Derived log with a segment per hour, so that no task holds a whole battle."""
    df = view(spark, d, name).withColumn(SEG, F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))
    if name != "log":
        return df
    return df.withColumn("args", F.array("a1", "a2", "a3", "a4"))


def log_with_turns(spark: SparkSession, d: str) -> DataFrame:
    return windows.turn_numbers(log(spark, d), KEY, SEG, ORDER, F.col("type") == "turn", F.col("a1").try_cast("int"))


TURNS_SQL = f"""turned AS (SELECT *, coalesce(last_value(CASE WHEN type = 'turn' THEN CAST(a1 AS INT) END IGNORE NULLS)
  OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS turn FROM log)"""


# -- windows over battle order ------------------------------------------------

@query("W1_turn_numbers", f"WITH {TURNS_SQL} SELECT event_id, turn FROM turned", ("log",))
def w1(spark, d):
    return log_with_turns(spark, d).select("event_id", "turn")


@query("W2_forward_fill", f"""
SELECT event_id, last_value(CASE WHEN type IN ('switch','drag') THEN a2 END IGNORE NULLS) OVER w AS species,
 last_value(CASE WHEN type = '-weather' THEN a1 END IGNORE NULLS) OVER w AS weather
FROM log WINDOW w AS ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ("log",))
def w2(spark, d):
    t = F.col("type")
    return windows.forward_fill(log(spark, d), KEY, SEG, ORDER, {
        "species": F.when(t.isin("switch", "drag"), F.col("a2")),
        "weather": F.when(t == "-weather", F.col("a1"))}).select("event_id", "species", "weather")


_SIDE = ["battle_id", "side"]
_FACT = "CASE WHEN type = '-{0}' THEN a2 END"


@query("W3_backward_fill", """
WITH f AS (SELECT *, CASE WHEN type = '-item' THEN a2 END AS i, CASE WHEN type = '-ability' THEN a2 END AS b FROM log)
SELECT event_id,
 coalesce(last_value(i IGNORE NULLS) OVER p, first_value(i IGNORE NULLS) OVER n) AS item,
 coalesce(last_value(b IGNORE NULLS) OVER p, first_value(b IGNORE NULLS) OVER n) AS ability
FROM f WINDOW p AS (PARTITION BY battle_id, side ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY battle_id, side ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", ("log",))
def w3(spark, d):
    t = F.col("type")
    return windows.backward_fill(log(spark, d), _SIDE, SEG, ORDER, {
        "item": F.when(t == "-item", F.col("a2")),
        "ability": F.when(t == "-ability", F.col("a2"))}).select("event_id", "item", "ability")


@query("W3_known_moves", """
WITH f AS (SELECT battle_id, side, a2 AS mv, min(ts) AS t0, min(event_id) AS e FROM log WHERE type = 'move' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY battle_id, side ORDER BY t0, e) AS rn FROM f)
SELECT battle_id, side, string_agg(mv, '|' ORDER BY rn) AS moves FROM r WHERE rn <= 4 GROUP BY 1, 2""", ("log",))
def w3_moves(spark, d):
    df = log(spark, d)
    out = windows.revealed_set(df, _SIDE, ORDER, F.when(F.col("type") == "move", F.col("a2")), 4, "moves")
    return out.select("battle_id", "side", F.array_join("moves", "|").alias("moves"))


@query("W4_no_future_for_opponent", f"""
WITH f AS (SELECT *, CASE WHEN side = 'p1' AND type = '-item' THEN a2 END AS o,
                     CASE WHEN side = 'p2' AND type = '-item' THEN a2 END AS x FROM log)
SELECT event_id, coalesce(last_value(o IGNORE NULLS) OVER p, first_value(o IGNORE NULLS) OVER n) AS own_item,
 last_value(x IGNORE NULLS) OVER p AS foe_item
FROM f WINDOW p AS ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", ("log",))
def w4(spark, d):
    item = F.when(F.col("type") == "-item", F.col("a2"))
    out = windows.point_of_view(log(spark, d), KEY, SEG, ORDER,
                                {"own_item": F.when(F.col("side") == "p1", item)},
                                {"foe_item": F.when(F.col("side") == "p2", item)})
    return out.select("event_id", "own_item", "foe_item")


@query("W5_align_actions", f"""
SELECT event_id, coalesce(lead(CASE WHEN type = 'move' THEN a2 END) OVER w,
  lead(CASE WHEN type = 'choice' THEN a1 END) OVER w, '-1') AS action FROM log WINDOW w AS ({W_SQL})""", ("log",))
def w5(spark, d):
    t = F.col("type")
    return windows.align_actions(log(spark, d), KEY, SEG, ORDER, F.when(t == "move", F.col("a2")),
                                 F.when(t == "choice", F.col("a1")), F.lit("-1")).select("event_id", "action")


def turns_of_talk(spark, d):
    return table(spark, d, "conversations").withColumn("seg", F.floor(F.col("turn") / 64))


@query("W6_transitions", """
SELECT * FROM (SELECT conv_id, turn, md5(text) AS state, role AS actor,
  md5(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS next_state FROM conversations) WHERE next_state IS NOT NULL""")
def w6(spark, d):
    out = windows.transitions(turns_of_talk(spark, d), ["conv_id"], "seg", ["turn"], F.md5("text"))
    return out.select("conv_id", "turn", F.md5("text").alias("state"), F.col("role").alias("actor"), "next_state")


REWARD_SQL = """
WITH l AS (SELECT *, lag(base) OVER w AS p_base, lag(hp) OVER w AS p_hp, lag(status) OVER w AS p_status,
  lag(bench_base) OVER w AS p_bb, lag(bench_hp) OVER w AS p_bh, lag(foe_base) OVER w AS p_fb, lag(foe_hp) OVER w AS p_fh,
  lag(foe_status) OVER w AS p_fs, lag(n_switches) OVER w AS p_n, lag(foes_left) OVER w AS p_l FROM steps0
  WINDOW w AS (PARTITION BY battle_id ORDER BY ts, event_id)),
m AS (SELECT *,
  CASE WHEN p_base = base THEN hp - p_hp WHEN p_bb = base THEN hp - p_bh ELSE 0 END AS gain,
  CASE WHEN p_base = base THEN CASE WHEN status <> 'nostatus' AND p_status = 'nostatus' THEN 1 ELSE 0 END
       WHEN p_bb = base THEN CASE WHEN status <> 'nostatus' THEN 1 ELSE 0 END ELSE 0 END AS took,
  CASE WHEN foe_base = p_fb THEN p_fh - foe_hp ELSE 0 END AS dmg,
  CASE WHEN foe_base = p_fb AND foe_status <> 'nostatus' AND p_fs = 'nostatus' THEN 1 ELSE 0 END AS gave,
  CASE WHEN p_n > n_switches THEN 1 ELSE 0 END AS lostm, CASE WHEN p_l > foes_left THEN 1 ELSE 0 END AS removed
  FROM l WHERE p_base IS NOT NULL)
SELECT event_id, round({0}, 6) AS reward FROM m"""


def steps(spark, d):
    s = log(spark, d, "steps0")
    member = lambda p, st: F.struct(F.col(f"{p}base").alias("base"), F.col(f"{p}hp").alias("hp"), st.alias("status"))
    state = F.struct(member("", F.col("status")).alias("own"),
                     F.array(member("bench_", F.lit("nostatus"))).alias("bench"),
                     member("foe_", F.col("foe_status")).alias("foe"),
                     "n_switches", "foes_left", "won", "lost")
    return s.withColumn("state", state)


def rewarded(spark, d, weights):
    prev = neighbours(steps(spark, d), KEY, SEG, ORDER, lag={"prev": F.col("state")})
    return prev.where(F.col("prev").isNotNull()).select(
        "event_id", F.round(rewards.transition_reward(F.col("prev"), F.col("state"), weights), 6).alias("reward"))


query("W7_shaped_reward", REWARD_SQL.format(
    "dmg + gain + 0.5 * (gave - took) + removed - lostm + CASE WHEN won THEN 100 WHEN lost THEN -100 ELSE 0 END"),
    ("steps0",))(lambda spark, d: rewarded(spark, d, rewards.SHAPED))
query("W8_aggressive_reward", REWARD_SQL.format(
    "dmg + gain + 2 * (removed - lostm) + CASE WHEN won THEN 200 ELSE 0 END"),
    ("steps0",))(lambda spark, d: rewarded(spark, d, rewards.AGGRESSIVE))
query("W8_terminal_reward", REWARD_SQL.format("CAST(CASE WHEN won THEN 100 WHEN lost THEN -100 ELSE 0 END AS DOUBLE)"),
      ("steps0",))(lambda spark, d: rewarded(spark, d, rewards.TERMINAL))


@query("W9_done_flags", f"SELECT event_id, CAST(lead(event_id) OVER ({W_SQL}) IS NULL AS INT) AS done FROM log", ("log",))
def w9(spark, d):
    return windows.done_flags(log(spark, d), KEY, SEG, ORDER).select("event_id", F.col("done").cast("int").alias("done"))


@query("W10_ever_and_revealed", """
WITH r AS (SELECT event_id, max(CASE WHEN foe_status = 'slp' THEN 1 ELSE 0 END) OVER w AS ever_slp,
  max(CASE WHEN foe_status = 'frz' THEN 1 ELSE 0 END) OVER w AS ever_frz, list(foe_base) OVER w AS l
  FROM steps0 WINDOW w AS (PARTITION BY battle_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, ever_slp, ever_frz, array_to_string(list_resize(list_sort(list_distinct(l)), 6, '<blank>'), ' ') AS seen FROM r""",
       ("steps0",))
def w10(spark, d):
    out = windows.ever_and_revealed(log(spark, d, "steps0"), KEY, SEG, ORDER,
                                    {"ever_slp": F.col("foe_status") == "slp", "ever_frz": F.col("foe_status") == "frz"},
                                    F.col("foe_base"))
    return out.select("event_id", "ever_slp", "ever_frz", F.array_join("seen", " ").alias("seen"))


@query("W11_random_slice", f"""
WITH r AS (SELECT event_id, battle_id, row_number() OVER ({W_SQL}) AS pos, count(*) OVER (PARTITION BY battle_id) AS n FROM log),
s AS (SELECT *, CAST(floor((CAST('0x' || substr(md5('slice:' || battle_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0
  * (greatest(n - 20, 0) + 1)) AS BIGINT) AS start FROM r)
SELECT event_id, pos - 1 - start AS t FROM s WHERE pos - 1 >= start AND pos - 1 < start + 20""", ("log",))
def w11(spark, d):
    return windows.random_slice(log(spark, d), KEY, SEG, ORDER, 20, "slice").select("event_id", F.col("t").cast("bigint"))


@query("W12_context", """
SELECT conv_id, turn, array_to_string(list(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ' ') AS context FROM conversations""")
def w12(spark, d):
    out = windows.context(turns_of_talk(spark, d), ["conv_id"], "seg", ["turn"], F.md5("text"), 3)
    return out.select("conv_id", "turn", F.array_join("context", " ").alias("context"))


@query("W13_running_win_rate", """
SELECT match_id, round(avg(CASE result WHEN 'WIN' THEN 1.0 WHEN 'DRAW' THEN 0.5 ELSE 0.0 END) OVER
  (PARTITION BY a ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS rate FROM results""", ("results",))
def w13(spark, d):
    score = F.when(F.col("result") == "WIN", 1.0).when(F.col("result") == "DRAW", 0.5).otherwise(0.0)
    rows = view(spark, d, "results").withColumn("seg", F.floor(F.col("match_id") / 4096))
    return windows.running_rate(rows, ["a"], "seg", ["match_id"], score).select(
        "match_id", F.round("rate", 6).alias("rate"))


@query("W14_monthly_series", """
WITH c AS (SELECT entity, month, pick, sum(qty) AS w FROM picks GROUP BY ALL),
m AS (SELECT entity, month, sum(w) AS n FROM c GROUP BY ALL),
t AS (SELECT entity, pick, sum(w) AS s FROM c GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, pick) AS place FROM t QUALIFY place <= 3)
SELECT b.entity, b.pick, CAST(b.place AS INT) AS place, CAST(m.month AS VARCHAR) AS month, round(coalesce(c.w, 0) / m.n, 6) AS share
FROM b JOIN m USING (entity) LEFT JOIN c ON c.entity = b.entity AND c.month = m.month AND c.pick = b.pick""", ("picks",))
def w14(spark, d):
    out = windows.monthly_series(view(spark, d, "picks"), ["entity"], "pick", "month", "qty", 3)
    return out.select("entity", "pick", "place", F.col("month").cast("string").alias("month"),
                      F.round("share", 6).alias("share"))


@query("W15_running_offsets", """
SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM conversations""")
def w15(spark, d):
    out = windows.running_offsets(turns_of_talk(spark, d), ["conv_id"], "seg", ["turn"],
                                  F.length("text").cast("bigint"), "start_at")
    return out.select("conv_id", "turn", "start_at")


@query("W16_top_percent", """
SELECT lang, doc_id, n_chars, place FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place,
  count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE place <= greatest(1, floor(n * 10 / 100.0))""")
def w16(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return windows.top_share(docs, ["lang"], [F.desc("n_chars"), "doc_id"], 10.0)


@query("W17_normalised_weights", """
WITH b AS (SELECT event_id, value, CAST(floor(event_id / 256) AS BIGINT) AS batch FROM events),
s AS (SELECT batch, avg(value) AS mu, stddev_samp(value) AS sd FROM b GROUP BY 1)
SELECT event_id, batch, round(least(greatest(exp(0.5 * (value - mu) / (sd + 1e-5)), 1e-7), 100), 6) AS weight
FROM b JOIN s USING (batch)""")
def w17(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", F.floor(F.col("event_id") / 256).alias("batch"))
    out = windows.normalised_weights(rows, ["batch"], F.col("value"), 0.5)
    return out.select("event_id", "batch", F.round("weight", 6).alias("weight"))


@query("W18_sequence_weights", """
WITH m AS (SELECT user_id, round(avg(value), 6) AS mean_adv FROM events GROUP BY 1),
p AS (SELECT user_id, mean_adv, (rank() OVER (ORDER BY mean_adv) - 1) / count(*) OVER () AS pct FROM m)
SELECT user_id, round(pct, 6) AS percentile, round(0.2 + 0.8 / (1 + exp(-8.0 * (pct - 0.5))), 6) AS weight FROM p""")
def w18(spark, d):
    out = windows.sequence_weights(table(spark, d, "events").select("user_id", "value"), ["user_id"], F.col("value"),
                                   8.0, 0.5, 0.2)
    return out.select("user_id", F.round("percentile", 6).alias("percentile"), F.round("weight", 6).alias("weight"))


def _interval_sql(start: str, end: str, part: str, cond: str) -> str:
    return f"""WITH {TURNS_SQL},
c AS (SELECT *, {cond} AS cond, CAST(type = '{end}' AS INT) AS is_end FROM turned WHERE type IN ('{start}', '{end}')),
i AS (SELECT *, sum(is_end) OVER (PARTITION BY {part}, cond ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - is_end AS island FROM c)
SELECT {part}, cond, CAST(island AS BIGINT) AS island, min(CASE WHEN is_end = 0 THEN turn END) AS start_turn,
 count(CASE WHEN is_end = 0 THEN 1 END) AS stacks, max(CASE WHEN is_end = 1 THEN turn END) AS end_turn
FROM i GROUP BY ALL HAVING count(CASE WHEN is_end = 0 THEN 1 END) > 0"""


_COND_SQL = "replace(lower(trim(replace({0}, 'move:', ''))), ' ', '')"


def _intervals(turned, key, cond, start, end):
    rows = turned.withColumn("cond", cond).where(F.col("cond").isNotNull())
    out = events.condition_intervals(rows, [*key, "cond"], SEG, ORDER, [start], [end], F.col("turn"))
    return out.withColumn("island", F.col("island").cast("bigint"))


_HOME_SQL = f"""WITH homed AS (SELECT * REPLACE (CASE WHEN count(CASE WHEN type = '-swapsideconditions' THEN 1 END) OVER ({W_SQL}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 2 = 1 THEN CASE side WHEN 'p1' THEN 'p2' ELSE 'p1' END ELSE side END AS side) FROM log),
{TURNS_SQL.replace("FROM log", "FROM homed")},"""


@query("W19_condition_intervals", _interval_sql("-sidestart", "-sideend", "battle_id, side", _COND_SQL.format("a2")).replace(
    f"WITH {TURNS_SQL},", _HOME_SQL), ("log",))
def w19(spark, d):
    rows = events.home_side(log_with_turns(spark, d), KEY, SEG, ORDER, F.col("side"), "side")
    return _intervals(rows, _SIDE, tx.condition_name(F.col("a2")), "-sidestart", "-sideend")


_STAGE_SQL = """
WITH s AS (SELECT *, sum(CASE WHEN type IN ('switch','drag','-clearboost') THEN 1 ELSE 0 END) OVER
   (PARTITION BY battle_id, side, stat ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM (SELECT *, unnest(CASE WHEN type IN ('-boost','-unboost') THEN [a2] ELSE ['atk','spa','def','spd','spe','accuracy','evasion'] END) AS stat
        FROM log WHERE type IN ('-boost','-unboost','-clearboost','switch','drag'))),
v AS (SELECT *, CASE type WHEN '-boost' THEN CAST(a3 AS INT) WHEN '-unboost' THEN -CAST(a3 AS INT) ELSE 0 END AS x FROM s),
l AS (SELECT *, list(x) OVER (PARTITION BY battle_id, side, stat, island ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM v)
SELECT event_id, side, stat, list_reduce(xs, lambda acc, x: greatest(-6, least(6, acc + x)), 0) AS stage FROM l"""


@query("W20_clamped_stages", _STAGE_SQL, ("log",))
def w20(spark, d):
    rows = log(spark, d).where(F.col("type").isin("-boost", "-unboost", "-clearboost", "switch", "drag"))
    rows = events.boost_messages(rows.select("battle_id", SEG, *ORDER, "type", "side", "a2", "a3"), F.col("a2"), F.col("a3"))
    out = events.boost_stages(rows, ["battle_id", "stat"], SEG, ORDER, F.col("side"))
    return out.select("event_id", "side", "stat", F.when(F.col("side") == "p1", F.col("stage1")).otherwise(
        F.col("stage2")).alias("stage"))


# -- message projections -------------------------------------------------------

def raw_lines(spark, d):
    return events.log_lines(view(spark, d, "raw_battles"))


LINES_SQL = """lines0 AS (SELECT battle_id, unnest(string_split(log, chr(10))) AS line,
   unnest(range(len(string_split(log, chr(10))))) AS pos FROM raw_battles),
lines AS (SELECT battle_id, pos, list_transform(string_split(line, '|')[2:], lambda x: trim(x)) AS f FROM lines0)"""


@query("X5_log_lines", f"""WITH {LINES_SQL} SELECT battle_id, CAST(pos AS INT) AS pos, coalesce(f[1], '') AS type,
 array_to_string(f[2:], '|') AS args FROM lines""", ("raw_battles",))
def x5(spark, d):
    return raw_lines(spark, d).select("battle_id", "pos", "type", F.array_join("args", "|").alias("args"))


@query("F14_noise_filter", f"""WITH {LINES_SQL} SELECT battle_id, CAST(pos AS INT) AS pos, f[1] AS type FROM lines
WHERE coalesce(f[1], '') NOT IN ('', 'start', 'c', 'inactive', 'tier')""", ("raw_battles",))
def f14(spark, d):
    return events.without_noise(raw_lines(spark, d)).select("battle_id", "pos", "type")


@query("F10_preview_after_start", f"""WITH {LINES_SQL} SELECT battle_id,
 CAST(coalesce(max(CASE WHEN f[1] = 'poke' THEN pos END) > min(CASE WHEN f[1] = 'start' THEN pos END), false) AS INT) AS custom
FROM lines GROUP BY 1""", ("raw_battles",))
def f10(spark, d):
    return events.preview_after_start(raw_lines(spark, d)).select("battle_id", F.col("custom").cast("int").alias("custom"))


HEAD_SQL = f"""{LINES_SQL},
heads AS (SELECT battle_id, CAST(max(CASE WHEN f[1] = 'gen' THEN f[2] END) AS INT) AS gen, max(CASE WHEN f[1] = 'tier' THEN f[2] END) AS tier,
 max(CASE WHEN f[1] = 'player' AND f[2] = 'p1' THEN f[3] END) AS player1, max(CASE WHEN f[1] = 'player' AND f[2] = 'p2' THEN f[3] END) AS player2,
 TRY_CAST(max(CASE WHEN f[1] = 'player' AND f[2] = 'p1' THEN f[5] END) AS INT) AS rating1,
 CAST(max(CASE WHEN f[1] = 'teamsize' AND f[2] = 'p1' THEN f[3] END) AS INT) AS size1,
 array_to_string(list_sort(list_distinct(list(CASE WHEN f[1] = 'rule' THEN f[2] END) FILTER (f[1] = 'rule'))), '|') AS rules
 FROM lines GROUP BY 1)"""


@query("E1_headers", f"""WITH {HEAD_SQL} SELECT battle_id, gen, tier, player1, player2, rating1,
 CAST(rating1 IS NOT NULL AS INT) AS rated1, size1, rules FROM heads""", ("raw_battles",))
def e1(spark, d):
    h = events.headers(raw_lines(spark, d))
    return h.select("battle_id", "gen", "tier", "player1", "player2", "rating1", F.col("is_rated1").cast("int").alias("rated1"),
                    "size1", F.array_join("rules", "|").alias("rules"))


@query("E2_results", f"""WITH {HEAD_SQL}, w AS (SELECT battle_id, max(CASE WHEN f[1] = 'win' THEN f[2] END) AS win,
 max(CASE WHEN f[1] = 'tie' THEN 1 END) AS tie FROM lines GROUP BY 1)
SELECT battle_id, CASE WHEN win = player1 THEN 'p1' WHEN win = player2 THEN 'p2' WHEN tie = 1 THEN 'tie' END AS winner
FROM heads JOIN w USING (battle_id)""", ("raw_battles",))
def e2(spark, d):
    return events.results(raw_lines(spark, d))


@query("E3_active", """
SELECT event_id, last_value(CASE WHEN type IN ('switch','drag') THEN substr(a1, 6) END IGNORE NULLS) OVER w AS active,
 last_value(CASE WHEN type IN ('switch','drag') THEN split_part(a2, ',', 1) END IGNORE NULLS) OVER w AS active_species
FROM log WINDOW w AS (PARTITION BY battle_id, side ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ("log",))
def e3(spark, d):
    return events.switches(log(spark, d), _SIDE, SEG, ORDER, F.col("a1"), F.col("a2")).select(
        "event_id", "active", "active_species")


@query("E4_previews", f"""WITH {LINES_SQL} SELECT battle_id, f[2] AS side,
 string_agg(trim(split_part(f[3], ',', 1)), '|' ORDER BY pos) AS preview FROM lines WHERE f[1] = 'poke' GROUP BY ALL""", ("raw_battles",))
def e4(spark, d):
    return events.previews(raw_lines(spark, d)).select("battle_id", "side", F.array_join("preview", "|").alias("preview"))


_MOVE_ID = """CASE WHEN m LIKE 'hiddenpower%' THEN 'hiddenpower' WHEN m = 'vicegrip' THEN 'visegrip' WHEN m LIKE 'return%' THEN 'return'
 WHEN m LIKE 'frustration%' THEN 'frustration' ELSE m END"""


@query("E5_move_reveals", f"""
WITH m AS (SELECT *, lower(regexp_replace(a2, '[^\\p{{L}}]', '', 'g')) AS m, substr(a1, 6) AS entity FROM log WHERE type = 'move'),
i AS (SELECT *, {_MOVE_ID} AS move FROM m)
SELECT battle_id, side, entity, move, first(event_id ORDER BY ts, event_id) AS event_id,
 first(substr(a3, 6) ORDER BY ts, event_id) AS target, nullif(first(replace(a4, '[from] move: ', '') ORDER BY ts, event_id), '') AS source,
 count(*) AS uses FROM i GROUP BY 1, 2, 3, 4""", ("log",))
def e5(spark, d):
    out = events.move_reveals(log(spark, d), _SIDE, ORDER, F.col("a1"), F.col("a2"), F.col("a3"), F.array("a4"))
    return out.select("battle_id", "side", "entity", "move", "event_id", "target", "source", "uses")


@query("E6_health", """
WITH s AS (SELECT *, substr(a1, 6) AS entity FROM log WHERE a1 LIKE 'p_a:%'),
h AS (SELECT *, CASE WHEN type IN ('switch','drag') THEN a3 WHEN type IN ('-damage','-heal') THEN a2 END AS raw FROM s)
SELECT event_id, round(coalesce(last_value(CAST(nullif(regexp_extract(raw, '([0-9]+)/([0-9]+)', 1), '') AS DOUBLE) /
   CAST(nullif(regexp_extract(raw, '([0-9]+)/([0-9]+)', 2), '') AS DOUBLE) IGNORE NULLS) OVER
   (PARTITION BY battle_id, side, entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) AS hp FROM h""",
       ("log",))
def e6(spark, d):
    rows = log(spark, d).where(F.col("a1").rlike("^p[0-9]a:")).withColumn("entity", tx.slot_name(F.col("a1")))
    hp = F.when(F.col("type").isin("switch", "drag"), F.col("a3")).otherwise(F.col("a2"))
    out = events.health(rows, ["battle_id", "side", "entity"], SEG, ORDER, hp)
    return out.select("event_id", F.round("hp", 6).alias("hp"))


@query("E7_remaining", """
WITH r AS (SELECT event_id, list(CASE WHEN type = 'faint' THEN substr(a1, 6) END) OVER
 (PARTITION BY battle_id, side ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM log)
SELECT event_id, CAST(6 - len(list_distinct(l)) AS INT) AS remaining FROM r""", ("log",))
def e7(spark, d):
    return events.remaining(log(spark, d), _SIDE, SEG, ORDER, F.col("a1")).select("event_id", "remaining")


@query("E8_statuses", """
WITH s AS (SELECT *, substr(a1, 6) AS entity FROM log WHERE type IN ('-status', '-curestatus', '-cureteam')),
l AS (SELECT *, list({'e': entity, 'k': type, 'v': a2}) OVER
 (PARTITION BY battle_id, side ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ms FROM s),
o AS (SELECT event_id, list_transform(list_filter(ms, lambda m: m.k = '-cureteam' OR m.e = entity), lambda m: m.k || '|' || m.v) AS own FROM l)
SELECT event_id, list_reduce(own, lambda acc, m: CASE WHEN m LIKE '-status|%' THEN m[9:] WHEN m LIKE '-cureteam|%' OR m[13:] = acc THEN 'nostatus' ELSE acc END, 'nostatus') AS status
FROM o""", ("log",))
def e8(spark, d):
    rows = log(spark, d).where(F.col("type").isin("-status", "-curestatus", "-cureteam")).withColumn("entity", tx.slot_name(F.col("a1")))
    return events.statuses(rows, ["battle_id", "side", "entity"], SEG, ORDER, F.col("a2")).select("event_id", "status")


_FAMILY = "'-boost','-unboost','-setboost','-swapboost','-clearboost','switch','drag'"


@query("E9_boost_family", f"""
WITH s AS (SELECT *, unnest(CASE WHEN type IN ('-boost','-unboost','-setboost') THEN [a2] WHEN type = '-swapboost' THEN [a2]
   ELSE ['atk','spa','def','spd','spe','accuracy','evasion'] END) AS stat FROM log WHERE type IN ({_FAMILY})),
l AS (SELECT *, list({{'k': type, 's': side, 'n': coalesce(TRY_CAST(a3 AS INT), 0), 'v1': 0, 'v2': 0}}) OVER
  (PARTITION BY battle_id, stat ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ms FROM s),
r AS (SELECT event_id, stat, list_reduce(ms, lambda z, m: {{'k': m.k, 's': m.s, 'n': m.n,
  'v1': CASE WHEN m.k = '-swapboost' THEN z.v2 WHEN m.s <> 'p1' THEN z.v1 WHEN m.k = '-boost' THEN least(6, z.v1 + m.n)
     WHEN m.k = '-unboost' THEN greatest(-6, z.v1 - m.n) WHEN m.k = '-setboost' THEN m.n ELSE 0 END,
  'v2': CASE WHEN m.k = '-swapboost' THEN z.v1 WHEN m.s <> 'p2' THEN z.v2 WHEN m.k = '-boost' THEN least(6, z.v2 + m.n)
     WHEN m.k = '-unboost' THEN greatest(-6, z.v2 - m.n) WHEN m.k = '-setboost' THEN m.n ELSE 0 END}},
  {{'k': '', 's': '', 'n': 0, 'v1': 0, 'v2': 0}}) AS z FROM l)
SELECT event_id, stat, z.v1 AS stage1, z.v2 AS stage2 FROM r""", ("log",))
def e9(spark, d):
    rows = log(spark, d).where(F.col("type").isin("-boost", "-unboost", "-setboost", "-swapboost", "-clearboost", "switch", "drag"))
    rows = events.boost_messages(rows.select("battle_id", SEG, *ORDER, "type", "side", "a2", "a3"), F.col("a2"), F.col("a3"))
    return events.boost_stages(rows, ["battle_id", "stat"], SEG, ORDER, F.col("side")).select(
        "event_id", "stat", "stage1", "stage2")


@query("E10_field_intervals", _interval_sql("-fieldstart", "-fieldend", "battle_id", _COND_SQL.format("a1")), ("log",))
def e10(spark, d):
    return _intervals(log_with_turns(spark, d), KEY, tx.condition_name(F.col("a1")), "-fieldstart", "-fieldend")


@query("E10_weather", """
SELECT event_id, coalesce(last_value(CASE WHEN type = '-weather' THEN CASE WHEN a1 = 'none' THEN 'noweather' ELSE lower(a1) END END IGNORE NULLS)
 OVER (PARTITION BY battle_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'noweather') AS weather FROM log""", ("log",))
def e10_weather(spark, d):
    w = F.when(F.col("a1") == "none", "noweather").otherwise(tx.clean_letters(F.col("a1")))
    out = windows.forward_fill(log(spark, d), KEY, SEG, ORDER, {"weather": F.when(F.col("type") == "-weather", w)})
    return out.select("event_id", F.coalesce("weather", F.lit("noweather")).alias("weather"))


@query("E11_fact_reveals", """
WITH r AS (SELECT battle_id, ts, event_id, CASE WHEN type = '-ability' THEN substr(a1, 6) WHEN a4 <> '' THEN substr(replace(a4, '[of] ', ''), 6)
   ELSE substr(a1, 6) END AS entity, CASE WHEN type = '-ability' THEN a2 ELSE replace(a3, '[from] ability: ', '') END AS ability
  FROM log WHERE type = '-ability' OR a3 LIKE '[from] ability:%')
SELECT battle_id, entity, first(event_id ORDER BY ts, event_id) AS event_id, first(ability ORDER BY ts, event_id) AS ability
FROM r GROUP BY 1, 2""", ("log",))
def e11(spark, d):
    out = events.fact_reveals(log(spark, d), KEY, ORDER, "ability", F.col("a1"), F.col("a2"), F.col("args"))
    return out.select("battle_id", "entity", "event_id", "ability")


@query("E11_item_reveals", """
WITH r AS (SELECT battle_id, ts, event_id, CASE WHEN type LIKE '-%item' THEN substr(a1, 6) WHEN a4 <> '' THEN substr(replace(a4, '[of] ', ''), 6)
   ELSE substr(a1, 6) END AS entity, CASE WHEN type LIKE '-%item' THEN a2 ELSE replace(a3, '[from] item: ', '') END AS item
  FROM log WHERE type IN ('-item', '-enditem') OR a3 LIKE '[from] item:%')
SELECT battle_id, entity, first(event_id ORDER BY ts, event_id) AS event_id, first(item ORDER BY ts, event_id) AS item
FROM r GROUP BY 1, 2""", ("log",))
def e11_items(spark, d):
    out = events.fact_reveals(log(spark, d), KEY, ORDER, "item", F.col("a1"), F.col("a2"), F.col("args"))
    return out.select("battle_id", "entity", "event_id", "item")


@query("E12_volatile_effects", _interval_sql("-start", "-end", "battle_id, side", "lower(a2)"), ("log",))
def e12(spark, d):
    return _intervals(log_with_turns(spark, d), _SIDE, tx.clean_letters(F.col("a2")), "-start", "-end")


@query("E13_tera_uses", """
SELECT battle_id, side, first(substr(a1, 6) ORDER BY ts, event_id) AS entity, first(a2 ORDER BY ts, event_id) AS tera_type,
 count(*) AS uses FROM log WHERE type = '-terastallize' GROUP BY 1, 2""", ("log",))
def e13(spark, d):
    return events.tera_uses(log(spark, d), KEY, ORDER, F.col("a1"), F.col("a2"))


@query("E14_choices", """
WITH c AS (SELECT event_id, 'p1' AS side, a1 AS t FROM log WHERE type = 'choice' UNION ALL
 SELECT event_id, 'p2', a2 FROM log WHERE type = 'choice')
SELECT event_id, side, split_part(t, ' ', 1) AS verb, split_part(t, ' ', 2) AS argument,
 CAST(t LIKE '%terastallize%' AS INT) AS tera FROM c WHERE t <> ''""", ("log",))
def e14(spark, d):
    out = events.choices(log(spark, d), ["event_id"], [F.col("a1"), F.col("a2")])
    return out.withColumn("tera", F.col("tera").cast("int"))


@query("E15_no_action_marks", """SELECT event_id, CASE WHEN type = 'cant' THEN -1 ELSE 0 END AS action FROM log
WHERE type IN ('cant', '-mustrecharge')""", ("log",))
def e15(spark, d):
    return events.no_action_marks(log(spark, d)).select("event_id", "action")


@query("E16_unknown_types", "SELECT event_id, type, 'UnimplementedMessage' AS error FROM log WHERE type = '-novelty'", ("log",))
def e16(spark, d):
    return events.unknown_types(log(spark, d)).select("event_id", "type", "error")


@query("X7_packed_sheets", """
WITH p AS (SELECT o_orderkey, unnest([1, 2]) AS n FROM orders), m AS (SELECT o_orderkey, n - 1 AS slot, (o_orderkey + n) AS z FROM p)
SELECT o_orderkey, CAST(slot AS INT) AS slot, 'Species' || (z % 12) AS species, CASE WHEN z % 4 = 0 THEN NULL ELSE 'Item' || (z % 4) END AS item,
 CASE WHEN z % 3 = 0 THEN NULL ELSE 'Ab' || (z % 3) END AS ability, 'm' || (z % 5) || '|m' || (z % 7) AS moves,
 CAST(CASE WHEN z % 2 = 0 THEN 100 ELSE 50 + z % 50 END AS INT) AS level, CASE WHEN z % 6 = 0 THEN 'Fire' END AS tera_type FROM m""")
def x7(spark, d):
    member = lambda n: F.expr(f"""concat('Nick', cast(o_orderkey + {n} as string), '|Species', (o_orderkey + {n}) % 12, '|',
      if((o_orderkey + {n}) % 4 = 0, '', concat('Item', (o_orderkey + {n}) % 4)), '|',
      if((o_orderkey + {n}) % 3 = 0, '', concat('Ab', (o_orderkey + {n}) % 3)), '|m', (o_orderkey + {n}) % 5, ', m', (o_orderkey + {n}) % 7,
      '|Bold|,,,,,|M|,,,,,||', if((o_orderkey + {n}) % 2 = 0, '', cast(50 + (o_orderkey + {n}) % 50 as string)), '|',
      if((o_orderkey + {n}) % 6 = 0, ',,,,Fire', ''))""")
    packed = table(spark, d, "orders").select("o_orderkey", F.concat_ws("]", member(1), member(2)).alias("packed"))
    return events.unpack_sheets(packed, ["o_orderkey"], "packed").withColumn("moves", F.array_join("moves", "|"))


@query("A26_type_counts", "SELECT battle_id, type, count(*) AS n FROM log GROUP BY 1, 2", ("log",))
def a26(spark, d):
    return events.type_counts(log(spark, d), KEY)


@query("J19_both_sides", f"""WITH {HEAD_SQL} SELECT battle_id, 1 AS pov, player1 AS own_player, player2 AS foe_player FROM heads
UNION ALL SELECT battle_id, 2, player2, player1 FROM heads""", ("raw_battles",))
def j19(spark, d):
    h = events.headers(raw_lines(spark, d)).select("battle_id", "player1", "player2")
    return windows.both_sides(h, ["player1"], ["player2"], ["own_player"], ["foe_player"])


# -- checks --------------------------------------------------------------------

@query("Q1_unfinished", f"""WITH {LINES_SQL} SELECT battle_id, count(CASE WHEN f[1] = 'turn' THEN 1 END) AS turns, 'Unfinished' AS reason
FROM lines GROUP BY 1 HAVING max(CASE WHEN f[1] IN ('win','tie') THEN 1 ELSE 0 END) = 0 OR count(CASE WHEN f[1] = 'turn' THEN 1 END) < 5""",
       ("raw_battles",))
def q1(spark, d):
    return checks.unfinished(raw_lines(spark, d))


@query("Q2_rules", f"""WITH {HEAD_SQL} SELECT battle_id, CASE WHEN rules LIKE '%Scalemons Mod%' THEN 'Scalemons' ELSE 'NoSpeciesClause' END AS reason
FROM heads WHERE rules LIKE '%Scalemons Mod%' OR rules NOT LIKE '%Species Clause%'""", ("raw_battles",))
def q2(spark, d):
    return checks.rule_violations(events.headers(raw_lines(spark, d)))


@query("Q2_duplicate_names", """SELECT team_id, name, count(*) AS n, 'DuplicateName' AS reason FROM records GROUP BY 1, 2 HAVING count(*) > 1""",
       ("records",))
def q2_names(spark, d):
    return checks.duplicate_names(view(spark, d, "records"), ["team_id"], "name")


@query("Q3_side_changes", """SELECT battle_id, substr(a1, 6) AS entity, 'SideChanged' AS reason FROM log WHERE type IN ('switch','drag')
GROUP BY 1, 2 HAVING count(DISTINCT side) > 1""", ("log",))
def q3(spark, d):
    rows = log(spark, d).where(F.col("type").isin("switch", "drag")).withColumn("entity", tx.slot_name(F.col("a1")))
    return checks.side_changes(rows, KEY, "entity", "side")


@query("Q3_vanished", """SELECT battle_id, substr(a1, 6) AS entity, min(day) AS first_turn, max(day) AS last_turn, count(DISTINCT day) AS turns,
 'Vanished' AS reason FROM (SELECT *, dayofmonth(ts) AS day FROM log) WHERE type IN ('switch','drag') GROUP BY 1, 2
HAVING count(DISTINCT day) <> max(day) - min(day) + 1""", ("log",))
def q3_vanished(spark, d):
    rows = log(spark, d).where(F.col("type").isin("switch", "drag")).withColumn("entity", tx.slot_name(F.col("a1")))
    out = checks.vanished(rows.withColumn("day", F.dayofmonth("ts").cast("bigint")), KEY, "entity", "day")
    return out


@query("Q3_facts_lost", """WITH f AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS fact FROM log),
r AS (SELECT event_id, fact, max(CASE WHEN fact IS NOT NULL THEN 1 ELSE 0 END) OVER
 (PARTITION BY battle_id, side ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ever FROM f)
SELECT event_id, 'FactLost' AS reason FROM r WHERE ever = 1 AND fact IS NULL""", ("log",))
def q3_lost(spark, d):
    rows = log(spark, d)
    return checks.forgotten(rows, _SIDE, SEG, ORDER, F.when(F.col("k") % 3 != 0, F.col("k"))).select("event_id", "reason")


@query("Q4_spelling", """WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lower(replace(replace(a2, ' ', ''), '-', '')) ELSE a2 END AS name FROM log
 WHERE type IN ('-item', '-ability'))
SELECT event_id, name, 'Spelling' AS reason FROM v WHERE name = lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g'))""", ("log",))
def q4(spark, d):
    rows = log(spark, d).where(F.col("type").isin("-item", "-ability")).select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.lower(F.regexp_replace("a2", "[ -]", ""))).otherwise(F.col("a2")).alias("name"))
    return checks.misspelled(rows, F.col("name")).select("event_id", "name", "reason")


@query("Q5_tera", """WITH s AS (SELECT *, CASE WHEN battle_id % 4 = 0 THEN 8 ELSE 9 END AS gen,
 lag(can_tera) OVER (PARTITION BY battle_id ORDER BY ts, event_id) AS prev FROM steps0)
SELECT event_id, CASE WHEN gen <> 9 THEN 'TeraOutsideGen9' ELSE 'TeraRegained' END AS reason FROM s
WHERE can_tera AND (gen <> 9 OR NOT prev)""", ("steps0",))
def q5(spark, d):
    gen = F.when(F.col("battle_id") % 4 == 0, 8).otherwise(9)
    return checks.tera_regained(log(spark, d, "steps0"), KEY, SEG, ORDER, F.col("can_tera"), gen).select("event_id", "reason")


@query("Q6_unfilled", """
WITH r AS (SELECT l_partkey, team_id, l_linenumber, 1 + name % 9 AS gen, item, ability, nature AS tera,
 len(list_filter([mv0, mv1, mv2, mv3], lambda x: x IS NOT NULL)) AS nm FROM records),
c AS (SELECT *, CASE WHEN nm = 0 THEN 'MissingMoves' WHEN gen >= 2 AND item IS NULL THEN 'MissingItem'
 WHEN gen >= 3 AND ability IS NULL THEN 'MissingAbility' WHEN gen = 9 AND tera IS NULL THEN 'MissingTera' END AS reason FROM r)
SELECT team_id, l_partkey, l_linenumber, reason FROM c WHERE reason IS NOT NULL""", ("records",))
def q6(spark, d):
    rows = view(spark, d, "records").withColumn("moves", F.array_compact(F.array("mv0", "mv1", "mv2", "mv3")))
    out = checks.unfilled(rows, 1 + F.col("name") % 9, F.col("name"), F.col("moves"), F.col("item"), F.col("ability"), F.col("nature"))
    return out.select("team_id", "l_partkey", "l_linenumber", "reason")


_ACT = "CAST(k % 16 - 1 AS INT)"


@query("Q7_illegal_actions", f"""
WITH a AS (SELECT *, {_ACT} AS act, CAST(k % 3 = 0 AS BOOLEAN) AS sw, CASE WHEN battle_id % 4 = 0 THEN 8 ELSE 9 END AS gen,
 CASE WHEN k % 13 = 0 THEN 'Struggle' ELSE 'Tackle' END AS nm, 1 + k % 4 AS nmoves FROM steps0),
r AS (SELECT event_id, act, CASE WHEN act = -1 THEN NULL WHEN act > 13 THEN 'OutOfBounds' WHEN act >= 9 AND gen <> 9 THEN 'TeraOutsideGen9'
 WHEN nm = 'Struggle' AND act <> 0 THEN 'NoOpIndex' WHEN forced_switch AND NOT sw THEN 'ForcedSwitchIgnored'
 WHEN act > 9 AND NOT can_tera THEN 'TeraUnavailable' WHEN sw AND NOT (act BETWEEN 4 AND 8) THEN 'SwitchIndex'
 WHEN NOT sw AND act BETWEEN 4 AND 8 THEN 'MoveIndex'
 WHEN NOT ((act < nmoves AND NOT forced_switch) OR (act >= 4 AND act < 4 + n_switches)
   OR (act >= 9 AND act < 9 + nmoves AND can_tera AND NOT forced_switch)) THEN 'NotLegal' END AS reason FROM a)
SELECT event_id, act, reason FROM r WHERE reason IS NOT NULL""", ("steps0",))
def q7(spark, d):
    rows = log(spark, d, "steps0").withColumn("act", F.expr(_ACT))
    out = checks.illegal_actions(
        rows, F.col("act"), F.when(F.col("k") % 13 == 0, "Struggle").otherwise("Tackle"), F.col("k") % 3 == 0,
        F.col("forced_switch"), F.col("can_tera"), F.when(F.col("battle_id") % 4 == 0, 8).otherwise(9),
        1 + F.col("k") % 4, F.col("n_switches"))
    return out.select("event_id", "act", "reason")


@query("Q7_repeated_tera", f"""SELECT battle_id, count(*) AS uses, 'MultipleTera' AS reason FROM steps0 WHERE {_ACT} >= 9 GROUP BY 1 HAVING count(*) > 1""",
       ("steps0",))
def q7_tera(spark, d):
    return checks.repeated_tera(log(spark, d, "steps0"), KEY, F.expr(_ACT))


@query("Q8_unanswered_switches", """WITH n AS (SELECT event_id, type, lead(type) OVER (PARTITION BY battle_id, side ORDER BY ts, event_id) AS nx FROM log)
SELECT event_id, 'SwitchUnanswered' AS reason FROM n WHERE type = 'faint' AND coalesce(nx NOT IN ('switch', 'drag'), true)""", ("log",))
def q8(spark, d):
    t = F.col("type")
    return checks.unanswered_switches(log(spark, d), _SIDE, SEG, ORDER, t == "faint", t.isin("switch", "drag")).select(
        "event_id", "reason")


@query("Q9_observation_limits", """
WITH c AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS words, 60 + turn % 4 AS numbers, turn % 7 AS bench FROM conversations),
r AS (SELECT *, CASE WHEN words > 336 THEN 'TooManyWords' WHEN numbers <> 63 THEN 'NumberCount' WHEN bench > 5 THEN 'BenchSize' END AS reason FROM c)
SELECT conv_id, turn, reason FROM r WHERE reason IS NOT NULL""")
def q9(spark, d):
    obs = table(spark, d, "conversations")
    return checks.oversized_observations(obs, F.size(F.split("text", " ")), 60 + F.col("turn") % 4, F.col("turn") % 7).select(
        "conv_id", "turn", "reason")
