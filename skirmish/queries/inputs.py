"""Battle-shaped inputs derived from the test tables.

Each entry is (base, select expressions, filter).  The expressions are plain
SQL that Spark and DuckDB both read, so a query and its oracle start from the
same rows; everything after that is written separately for each.
"""

from __future__ import annotations

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# One event becomes one log message: (kind, test on k, message type).
_TYPES = """CASE event_type
 WHEN 'view' THEN 'turn'
 WHEN 'signup' THEN CASE WHEN k < 80 THEN 'switch' ELSE 'drag' END
 WHEN 'click' THEN CASE WHEN k % 5 < 2 THEN 'move' WHEN k % 5 = 2 THEN '-boost'
   WHEN k % 5 = 3 THEN '-unboost' WHEN k < 50 THEN '-ability' WHEN k < 85 THEN '-item' ELSE '-enditem' END
 WHEN 'error' THEN CASE WHEN k < 50 THEN '-damage' WHEN k < 70 THEN '-heal' WHEN k < 85 THEN '-status'
   WHEN k < 95 THEN '-curestatus' ELSE 'faint' END
 ELSE CASE WHEN k < 20 THEN '-sidestart' WHEN k < 35 THEN '-sideend' WHEN k < 45 THEN '-weather'
   WHEN k < 52 THEN '-fieldstart' WHEN k < 57 THEN '-fieldend' WHEN k < 65 THEN '-start' WHEN k < 72 THEN '-end'
   WHEN k < 76 THEN '-terastallize' WHEN k < 79 THEN 'cant' WHEN k < 80 THEN '-swapsideconditions' WHEN k < 82 THEN '-mustrecharge' WHEN k < 83 THEN '-cureteam'
   WHEN k < 86 THEN '-clearboost' WHEN k < 89 THEN '-setboost' WHEN k < 92 THEN '-swapboost'
   WHEN k < 95 THEN 'choice' WHEN k < 97 THEN 'win' WHEN k < 98 THEN 'tie' WHEN k < 99 THEN 'debug'
   ELSE '-novelty' END END"""

_SLOT = "side || 'a: M' || CAST(k % 6 AS STRING)"
_FOE = "foe || 'a: M' || CAST(k % 4 AS STRING)"

_A1 = f"""CASE
 WHEN type = 'turn' THEN CAST(day AS STRING)
 WHEN type IN ('-sidestart', '-sideend') THEN side || ': Player ' || CAST(battle_id AS STRING)
 WHEN type = '-weather' THEN CASE k % 3 WHEN 0 THEN 'RainDance' WHEN 1 THEN 'SunnyDay' ELSE 'none' END
 WHEN type IN ('-fieldstart', '-fieldend') THEN CASE k % 2 WHEN 0 THEN 'move: Trick Room' ELSE 'move: Grassy Terrain' END
 WHEN type = 'choice' THEN CASE k % 3 WHEN 0 THEN 'move tackle' WHEN 1 THEN 'switch 3' ELSE 'move surf terastallize' END
 WHEN type = 'win' THEN 'Player-' || side
 WHEN type IN ('tie', 'debug') THEN ''
 ELSE {_SLOT} END"""

_A2 = f"""CASE
 WHEN type IN ('switch', 'drag') THEN 'Species-' || CAST(k % 12 AS STRING) || ', L' || CAST(50 + k % 50 AS STRING) || ', M'
 WHEN type = 'move' THEN CASE k % 7 WHEN 0 THEN 'Hidden Power [Ice]' WHEN 1 THEN 'Vice Grip' WHEN 2 THEN 'Return 102'
   ELSE 'Move ' || CAST(k % 7 AS STRING) || chr(65 + k % 7) END
 WHEN type IN ('-boost', '-unboost', '-setboost', '-swapboost') THEN CASE k % 3 WHEN 0 THEN 'atk' WHEN 1 THEN 'def' ELSE 'spe' END
 WHEN type IN ('-damage', '-heal') THEN CAST(CAST(floor(value) AS INT) % 101 AS STRING) || '/100'
   || CASE WHEN k % 2 = 0 THEN 'y' ELSE '' END || CASE WHEN k % 5 = 0 THEN ' brn' ELSE '' END
 WHEN type IN ('-status', '-curestatus') THEN CASE k % 4 WHEN 0 THEN 'par' WHEN 1 THEN 'brn' WHEN 2 THEN 'slp' ELSE 'frz' END
 WHEN type IN ('-sidestart', '-sideend') THEN CASE k % 3 WHEN 0 THEN 'Spikes' WHEN 1 THEN 'move: Stealth Rock' ELSE 'Reflect' END
 WHEN type IN ('-start', '-end') THEN CASE k % 2 WHEN 0 THEN 'confusion' ELSE 'Substitute' END
 WHEN type = '-ability' THEN 'Ability ' || CAST(k % 5 AS STRING)
 WHEN type IN ('-item', '-enditem') THEN 'Item ' || CAST(k % 6 AS STRING)
 WHEN type = '-terastallize' THEN CASE k % 2 WHEN 0 THEN 'Fire' ELSE 'Water' END
 WHEN type = 'cant' THEN 'par'
 WHEN type = 'choice' THEN CASE k % 2 WHEN 0 THEN 'move surf' ELSE 'switch 2' END
 ELSE '' END"""

_A3 = f"""CASE
 WHEN type IN ('switch', 'drag') THEN '100/100'
 WHEN type = 'move' THEN {_FOE}
 WHEN type IN ('-boost', '-unboost', '-setboost') THEN CAST(1 + k % 3 AS STRING)
 WHEN type IN ('-damage', '-heal') THEN CASE k % 4 WHEN 0 THEN '[from] item: Leftovers' WHEN 1 THEN '[from] ability: Rough Skin'
   WHEN 2 THEN '[from] move: Leech Seed' ELSE '' END
 ELSE '' END"""

_A4 = f"""CASE WHEN type IN ('-damage', '-heal') AND k % 4 < 2 THEN '[of] ' || {_FOE}
 WHEN type = 'move' AND k % 6 = 1 THEN '[from] move: Call ' || chr(65 + k % 4) ELSE '' END"""

# A whole battle log as text, one per order.
_RATING = "CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(1000 + CAST(floor(o_totalprice) AS BIGINT) % 900 AS STRING) END"
_GEN = "CAST(1 + o_orderkey % 9 AS STRING)"
_NL = "chr(10)"
_LOG = f"""'|player|p1|Trainer ' || CAST(o_custkey AS STRING) || '|av|' || {_RATING} || {_NL}
 || '|player|p2|Rival ' || CAST(o_custkey % 97 AS STRING) || '|av|' || {_NL}
 || '|teamsize|p1|' || CAST(1 + o_orderkey % 6 AS STRING) || {_NL} || '|teamsize|p2|6' || {_NL}
 || '|gen|' || {_GEN} || {_NL} || '|tier|[Gen ' || {_GEN} || '] OU' || {_NL}
 || CASE o_orderkey % 5 WHEN 0 THEN '|rule|Sleep Clause: Limit one' ELSE '|rule|Species Clause: Limit one of each' END || {_NL}
 || CASE WHEN o_orderkey % 7 = 0 THEN '|rule|Scalemons Mod: stats scaled' || {_NL} ELSE '' END
 || CASE WHEN o_orderkey % 3 = 0 THEN '|poke|p1|Species-' || CAST(o_custkey % 12 AS STRING) || ', L50|' || {_NL}
      || '|poke|p2|Species-' || CAST(o_custkey % 11 AS STRING) || ', L50|' || {_NL} ELSE '' END
 || '|' || {_NL} || '|start' || {_NL}
 || CASE WHEN o_orderkey % 4 = 0 THEN '|poke|p1|Species-' || CAST(o_custkey % 10 AS STRING) || '|' || {_NL} ELSE '' END
 || '|c|Trainer|good luck' || {_NL}
 || '|turn|1' || {_NL} || '|turn|2' || {_NL} || '|turn|3' || {_NL}
 || CASE WHEN o_orderkey % 2 = 0 THEN '|turn|4' || {_NL} || '|turn|5' || {_NL} || '|turn|6' || {_NL} ELSE '' END
 || CASE o_orderstatus WHEN 'F' THEN '|win|Trainer ' || CAST(o_custkey AS STRING)
      WHEN 'O' THEN '|win|Rival ' || CAST(o_custkey % 97 AS STRING) ELSE CASE WHEN o_orderkey % 2 = 0 THEN '|tie' ELSE '|inactive|x' END END"""

# Parts of a partial record, each NULL when unknown.
_MOVES = ["CASE WHEN l_partkey % 3 > 0 THEN 'a' || CAST(l_partkey % 3 AS STRING) END",
          "CASE WHEN l_orderkey % 5 > 1 THEN 'b' || CAST(l_orderkey % 2 AS STRING) END",
          "CASE WHEN l_linenumber > 3 THEN 'c' || CAST(l_linenumber % 2 AS STRING) END",
          "CASE WHEN l_discount > 0.05 THEN 'd0' END"]

VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "log0": ("events", [
        "user_id AS battle_id", "ts", "event_id", "event_type", "value", f"{K} AS k",
        "CAST(ts AS DATE) AS ts_date", "dayofmonth(ts) AS day",
        "CASE WHEN event_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS side",
        "CASE WHEN event_id % 2 = 0 THEN 'p2' ELSE 'p1' END AS foe"], None),
    "log1": ("log0", ["*", f"{_TYPES} AS type"], None),
    "log": ("log1", ["battle_id", "ts", "ts_date", "event_id", "side", "k", "value", "type",
                     f"{_A1} AS a1", f"{_A2} AS a2", f"{_A3} AS a3", f"{_A4} AS a4"], None),
    "raw_battles": ("orders", [
        "o_orderkey AS battle_id", f"{_LOG} AS log",
        f"'gen' || {_GEN} || CASE o_orderkey % 3 WHEN 0 THEN 'ou' WHEN 1 THEN 'uu' ELSE 'nu' END || '-' || CAST(o_orderkey AS STRING) AS id",
        f"CASE WHEN o_orderkey % 4 = 3 THEN 'Random Battle' ELSE '[Gen ' || {_GEN} || '] OU' END AS format",
        f"CASE o_orderkey % 4 WHEN 0 THEN 'gen' || {_GEN} || 'ou' WHEN 1 THEN 'MISSING' END AS formatid",
        "o_orderdate"], None),
    # point-of-view steps: one per event
    "steps0": ("log0", ["battle_id", "ts", "ts_date", "event_id", "k", "event_type", "value",
        "'m' || CAST(k % 6 AS STRING) AS base",
        "CAST(CAST(floor(value * 7) AS BIGINT) % 101 AS DOUBLE) / 100 AS hp",
        "CASE WHEN event_type = 'error' THEN 'par' ELSE 'nostatus' END AS status",
        "'m' || CAST((k + 1) % 6 AS STRING) AS bench_base",
        "CAST((k * 3) % 101 AS DOUBLE) / 100 AS bench_hp",
        "'f' || CAST(k % 3 AS STRING) AS foe_base",
        "CAST((k * 7) % 101 AS DOUBLE) / 100 AS foe_hp",
        "CASE WHEN event_type = 'click' AND k % 4 = 0 THEN 'slp' WHEN event_type = 'click' THEN 'brn' "
        "WHEN k % 11 = 0 THEN 'frz' ELSE 'nostatus' END AS foe_status",
        "CAST(1 + k % 5 AS INT) AS n_switches", "CAST(1 + k % 6 AS INT) AS foes_left",
        "(event_type = 'purchase' AND k >= 90) AS won", "(event_type = 'purchase' AND k < 5) AS lost",
        "(event_type = 'signup') AS forced_switch", "(k % 10 = 0) AS can_tera"], None),
    # partial records and baskets
    "records": ("lineitem", [
        "l_orderkey AS team_id", "CAST(l_suppkey % 20 AS BIGINT) AS name", "l_partkey", "l_linenumber", "l_quantity",
        "CASE l_returnflag WHEN 'N' THEN NULL ELSE l_returnflag END AS item",
        "CASE l_linestatus WHEN 'O' THEN NULL ELSE l_linestatus END AS ability",
        "CASE WHEN l_quantity > 25 THEN 'bold' END AS nature",
        *[f"{m} AS mv{i}" for i, m in enumerate(_MOVES)]], None),
    "results": ("orders", [
        "o_orderkey AS match_id", "o_custkey", "CAST(o_custkey % 25 AS INT) AS a",
        "CAST((o_custkey % 25 + 1 + o_orderkey % 24) % 25 AS INT) AS b",
        "CASE o_orderstatus WHEN 'F' THEN 'WIN' WHEN 'O' THEN 'LOSS' ELSE 'DRAW' END AS result",
        "o_totalprice AS price", "o_orderdate AS played"], None),
    # monthly usage counts before normalisation
    "picks": ("lineitem", [
        "CAST(1 + l_suppkey % 3 AS INT) AS gen", "CASE WHEN l_returnflag = 'R' THEN 'ou' ELSE 'uu' END AS tier",
        "CAST(CASE WHEN l_extendedprice < 15000 THEN 0 WHEN l_extendedprice < 40000 THEN 1500 ELSE 1760 END AS INT) AS usage_rank",
        "CAST(date_trunc('month', l_shipdate) AS DATE) AS month",
        "l_suppkey AS entity", "CAST(l_partkey % 40 AS BIGINT) AS pick", "CAST(l_quantity AS BIGINT) AS qty"], None),
}
