"""Battle-log messages as relational projections.

Logs are rows (battle, order, type, args); every function below is a
projection or an aggregation of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import running
from .windows import distinct_so_far, intervals, stage_map, stage_values

# Message types that carry no state.
IGNORED_TYPES = (
    "", "-anim", "askreg", "badge", "bigerror", "c", "c:", "chatmsg-raw", "-crit", "chat", "clearpoke", "debug",
    "deinit", "error", "-fieldactivate", "gametype", "hidelines", "-hint", "hint", "html", "-hitcount", "init",
    "inactive", "inactiveoff", "j", "J", "join", "leave", "l", "L", "message", "-message", "-miss", "n", "-nothing",
    "-notarget", "-ohko", "-prepare", "-primal", "raw", "rated", "request", "-resisted", "start", "-supereffective",
    "-singlemove", "seed", "sentchoice", "teampreview", "title", "tier", "t:", "upkeep", "uhtml", "uhtmlchange",
    "unlink", "-zbroken")

# Message types that are read.
HANDLED_TYPES = (
    "gen", "tier", "player", "teamsize", "turn", "win", "choice", "tie", "rule", "showteam", "poke", "switch",
    "drag", "move", "-damage", "-heal", "-sethp", "faint", "-status", "-curestatus", "-boost", "-unboost",
    "-swapboost", "swap", "-ability", "-endability", "-sidestart", "-sideend", "-swapsideconditions", "-weather",
    "-activate", "-item", "-enditem", "-terastallize", "-zpower", "-mega", "-transform", "-fieldstart",
    "-fieldend", "-cureteam", "-start", "-end", "-setboost", "-clearboost", "-clearpositiveboost",
    "-clearnegativeboost", "-copyboost", "-clearallboost", "-restoreboost", "-invertboost", "-mustrecharge",
    "cant", "-immune", "detailschange", "-formechange", "replace", "-burst", "-fail", "-singleturn", "-block",
    ">>>")

STATS = ("atk", "spa", "def", "spd", "spe", "accuracy", "evasion")


def log_lines(battles: DataFrame, battle: str = "battle_id", log: str = "log") -> DataFrame:
    """One row per log line: ``pos``, ``type``, ``args``.  A log is one file's text, exploded where it is read."""
    rows = battles.select(battle, F.posexplode(F.split(log, "\n")).alias("pos", "line"))
    return rows.select(battle, "pos", tx.line_fields(F.col("line")).alias("_f")).select(
        battle, "pos", F.coalesce(F.try_element_at("_f", F.lit(1)), F.lit("")).alias("type"),
        tx.after_first(F.col("_f")).alias("args"))


def arg(i: int) -> Column:
    return F.try_element_at("args", F.lit(i + 1))


def without_noise(log: DataFrame) -> DataFrame:
    return log.where(~F.col("type").isin(*IGNORED_TYPES))


def unknown_types(log: DataFrame) -> DataFrame:
    """Messages of a type that is neither read nor ignored, for the quarantine table."""
    return log.where(~F.col("type").isin(*IGNORED_TYPES, *HANDLED_TYPES)).withColumn(
        "error", F.lit("UnimplementedMessage"))


def headers(lines: DataFrame, battle: str = "battle_id") -> DataFrame:
    """Generation, tier, players, ratings, team sizes and rules, one row per battle."""
    t = F.col("type")
    of = lambda kind, side, i: F.max(F.when((t == kind) & (arg(0) == side), arg(i)))
    rating = lambda side: of("player", side, 3)
    wanted = lines.where(t.isin("player", "teamsize", "gen", "tier", "rule"))
    return wanted.groupBy(battle).agg(
        F.max(F.when(t == "gen", arg(0))).cast("int").alias("gen"),
        F.max(F.when(t == "tier", arg(0))).alias("tier"),
        of("player", "p1", 1).alias("player1"), of("player", "p2", 1).alias("player2"),
        rating("p1").try_cast("int").alias("rating1"), rating("p2").try_cast("int").alias("rating2"),
        F.coalesce(rating("p1").try_cast("int").isNotNull(), F.lit(False)).alias("is_rated1"),
        of("teamsize", "p1", 1).cast("int").alias("size1"), of("teamsize", "p2", 1).cast("int").alias("size2"),
        F.sort_array(F.collect_set(F.when(t == "rule", arg(0)))).alias("rules"))


def results(lines: DataFrame, battle: str = "battle_id") -> DataFrame:
    """Winner side by cleaned name, or tie; null winner for an unfinished battle."""
    t = F.col("type")
    won = F.max(F.when(t == "win", tx.clean_name(arg(0))))
    name = lambda side: F.max(F.when((t == "player") & (arg(0) == side), tx.clean_name(arg(1))))
    rows = lines.where(t.isin("player", "win", "tie")).groupBy(battle).agg(
        won.alias("_w"), name("p1").alias("_1"), name("p2").alias("_2"),
        F.max((t == "tie").cast("int")).alias("_tie"))
    return rows.select(battle, F.when(F.col("_w") == F.col("_1"), "p1").when(F.col("_w") == F.col("_2"), "p2")
                       .when(F.col("_tie") == 1, "tie").alias("winner"))


def previews(lines: DataFrame, battle: str = "battle_id") -> DataFrame:
    """Previewed species in order, one row per battle and side (at most six each)."""
    rows = lines.where(F.col("type") == "poke").select(
        battle, "pos", arg(0).alias("side"), tx.details_species(arg(1)).alias("species"))
    return rows.groupBy(battle, "side").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "species"))), lambda s: s["species"]).alias("preview"))


def preview_after_start(lines: DataFrame, battle: str = "battle_id") -> DataFrame:
    """Battles with a preview message after the start message (a custom format)."""
    t, pos = F.col("type"), F.col("pos")
    rows = lines.where(t.isin("start", "poke")).groupBy(battle).agg(
        F.min(F.when(t == "start", pos)).alias("_start"), F.max(F.when(t == "poke", pos)).alias("_poke"))
    return rows.select(battle, F.coalesce(F.col("_poke") > F.col("_start"), F.lit(False)).alias("custom"))


def unpack_sheets(df: DataFrame, keys: Sequence[str], packed: str) -> DataFrame:
    """Members of a packed team sheet, one row per slot; sheets with under five fields are skipped."""
    blobs = df.select(*keys, F.posexplode(F.filter(F.split(packed, r"\]"), lambda b: F.trim(b) != ""))
                      .alias("slot", "_blob"))
    f = F.split(F.trim("_blob"), r"\|")
    at = lambda i: F.nullif(F.trim(F.try_element_at(F.col("_f"), F.lit(i + 1))), F.lit(""))
    rows = blobs.withColumn("_f", f).where(F.size("_f") >= 5)
    level = F.when(at(10).rlike("^[0-9]+$"), at(10).try_cast("int")).otherwise(100)
    moves = F.filter(F.transform(F.split(at(4), ","), lambda m: F.trim(m)), lambda m: m != "")
    return rows.select(
        *keys, "slot", F.coalesce(at(1), at(0)).alias("species"), at(2).alias("item"), at(3).alias("ability"),
        F.coalesce(moves, F.array().cast("array<string>")).alias("moves"), level.alias("level"),
        F.nullif(F.trim(F.try_element_at(F.split(at(11), ","), F.lit(5))), F.lit("")).alias("tera_type"))


def switches(log: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], slot: Column,
             details: Column) -> DataFrame:
    """Active entity and its species for the side of every message."""
    moved = F.col("type").isin("switch", "drag")
    return running(log, key, seg, order, {
        "active": ("last", F.when(moved, tx.slot_name(slot))),
        "active_species": ("last", F.when(moved, tx.details_species(details)))})


def move_reveals(log: DataFrame, battle: Sequence[str], order: Sequence[str], slot: Column, move: Column,
                 target: Column, args: Column) -> DataFrame:
    """First use of each move by each entity, and the move that called it, if any."""
    used = log.where(F.col("type") == "move").withColumn("entity", tx.slot_name(slot)).withColumn(
        "move", tx.move_id(move)).withColumn("_tgt", tx.slot_name(target)).withColumn("_src", tx.source_of(args, "move"))
    return used.groupBy(*battle, "entity", "move").agg(
        F.min(F.struct(*order, F.col("_tgt").alias("target"), F.col("_src").alias("source"))).alias("_first"), F.count("*").alias("uses")).select(
        *battle, "entity", "move", *[F.col("_first")[c].alias(c) for c in order], F.col("_first.target"), F.col("_first.source"), "uses")


def fact_reveals(log: DataFrame, battle: Sequence[str], order: Sequence[str], kind: str, slot: Column,
                 value: Column, args: Column) -> DataFrame:
    """First reveal of an item or ability per entity, from its own message (its end reveals it too) or from a
    ``[from]`` note.  A note with ``[of]`` reveals the named entity's fact."""
    own = F.col("type").isin(f"-{kind}", f"-end{kind}")
    direct = F.when(own, value)
    noted = F.when(~own, tx.source_of(args, kind))
    owner = F.when(direct.isNull(), F.coalesce(tx.slot_name(tx.entity_of(args)), tx.slot_name(slot))).otherwise(
        tx.slot_name(slot))
    rows = log.select(*battle, *order, owner.alias("entity"), F.coalesce(direct, noted).alias(kind)).where(
        F.col(kind).isNotNull())
    return rows.groupBy(*battle, "entity").agg(
        F.min(F.struct(*order, kind)).alias("_first")).select(
        *battle, "entity", *[F.col("_first")[c].alias(c) for c in [*order, kind]])


def health(log: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], hp: Column) -> DataFrame:
    """HP share after every message of an entity; 1 before the first reading."""
    reads = F.col("type").isin("-damage", "-heal", "-sethp", "switch", "drag")
    out = running(log, key, seg, order, {"hp": ("last", F.when(reads, tx.hp_fraction(hp)))})
    return out.withColumn("hp", F.coalesce("hp", F.lit(1.0)))


def remaining(log: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], slot: Column,
              team_size: int = 6) -> DataFrame:
    """Members left on a side: team size less distinct fainted members so far."""
    out = distinct_so_far(log, key, seg, order, {"_down": F.when(F.col("type") == "faint", tx.slot_name(slot))})
    return out.withColumn("remaining", (F.lit(team_size) - F.col("_down")).cast("int")).drop("_down")


def statuses(log: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], status: Column) -> DataFrame:
    """Status after every message; a cure works only on the status in force, a team cure on the whole side.

    ``key`` ends with the entity; its other columns name the side, and ``-cureteam`` rows have any entity of it.
    """
    t = F.col("type")
    at = F.struct(*order)
    sided = running(log, key[:-1], seg, order, {"_cured": ("last", F.when(t == "-cureteam", at))})
    named = running(sided, key, seg, order, {"_set": ("last", F.when(t == "-status", status))})
    mark = F.when(t == "-status", status).when((t == "-curestatus") & (status == F.col("_set")), "nostatus")
    out = running(named, key, seg, order, {"_mark": ("last", F.when(mark.isNotNull(), F.struct(at.alias("at"), mark.alias("status"))))})
    cured = F.col("_cured").isNotNull() & (F.col("_cured") >= F.col("_mark.at"))
    return out.withColumn("status", F.when(cured, "nostatus").otherwise(F.coalesce("_mark.status", F.lit("nostatus")))).drop(
        "_set", "_mark", "_cured")


def boost_messages(log: DataFrame, stat: Column, amount: Column) -> DataFrame:
    """One row per message and stat it touches; messages without a stat touch every stat."""
    t = F.col("type")
    one = t.isin("-boost", "-unboost", "-setboost")
    listed = F.when(one, F.array(stat)).when((t == "-swapboost") & (stat != ""), F.split(stat, ", ")).otherwise(
        F.array(*[F.lit(s) for s in STATS]))
    return log.withColumn("amount", F.when(one, amount.try_cast("int"))).withColumn("stat", F.explode(listed))


def boost_stages(rows: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], side: Column,
                 bound: int = 6) -> DataFrame:
    """Stages of both actives after every boost message, switches included as resets."""
    t, n = F.col("type"), F.col("amount")

    def slot_map(me: int, foe: int) -> Column:
        mine = side == f"p{me}"
        keep = stage_map(me, 1, 0, -bound, bound)
        const = lambda v: stage_map(me, 1, 0, v, v)
        own = (F.when(t == "-boost", stage_map(me, 1, n, -bound, bound))
               .when(t == "-unboost", stage_map(me, 1, -n, -bound, bound))
               .when(t == "-setboost", const(n))
               .when(t.isin("switch", "drag", "-clearboost"), const(F.lit(0)))
               .when(t == "-clearpositiveboost", stage_map(me, 1, 0, -bound, 0))
               .when(t.isin("-clearnegativeboost", "-restoreboost"), stage_map(me, 1, 0, 0, bound))
               .when(t == "-invertboost", stage_map(me, -1, 0, -bound, bound))
               .when(t == "-copyboost", stage_map(foe, 1, 0, -bound, bound))
               .otherwise(keep))
        return (F.when(t == "-swapboost", stage_map(foe, 1, 0, -bound, bound))
                .when(t == "-clearallboost", const(F.lit(0)))
                .when(mine, own).otherwise(keep))

    return stage_values(rows, key, seg, order, slot_map(1, 2), slot_map(2, 1), bound)


def home_side(log: DataFrame, battle: Sequence[str], seg: str, order: Sequence[str], side: Column, name: str = "home") -> DataFrame:
    """The side a condition belonged to before all ``-swapsideconditions`` so far: with an odd number of swaps the
    other one.  A condition keeps its home side when the sides change places, so its start and end still meet."""
    out = running(log, battle, seg, order, {"_swaps": ("count", F.when(F.col("type") == "-swapsideconditions", 1))})
    odd = F.coalesce("_swaps", F.lit(0)) % 2 == 1
    return out.withColumn(name, F.when(odd, F.when(side == "p1", "p2").otherwise("p1")).otherwise(side)).drop("_swaps")


def condition_intervals(log: DataFrame, key: Sequence[str], seg: str, order: Sequence[str], starts: Sequence[str],
                        ends: Sequence[str], turn: Column) -> DataFrame:
    """Intervals of side, field or volatile conditions; ``key`` includes the condition."""
    t = F.col("type")
    rows = log.where(t.isin(*starts, *ends))
    return intervals(rows, key, seg, order, t.isin(*starts), t.isin(*ends), turn)


def tera_uses(log: DataFrame, battle: Sequence[str], order: Sequence[str], slot: Column, tera: Column) -> DataFrame:
    """First use per side, and how many were logged (more than one is an error)."""
    used = log.where(F.col("type") == "-terastallize").select(
        *battle, *order, tx.slot_side(slot).alias("side"), tx.slot_name(slot).alias("entity"), tera.alias("tera_type"))
    return used.groupBy(*battle, "side").agg(
        F.min(F.struct(*order, "entity", "tera_type")).alias("_f"), F.count("*").alias("uses")).select(
        *battle, "side", F.col("_f.entity"), F.col("_f.tera_type"), "uses")


def choices(log: DataFrame, keys: Sequence[str], per_side: Sequence[Column]) -> DataFrame:
    """Announced choices, one row per side: verb, argument, tera flag."""
    sides = F.array(*[F.struct(F.lit(f"p{i + 1}").alias("side"), c.alias("text")) for i, c in enumerate(per_side)])
    rows = log.where(F.col("type") == "choice").select(*keys, F.explode(sides).alias("_c")).where(
        F.col("_c.text") != "")
    words = F.split(F.trim(F.col("_c.text")), r"\s+")
    return rows.select(*keys, F.col("_c.side").alias("side"), words[0].alias("verb"),
                       F.try_element_at(words, F.lit(2)).alias("argument"),
                       F.array_contains(words, "terastallize").alias("tera"))


def no_action_marks(log: DataFrame) -> DataFrame:
    """Hidden action (-1) where an entity could not act, no-op (0) where it had to recharge."""
    t = F.col("type")
    return log.where(t.isin("cant", "-mustrecharge")).withColumn(
        "action", F.when(t == "cant", -1).otherwise(0))


def type_counts(log: DataFrame, battle: Sequence[str]) -> DataFrame:
    return log.groupBy(*battle, "type").agg(F.count("*").alias("n"))


def message_columns(log: DataFrame) -> DataFrame:
    """Messages as typed columns, one per kind of fact; null where the message says nothing about it."""
    t, when = F.col("type"), F.when
    moved = t.isin("switch", "drag")
    one_stat = t.isin("-boost", "-unboost", "-setboost")
    return log.select(
        "*", F.nullif(F.regexp_extract(arg(0), "^(p[0-9])[a-z]:", 1), F.lit("")).alias("slot_side"),
        when(t == "move", arg(1)).alias("move"),
        when(moved, tx.details_species(arg(1))).alias("switched_to"),
        when(moved, tx.details_level(arg(1))).alias("level"),
        when(t.isin("-damage", "-heal", "-sethp"), tx.hp_fraction(arg(1))).alias("hp"),
        when(t == "faint", tx.slot_name(arg(0))).alias("fainted"),
        when(t == "-status", arg(1)).alias("status"),
        when(t == "-curestatus", arg(1)).alias("cured"),
        when(one_stat, arg(1)).alias("stat"), when(one_stat, arg(2).try_cast("int")).alias("amount"),
        when(t == "-weather", arg(0)).alias("weather"),
        when(t.isin("-sidestart", "-sideend"), tx.condition_name(arg(1))).alias("side_condition"),
        when(t.isin("-fieldstart", "-fieldend"), tx.condition_name(arg(0))).alias("field"),
        when(t.isin("-start", "-end"), arg(1)).alias("effect"),
        when(t == "-ability", arg(1)).alias("ability"), when(t.isin("-item", "-enditem"), arg(1)).alias("item"),
        when(t == "-terastallize", arg(1)).alias("tera_type"), when(t == "win", arg(0)).alias("winner"))
