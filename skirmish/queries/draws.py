"""Queries on splits, draws, mixtures, masks, completions and win models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as rec
from ..operators import aggregates as agg
from ..operators import models, sampling as sp
from ..operators.pairs import unordered_pairs
from ..operators.sets import with_mirror
from .base import query, table, view
from .stats import two_sided_log


def _bits(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT)"


def _u(expr: str) -> str:
    return f"(({_bits(expr)} + 0.5) / 4294967296.0)"


@query("R1_train_test_split", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('s1:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= floor(n * (1 - 0.1::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM r""")
def r1(spark, d):
    return sp.train_test_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.1, "s1")


@query("R2_group_split", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s2:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""")
def r2(spark, d):
    return sp.group_split(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 0.2, "s2")


@query("R3_split_then_mirror", """WITH r AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('s3:' || match_id), match_id) <= round_even(count(*) OVER () * 0.15::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split,
 CASE WHEN result = 'WIN' THEN 1 ELSE 0 END AS y FROM results)
SELECT match_id, split, 0 AS mirrored, a, b, y FROM r UNION ALL SELECT match_id, split, 1, b, a, 1 - y FROM r""", ("results",))
def r3(spark, d):
    rows = view(spark, d, "results").select("match_id", "a", "b", (F.col("result") == "WIN").cast("int").alias("y"))
    out = with_mirror(sp.split_originals(rows, ["match_id"], 0.15, "s3"), "a", "b", "y")
    return out.withColumn("mirrored", F.col("mirrored").cast("int"))


# A nested mixture over the sources of the documents table.
CONFIGS = {"base": {"sources": {"src0": 3, "src1": 1, "src2": 4}},
           "next": {"previous": "base", "prev_weight": 0.6, "sources": {"src3": 0.25, "src4": 0.1}}}


@query("R4_mixture_weights", """WITH m AS (SELECT * FROM (VALUES ('src0', 0.6 * 3 / 8), ('src1', 0.6 / 8), ('src2', 0.6 * 4 / 8), ('src3', 0.25), ('src4', 0.1), ('src5', 0.05)) t(source, w)),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT doc_id, source, round(CAST(coalesce(w, 0) AS DOUBLE) / n, 8) AS row_weight FROM documents LEFT JOIN m USING (source) JOIN n USING (source)""")
def r4(spark, d):
    mix = sp.mixture_table(spark, sp.flatten_mixture("next", CONFIGS), "src5", 0.05)
    return sp.row_weights(table(spark, d, "documents").select("doc_id", "source"), "source", mix).withColumn(
        "row_weight", F.round("row_weight", 8))


@query("R5_annealed_weights", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT source, n / sum(n) OVER () AS w, right(source, 1) = '7' AS is_new FROM c),
t AS (SELECT sum(CASE WHEN NOT is_new AND source <> 'src0' THEN w END) AS o, sum(CASE WHEN is_new THEN w END) AS nw FROM m),
s AS (SELECT source, w, CASE WHEN source = 'src0' THEN w WHEN is_new THEN 0 ELSE w * (1 + nw / o) END AS w0, unnest(range(12)) AS epoch FROM m, t)
SELECT source, CAST(epoch AS INT) AS epoch, round(greatest(least(w0 + (epoch + 1) * (w - w0) / 10, greatest(w0, w)), least(w0, w)), 6) AS weight FROM s""")
def r5(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    mix = counts.select("source", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("normalised"), F.col("source").endswith("7").alias("is_new"))
    return sp.annealed_weights(mix, 12, 10, "src0").withColumn("weight", F.round("weight", 6))


_W = "WITH w AS (SELECT entity, pick, CAST(sum(qty) AS BIGINT) AS w FROM picks GROUP BY 1, 2)"


@query("R6_weighted_draw", f"""{_W}, t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY -ln({_u("'d6:' || entity || ':' || pick")}) / w, pick) AS rn FROM w)
SELECT entity, pick, CAST(rn AS INT) AS pick_no FROM t WHERE rn <= 4""", ("picks",))
def r6(spark, d):
    w = view(spark, d, "picks").groupBy("entity", "pick").agg(F.sum("qty").alias("w")).withColumnRenamed("pick", "key")
    out = sp.weighted_draw(w, ["entity"], "key", "w", 4, "d6")
    return out.select("entity", F.col("key").alias("pick"), F.col("pick").alias("pick_no"))


@query("R7_draw_from_top", f"""{_W}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY w DESC, pick) AS rk FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY -ln({_u("'d7:' || entity || ':' || pick")}) / w, pick) AS rn FROM k WHERE rk <= 5)
SELECT entity, pick, w FROM t WHERE rn = 1""", ("picks",))
def r7(spark, d):
    w = view(spark, d, "picks").groupBy("entity", "pick").agg(F.sum("qty").alias("w"))
    return sp.draw_from_top(w, ["entity"], "pick", "w", 5, "d7").select("entity", "pick", "w")


@query("R8_group_quotas", """WITH w AS (SELECT lang, ascii(lang) % 5 + 1 AS w FROM (SELECT DISTINCT lang FROM documents)), q AS (SELECT lang, round(200 * w / sum(w) OVER ()) AS q FROM w),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s8:' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE rn <= q""")
def r8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    weights = docs.select("lang").distinct().withColumn("weight", F.ascii("lang") % 5 + 1)
    return sp.group_quotas(docs, "lang", ["doc_id"], 200, "s8", weights)


def teammate_usage(spark, d):
    """Teammates of each nation: other nations that share a customer segment, by number of customers."""
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    pair = c.alias("x").join(c.alias("y"), "c_mktsegment").where("x.c_nationkey <> y.c_nationkey")
    t = pair.groupBy(F.concat(F.lit("N"), F.col("x.c_nationkey").cast("string")).alias("entity"), F.lit("teammates").alias("field"),
                     F.concat(F.lit("N"), F.col("y.c_nationkey").cast("string")).alias("key")).agg(F.sum("y.n").alias("w"))
    total = t.groupBy("entity").agg(F.sum("w").alias("all"))
    return t.join(total, "entity").select("entity", "field", "key", (F.col("w") / F.col("all")).alias("share"))


def member_usage(spark, d):
    r = view(spark, d, "records").withColumn("entity", F.concat(F.lit("N"), F.col("name").cast("string")))
    cells = F.concat(F.transform(F.array("mv0", "mv1", "mv2", "mv3"), lambda m: F.struct(F.lit("moves").alias("field"), m.alias("key"))),
                     F.array(F.struct(F.lit("items").alias("field"), F.col("item").alias("key")),
                             F.struct(F.lit("abilities").alias("field"), F.col("ability").alias("key"))))
    c = r.select("entity", F.explode(cells).alias("c")).where("c.key is not null").groupBy("entity", "c.field", "c.key").agg(F.count("*").alias("w"))
    total = c.groupBy("entity", "field").agg(F.sum("w").alias("all"))
    return c.join(total, ["entity", "field"]).select("entity", "field", "key", (F.col("w") / F.col("all")).alias("share"))


@query("R9_completed_rosters")
def r9(spark, d):
    teams = table(spark, d, "orders").select("o_orderkey", F.array(F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string"))).alias("members"))
    out = sp.complete_roster(teams, "o_orderkey", "members", sp.option_lists(teammate_usage(spark, d), "entity"), "entity", 6, "r9")
    return out.select("o_orderkey", F.array_join("members", ",").alias("members"), F.size("members").alias("size"))


@query("R9_completed_members")
def r9_members(spark, d):
    rows = view(spark, d, "records").select(
        "team_id", "l_partkey", "l_linenumber", F.concat(F.lit("N"), F.col("name").cast("string")).alias("entity"), "item", "ability",
        F.array_compact(F.array("mv0", "mv1")).alias("moves"))
    out = sp.complete_members(rows, ["team_id", "l_partkey", "l_linenumber"], "entity", sp.option_lists(member_usage(spark, d), "entity"),
                              {"item": "items", "ability": "abilities"}, "moves", "r9m", {"b0": ["b1"], "b1": ["b0"]})
    return out.select("team_id", "l_partkey", "l_linenumber", "item", "ability", F.array_join("moves", ",").alias("moves"))


@query("R10_random_teams", """
WITH g AS (SELECT o_orderkey, c, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('r10g:' || o_orderkey || ':' || c)) AS rn FROM orders, (SELECT DISTINCT n_nationkey % 8 AS c FROM nation)),
p AS (SELECT n_nationkey, n_nationkey % 8 AS c, row_number() OVER (PARTITION BY n_nationkey % 8 ORDER BY n_nationkey) - 1 AS place, count(*) OVER (PARTITION BY n_nationkey % 8) AS n FROM nation)
SELECT o_orderkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS team FROM g JOIN p USING (c)
WHERE rn <= 6 AND place = floor({U} * n) GROUP BY 1""".replace("{U}", _u("'r10m:' || o_orderkey || ':' || c")))
def r10(spark, d):
    pool = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 8).alias("c"))
    out = sp.random_teams(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", pool, "n_nationkey", "c", 6, "r10")
    return out.select("o_orderkey", F.array_join(F.transform("team", lambda t: t.cast("string")), ",").alias("team"))


@query("R11_uncertain_pairs", f"""
WITH b AS (SELECT c_nationkey AS id, avg(c_acctbal) / 1000 AS s FROM customer GROUP BY 1),
p AS (SELECT x.id AS a, y.id AS b, 1 / (1 + exp(y.s - x.s)) AS p FROM b x JOIN b y ON x.id < y.id),
w AS (SELECT *, greatest(4 * p * (1 - p), 1e-6) AS w FROM p),
u AS (SELECT a, b, row_number() OVER (ORDER BY -ln({_u("'r11w:' || a || ':' || b")}) / w, a, b) AS rw, row_number() OVER (ORDER BY {_u("'r11u:' || a || ':' || b")}, a, b) AS ru, w FROM w)
SELECT a, b, 'uncertain' AS mode, round(w, 6) AS weight FROM u WHERE rw <= 60 UNION ALL SELECT a, b, 'uniform', round(w, 6) FROM u WHERE ru <= 20""")
def r11(spark, d):
    bank = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg((F.avg("c_acctbal") / 1000).alias("s"))
    return sp.uncertain_pairs(bank, "id", "s", 80, "r11").select("a", "b", "mode", F.round("weight", 6).alias("weight"))


@query("R12_thompson_choice")
def r12(spark, d):
    rounds = 20
    log = two_sided_log(spark, d).select(F.col("player").cast("string").alias("key"), "outcome")
    # An order's lines meet in one of as many tasks as they ask for, for the join and for what is counted once per order.
    lines = table(spark, d, "lineitem")
    parts = agg.task_count(lines)
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey").repartition(parts, "l_orderkey")
    member_log = lines.repartition(parts, "l_orderkey").join(orders, "l_orderkey").select(
        "l_orderkey", F.col("l_suppkey").cast("string").alias("key"), F.col("l_returnflag").alias("move"),
        F.when(F.col("o_orderstatus") == "F", "WIN").when(F.col("o_orderstatus") == "O", "LOSS").otherwise("DRAW").alias("outcome"),
        (F.col("o_custkey") % 25).cast("string").alias("team"))
    # An order counts once for each of its distinct members and moves.
    played = lambda key: member_log.select("l_orderkey", F.col(key).alias("key"), "outcome").distinct().select("key", "outcome")
    draws = lambda rows, seed: sp.posterior_draws(agg.beta_posteriors(rows, "key", F.col("outcome")), "key", seed, rounds)
    moves = member_log.select("team", F.col("move").alias("key"))
    chosen = sp.candidates(member_log.select("team"), "team", rounds, 10, "r12")
    scores = sp.thompson_scores(chosen, "team", draws(log, "t"), member_log.select("team", "key"), draws(played("key"), "m"),
                                moves, draws(played("move"), "v"))
    return sp.propose(scores, "team", "score", 0.2, "r12")


@query("R13_masked_records", f"""
WITH r AS (SELECT team_id, l_partkey, l_linenumber, min(item) AS item, min(ability) AS ability, min(nature) AS nature, min(mv0) AS mv0 FROM records GROUP BY 1, 2, 3),
f AS (SELECT *, list_filter([CASE WHEN item IS NOT NULL THEN 'item' END, CASE WHEN ability IS NOT NULL THEN 'ability' END, CASE WHEN nature IS NOT NULL THEN 'nature' END, CASE WHEN mv0 IS NOT NULL THEN 'mv0' END], lambda x: x IS NOT NULL) AS k,
  team_id || ':' || l_partkey || ':' || l_linenumber AS id FROM r),
n AS (SELECT *, greatest(1, round_even(0.25 * len(k), 0)) AS lo, greatest(greatest(1, round_even(0.25 * len(k), 0)), round_even(0.75 * len(k), 0)) AS hi FROM f),
h AS (SELECT *, list_sort(list_transform(k, lambda x: md5('r13:' || id || ':' || x) || x))[1:CAST(least(lo + floor({_u("'r13k:' || id")} * (hi - lo + 1)), len(k)) AS INT)] AS hid FROM n),
g AS (SELECT *, list_transform(hid, lambda x: x[33:]) AS hidden FROM h)
SELECT team_id, l_partkey, l_linenumber, CASE WHEN NOT list_contains(hidden, 'item') THEN item END AS item, CASE WHEN NOT list_contains(hidden, 'ability') THEN ability END AS ability,
 CASE WHEN NOT list_contains(hidden, 'nature') THEN nature END AS nature, CASE WHEN NOT list_contains(hidden, 'mv0') THEN mv0 END AS mv0, array_to_string(hidden, ',') AS hidden FROM g""", ("records",))
def r13(spark, d):
    key = ["team_id", "l_partkey", "l_linenumber"]
    r = view(spark, d, "records").groupBy(*key).agg(*[F.min(c).alias(c) for c in ("item", "ability", "nature", "mv0")])
    return sp.mask_record(r, key, ["item", "ability", "nature", "mv0"], 0.25, 0.75, "r13").withColumn("hidden", F.array_join("hidden", ","))


@query("R13_masked_names", f"""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('r13n:' || l_orderkey || ':' || l_suppkey), l_orderkey, l_suppkey) AS rn,
 count(*) OVER (PARTITION BY l_orderkey) AS n FROM m)
SELECT l_orderkey, l_suppkey, CASE WHEN rn > 1 + floor({_u("'r13nk:' || l_orderkey")} * n) THEN l_suppkey END AS name FROM r""")
def r13_names(spark, d):
    m = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().withColumn("name", F.col("l_suppkey"))
    return sp.mask_names(m, ["l_orderkey"], "l_suppkey", "name", "r13n")


@query("R14_token_dropout", f"""
WITH t AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations)
SELECT conv_id, turn, md5(string_agg(CASE WHEN {_bits("'r14:' || conv_id || ':' || turn || ':' || i")} < {int(0.15 * 2 ** 32)} THEN '<unk>' ELSE w END, ' ' ORDER BY i)) AS tokens FROM t GROUP BY 1, 2""")
def r14(spark, d):
    out = sp.drop_tokens(F.split("text", " "), ["conv_id", "turn"], 0.15, F.lit("<unk>"), "r14")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(out, " ")).alias("tokens"))


# -- models --------------------------------------------------------------------------

def examples(spark, d):
    """Match examples: two random teams of nations per order, and a label that depends on them."""
    pool = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 8).alias("c"))
    rows = table(spark, d, "orders").select("o_orderkey")
    side = lambda seed, name: sp.drawn_teams(rows, "o_orderkey", pool, "n_nationkey", "c", 3, seed).withColumnRenamed("team", name)
    both = rows.join(side("ea", "team_a"), "o_orderkey").join(side("eb", "team_b"), "o_orderkey")
    total = lambda t: F.aggregate(t, F.lit(0), lambda acc, x: acc + x)
    edge = (total(F.col("team_a")) - total(F.col("team_b"))) / 20.0
    return both.withColumn("y", (sp.uniform("ey", "o_orderkey") < rec.logistic(edge)).cast("int"))


@query("R15_baseline_model")
def r15(spark, d):
    pool = table(spark, d, "nation").count()
    theta, _, _ = models.fit_baseline(examples(spark, d), "o_orderkey", "team_a", "team_b", "y", pool=pool)
    return theta.select("member", F.round("weight", 3).alias("weight"))


@query("R16_interaction_model")
def r16(spark, d):
    pool = table(spark, d, "nation").count()
    weights, _ = models.fit_interaction(examples(spark, d), "o_orderkey", "team_a", "team_b", "y", pool=pool)
    return weights.select("kind", "term", F.round("weight", 3).alias("weight"))


@query("R17_presence_model")
def r17(spark, d):
    s = examples(spark, d).withColumn("fmt", F.col("o_orderkey") % 3)
    return models.fit_presence(s, "o_orderkey", "team_a", "y", 20, 10, "fmt").select(
        "feature", F.round("coefficient", 3).alias("coefficient"), F.round("odds", 3).alias("odds"))


def thetas(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("member"), (((F.col("n_nationkey") * 7) % 25) / 10.0).alias("weight"))


_EX = """ex AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 25)) AS a, list_distinct(list(l_partkey % 25)) AS b FROM lineitem GROUP BY 1)"""


def basket_examples(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set((F.col("l_suppkey") % 25).cast("int")).alias("a"), F.collect_set((F.col("l_partkey") % 25).cast("int")).alias("b"))


@query("X17_win_probability", f"""WITH {_EX}, s AS (SELECT l_orderkey, unnest(a) AS m, 1 AS sg FROM ex UNION ALL SELECT l_orderkey, unnest(b), -1 FROM ex)
SELECT l_orderkey, round(0.1 + sum(sg * ((m * 7) % 25) / 10.0), 6) AS logit, round(1 / (1 + exp(-(0.1 + sum(sg * ((m * 7) % 25) / 10.0)))), 6) AS p FROM s GROUP BY 1""")
def x17(spark, d):
    scored = models.win_probability(models.make_scorer("baseline")(basket_examples(spark, d), "l_orderkey", "a", "b", thetas(spark, d), 0.1))
    return scored.select("l_orderkey", F.round("logit", 6).alias("logit"), F.round("p", 6).alias("p"))


@query("D5_scorer_by_type", f"""WITH {_EX}, s AS (SELECT l_orderkey, unnest(a) AS i, b, a FROM ex), m AS (SELECT l_orderkey, sum((i * 7) % 25 / 10.0) AS x FROM s GROUP BY 1),
f AS (SELECT l_orderkey, sum((i * 7) % 25 / 10.0) AS x FROM (SELECT l_orderkey, unnest(b) AS i FROM ex) GROUP BY 1),
v AS (SELECT l_orderkey, sum((i - j) / 100.0) AS x FROM (SELECT l_orderkey, i, unnest(b) AS j FROM s) WHERE i <> j GROUP BY 1)
SELECT l_orderkey, round(m.x - f.x + coalesce(v.x, 0), 6) AS logit FROM m JOIN f USING (l_orderkey) LEFT JOIN v USING (l_orderkey)""")
def d5(spark, d):
    main = thetas(spark, d).select(F.lit("main").alias("kind"), F.col("member").cast("string").alias("term"), "weight")
    n = table(spark, d, "nation").select("n_nationkey")
    both = unordered_pairs(n, [], "n_nationkey")
    pairs = both.select(F.col("a").alias("i"), F.col("b").alias("j")).unionByName(both.select(F.col("b").alias("i"), F.col("a").alias("j")))
    match = pairs.select(F.lit("matchup").alias("kind"), F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string")).alias("term"),
                         ((F.col("i") - F.col("j")) / 100.0).alias("weight"))
    out = models.make_scorer("interaction")(basket_examples(spark, d), "l_orderkey", "a", "b", main.unionByName(match))
    return out.select("l_orderkey", F.round("logit", 6).alias("logit"))


@query("R18_best_swaps", """
WITH pool AS (SELECT s_suppkey AS m, s_suppkey % 40 AS c, round(s_acctbal, 2) AS s FROM supplier),
b AS (SELECT l_orderkey, l_suppkey % 40 AS c, min(l_suppkey) AS m FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey, m, c, row_number() OVER (PARTITION BY l_orderkey ORDER BY m) - 1 AS slot, count(*) OVER (PARTITION BY l_orderkey) AS n FROM b),
k AS (SELECT t.*, s FROM t JOIN pool USING (m) WHERE n <= 6),
x AS (SELECT k.l_orderkey, k.slot, k.m AS out_m, p.m AS in_m, round(p.s - k.s, 2) AS gain FROM k JOIN pool p ON p.m <> k.m
 WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.l_orderkey = k.l_orderkey AND (o.m = p.m OR (o.m <> k.m AND o.c = p.c)))),
y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY gain DESC, slot, in_m) AS rn FROM x)
SELECT l_orderkey, CAST(slot AS INT) AS slot, out_m, in_m, gain, NULL AS reason FROM y WHERE rn = 1 AND gain > 0
UNION ALL SELECT DISTINCT l_orderkey, CAST(NULL AS INT), NULL, NULL, NULL, 'too many members' FROM t WHERE n > 6""")
def r18(spark, d):
    pool = table(spark, d, "supplier").select(F.col("s_suppkey").alias("m"), (F.col("s_suppkey") % 40).alias("c"), F.round("s_acctbal", 2).alias("s"))
    # The lines of an order meet in one task for all that follows.
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    lines = lines.repartition(agg.task_count(lines), "l_orderkey")
    rows = lines.groupBy("l_orderkey", (F.col("l_suppkey") % 40).alias("c")).agg(F.min("l_suppkey").alias("m"))
    sizes = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    teams = rows.join(sizes.where("n <= 6"), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("m")).alias("members"))
    out = models.best_swaps(teams, "l_orderkey", "members", pool, "m", "c", "s")
    swaps = out.select("l_orderkey", "slot", F.col("out").alias("out_m"), F.col("in").alias("in_m"), F.round("gain", 2).alias("gain"),
                       F.lit(None).cast("string").alias("reason"))
    return swaps.unionByName(sizes.where("n > 6").select("l_orderkey", F.lit("too many members").alias("reason")), allowMissingColumns=True)


@query("R19_lead_examples", """
WITH t AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS own, list_sort(list_distinct(list(l_partkey))) AS foe, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS lead FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(own, ',') AS own, array_to_string(foe, ',') AS foe, CAST(list_position(own, lead) - 1 AS INT) AS lead_index FROM t WHERE len(own) = 6 AND len(foe) = 6""")
def r19(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    six = items.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("o"), F.count_distinct("l_partkey").alias("f")).where("o = 6 AND f = 6")
    first = items.join(six.select("l_orderkey"), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(
        F.collect_set("l_suppkey").alias("o"), F.collect_set("l_partkey").alias("f"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("lead"))
    out = models.lead_examples(first, "l_orderkey", F.col("o"), F.col("f"), F.col("lead"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return out.select("l_orderkey", text("own"), text("foe"), "lead_index")
