"""Win models on member sets with ``pyspark.ml``, and searches that use their scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .aggregates import binary_metrics, top_pairs
from .ordered import top_per
from .sampling import split_originals
from .sets import with_mirror

SCORERS: dict[str, Callable] = {}


def register_scorer(kind: str):
    """Register a scorer for a model type: (examples, coefficients, intercept) -> examples with ``logit``."""
    def add(fn):
        SCORERS[kind] = fn
        return fn
    return add


def _text(ids: Column) -> Column:
    return F.transform(ids, lambda i: i.cast("string"))


def team_terms(team: Column, sign: str) -> Column:
    """Main and synergy features of one side."""
    ids = F.sort_array(team)
    main = F.transform(ids, lambda i: F.concat(F.lit(f"{sign}m:"), i.cast("string")))
    pairs = F.flatten(F.transform(ids, lambda i: F.transform(F.filter(ids, lambda k: k > i), lambda k: F.concat(
        F.lit(f"{sign}s:"), i.cast("string"), F.lit(","), k.cast("string")))))
    return F.concat(main, pairs)


def matchup_terms(a: Column, b: Column) -> Column:
    """Ordered (own, foe) features of a match, equal members left out."""
    return F.flatten(F.transform(a, lambda i: F.transform(F.filter(b, lambda j: j != i), lambda j: F.concat(
        F.lit("v:"), i.cast("string"), F.lit(","), j.cast("string")))))


def vectorise(train: DataFrame, blocks: Sequence[tuple[str, float]]) -> tuple[Callable[[DataFrame], DataFrame], list[str], list[float]]:
    """(transform, tokens, scales) of the token columns of ``train``; the transform adds the scaled vector ``_x``.

    Each block is (token column, scale).
    """
    fits = [CountVectorizer(inputCol=name, outputCol=f"_c_{name}", vocabSize=2 ** 31 - 1, minDF=1.0).fit(train) for name, _ in blocks]
    scales = [scale for model, (_, scale) in zip(fits, blocks) for _ in model.vocabulary]
    assembler = VectorAssembler(inputCols=[f"_c_{n}" for n, _ in blocks], outputCol="_raw")
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(scales), inputCol="_raw", outputCol="_x")

    def apply(df: DataFrame) -> DataFrame:
        for v in fits:
            df = v.transform(df)
        return weigh.transform(assembler.transform(df)).drop("_raw", *[f"_c_{n}" for n, _ in blocks])

    return apply, [t for v in fits for t in v.vocabulary], scales


def fit_vectors(train: DataFrame, label: str, copies: str, c: float | None, intercept: bool, max_iter: int):
    """Logistic regression on the vectors ``_x``, each counted ``copies`` times.

    ``c`` is the inverse penalty; the penalty per example is 1 / (c n).
    """
    reg = 0.0 if c is None else 1.0 / (c * train.agg(F.sum(copies)).first()[0])
    lr = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=copies, regParam=reg, elasticNetParam=0.0, fitIntercept=intercept,
                            standardization=False, maxIter=max_iter, tol=1e-9)
    return lr.fit(train)


def fit_terms(train: DataFrame, blocks: Sequence[tuple[str, float]], label: str, c: float | None, intercept: bool,
              max_iter: int, copies: str):
    """Logistic regression on token columns; returns (transform, coefficients by token, intercept)."""
    vectors, names, scales = vectorise(train, blocks)
    model = fit_vectors(vectors(train), label, copies, c, intercept, max_iter)
    return lambda df: model.transform(vectors(df)), _by_token(names, scales, model), model.intercept


def _by_token(names: Sequence[str], scales: Sequence[float], model) -> dict[str, float]:
    return dict(zip(names, (w * s for w, s in zip(model.coefficients.toArray(), scales))))


def _cases(split: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Different examples of each part of the split with their number of copies: the two teams and the result are all a
    model sees of an example, so its weights and metrics are the same."""
    return materialise(split.groupBy("split", a, b, y).agg(F.count("*").alias("copies")), "examples")


# A mirrored example swaps the two sides and the label, so with mirrors in the data the best weights of the
# two sides are opposite.  Fitting one block per side with tokens scaled by sqrt(2) is then the same problem
# as fitting one signed block, penalty included.
_SIDE = math.sqrt(2.0)


def _probabilities(scored: DataFrame, label: str) -> DataFrame:
    p = vector_to_array("probability")[1]
    return binary_metrics(scored.select(label, p.alias("p"), "copies"), [], F.col(label), F.col("p"), copies=F.col("copies"))


def _coefficients(spark: SparkSession, coef: dict[str, float]) -> DataFrame:
    rows = [(t.split(":", 1)[0], t.split(":", 1)[1], float(w)) for t, w in coef.items()]
    return spark.createDataFrame(rows, "kind string, term string, weight double")


def _one_sided(coef: DataFrame, plus: str, minus: str) -> DataFrame:
    """Signed weight of each term: half the difference of its two one-sided weights."""
    sign = F.when(F.col("kind") == plus, 0.5).otherwise(-0.5)
    return coef.where(F.col("kind").isin(plus, minus)).groupBy("term").agg(F.sum(sign * F.col("weight")).alias("weight"))


def _centred(df: DataFrame, terms: int | None = None) -> DataFrame:
    """Weights less their mean over ``terms`` terms, those that are not in ``df`` being 0; by default its own."""
    mean = F.avg("weight") if terms is None else F.sum("weight") / F.lit(max(terms, 1))
    return df.withColumn("weight", F.col("weight") - df.agg(mean).scalar())


def fit_baseline(examples: DataFrame, key: str, a: str, b: str, y: str, val_fraction: float = 0.15, seed: int = 0,
                 c: float = 1.0, max_iter: int = 2000, pool: int | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Win model on membership (+1 own, -1 foe): (weights by member, validation metrics, intercept).

    Originals are split before mirrors are added; the final fit uses all examples, and the weights are centred over
    the ``pool`` members there are (by default those seen).  Equal examples are one row with its number of copies.
    """
    plain = materialise(examples.select(key, a, b, F.col(y).cast("int").alias(y)), "originals")  # the split reads them twice
    split = _cases(split_originals(plain, [key], val_fraction, seed), a, b, y)

    def mirrored(df: DataFrame) -> DataFrame:
        rows = with_mirror(df, a, b, y)
        main = lambda col, tag: F.transform(F.col(col), lambda i: F.concat(F.lit(f"{tag}:"), i.cast("string")))
        return rows.withColumn("_a", main(a, "a")).withColumn("_b", main(b, "b"))

    blocks = [("_a", _SIDE), ("_b", _SIDE)]
    apply, _, _ = fit_terms(mirrored(split.where("split = 'train'")), blocks, y, c, True, max_iter, "copies")
    metrics = _probabilities(apply(mirrored(split.where("split = 'val'"))), y)
    _, coef, intercept = fit_terms(mirrored(split), blocks, y, c, True, max_iter, "copies")
    theta = _centred(_one_sided(_coefficients(examples.sparkSession, coef), "a", "b"), pool)
    return theta.withColumnRenamed("term", "member"), metrics, intercept


def fit_interaction(examples: DataFrame, key: str, a: str, b: str, y: str, c_values: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0),
                    val_fraction: float = 0.15, seed: int = 0, max_iter: int = 3000,
                    pool: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Main, synergy and matchup weights with the penalty picked on validation log loss.

    Returns (kind, term, weight) and the tuning table.  Matchup weights are antisymmetric; main and synergy weights
    are centred over the ``pool`` members there are and all their pairs (by default those seen).  Equal examples are one
    row with its number of copies, and vectors are made once for all penalties.
    """
    spark = examples.sparkSession
    plain = materialise(examples.select(key, a, b, F.col(y).cast("int").alias(y)), "originals")  # the split reads them twice
    split = _cases(split_originals(plain, [key], val_fraction, seed), a, b, y)

    def features(df: DataFrame) -> DataFrame:
        rows = with_mirror(df, a, b, y)
        return rows.withColumn("_a", team_terms(F.col(a), "a")).withColumn("_b", team_terms(F.col(b), "b")).withColumn(
            "_v", matchup_terms(F.col(a), F.col(b)))

    blocks = [("_a", _SIDE), ("_b", _SIDE), ("_v", 1.0)]
    train = materialise(features(split.where("split = 'train'")), "train")
    vectors, _, _ = vectorise(train, blocks)
    known = materialise(vectors(train).select("_x", y, "copies"), "train-vectors")
    val = materialise(vectors(features(split.where("split = 'val'"))).select("_x", y, "copies"), "val-vectors")
    tuning = []
    for c in c_values:
        loss = _probabilities(fit_vectors(known, y, "copies", c, False, max_iter).transform(val), y).first()["log_loss"]
        tuning.append((float(c), float(loss)))
    best = min(tuning, key=lambda t: t[1])[0]
    _, coef, _ = fit_terms(materialise(features(split), "all"), blocks, y, best, False, max_iter, "copies")
    weights = _coefficients(spark, coef)
    main = _centred(_one_sided(weights, "am", "bm"), pool).select(F.lit("main").alias("kind"), "term", "weight")
    pair = _centred(_one_sided(weights, "as", "bs"), pool * (pool - 1) // 2 if pool else None).select(F.lit("synergy").alias("kind"), "term", "weight")
    i, j = F.split("term", ",")[0], F.split("term", ",")[1]
    match = _centred(weights.where("kind = 'v'").select("term", "weight"))
    both = match.select(F.explode(F.array(
        F.struct(F.col("term"), (0.5 * F.col("weight")).alias("weight")),
        F.struct(F.concat_ws(",", j, i).alias("term"), (-0.5 * F.col("weight")).alias("weight")))).alias("s")).select("s.*")
    anti = both.groupBy("term").agg(F.sum("weight").alias("weight")).select(F.lit("matchup").alias("kind"), "term", "weight")
    return main.unionByName(pair).unionByName(anti), spark.createDataFrame(tuning, "c double, val_loss double")


def _kinds(samples: DataFrame, key: str, members: str, y: str, fmt: str | None) -> DataFrame:
    """Different sets of samples that share a key, by what they hold, with the number of keys: _id, _s, _y, copies.

    Samples without a key (not ``_keyed``) stand alone.
    """
    sample = F.struct(F.col(members).alias("m"), *([F.col(fmt).alias("f")] if fmt else []))
    label = F.col(y).cast("int")
    keyed = samples.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sort_array(F.collect_list(sample)).alias("_s"), F.array_sort(F.transform(F.collect_list(F.struct(label.alias("y"))), lambda x: x["y"])).alias("_y"))
    alone = samples.where(F.col(key).isNull()).select(F.array(sample).alias("_s"), F.array(label).alias("_y"))
    both = keyed.select("_s", "_y", F.lit(True).alias("_keyed")).unionByName(alone.select("_s", "_y", F.lit(False).alias("_keyed")))
    counted = both.groupBy("_s", "_y", "_keyed").agg(F.count("*").alias("copies"))
    return materialise(counted.withColumn("_id", F.monotonically_increasing_id()), "sample-kinds")


def fit_presence(samples: DataFrame, key: str, members: str, y: str, min_games: int, n_pairs: int = 0,
                 fmt: str | None = None, c: float = 1.0, max_iter: int = 200) -> DataFrame:
    """Odds ratios of members, frequent pairs and formats: (feature, coefficient, odds)."""
    spark = samples.sparkSession
    kinds = _kinds(samples, key, members, y, fmt)
    seen = kinds.select("_id", "copies", F.explode("_s").alias("s"))
    long = seen.select("_id", "copies", F.explode(F.array_distinct("s.m")).alias("m"))
    games = long.groupBy("m").agg(F.sum("copies").alias("_n")).where(F.col("_n") >= min_games).select("m")
    keyed = F.col("_keyed")
    terms = long.join(games, "m", "left_semi").select("_id", F.concat(F.lit("member:"), F.col("m").cast("string")).alias("t"))
    if n_pairs:
        pairs = [(r["a"], r["b"]) for r in top_pairs(long.join(kinds.where(keyed).select("_id"), "_id", "left_semi"), "_id", "m", n_pairs, "copies").collect()]  # n_pairs rows
        have = F.filter(F.array(*[F.when(F.array_contains("s.m", a) & F.array_contains("s.m", b), F.lit(f"pair:{a}&{b}"))
                                  for a, b in pairs]), lambda x: x.isNotNull())
        terms = terms.unionByName(seen.select("_id", F.explode(have).alias("t")))
    if fmt:
        terms = terms.unionByName(seen.where("s.f IS NOT NULL").select("_id", F.concat(F.lit("format:"), F.col("s.f").cast("string")).alias("t")))
    rows = kinds.select("_id", "_keyed", "copies", F.explode("_y").alias(y)).join(
        terms.groupBy("_id").agg(F.collect_list("t").alias("_t")), "_id", "left").withColumn(
        "_t", F.when(keyed & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.array().cast("array<string>")))
    _, coef, _ = fit_terms(materialise(rows.select("_t", y, "copies"), "presence"), [("_t", 1.0)], y, c, True, max_iter, "copies")
    return spark.createDataFrame([(t, float(w), math.exp(w)) for t, w in coef.items()],
                                 "feature string, coefficient double, odds double")


@register_scorer("baseline")
def baseline_logits(examples: DataFrame, key: str, a: str, b: str, theta: DataFrame, intercept: float = 0.0) -> DataFrame:
    """Logit of each example: intercept + own weights - foe weights (theta: member, weight)."""
    cells = F.concat(F.transform(a, lambda m: F.struct(m.cast("string").alias("member"), F.lit(1.0).alias("sign"))),
                     F.transform(b, lambda m: F.struct(m.cast("string").alias("member"), F.lit(-1.0).alias("sign"))))
    sums = (examples.select(key, F.explode(cells).alias("c")).select(key, "c.*")
            .join(theta.select(F.col("member").cast("string").alias("member"), "weight"), "member")
            .groupBy(key).agg(F.sum(F.col("sign") * F.col("weight")).alias("_s")))
    return examples.join(sums, key, "left").withColumn("logit", intercept + F.coalesce("_s", F.lit(0.0))).drop("_s")


@register_scorer("interaction")
def interaction_logits(examples: DataFrame, key: str, a: str, b: str, weights: DataFrame, intercept: float = 0.0) -> DataFrame:
    """Logit from main, synergy and matchup weights (kind, term, weight)."""
    signed = lambda terms, s: F.transform(terms, lambda t: F.struct(t.alias("t"), F.lit(s).alias("sign")))
    cells = F.concat(signed(team_terms(F.col(a), ""), 1.0), signed(team_terms(F.col(b), ""), -1.0),
                     signed(matchup_terms(F.col(a), F.col(b)), 1.0))
    tag = F.when(F.col("kind") == "main", "m:").when(F.col("kind") == "synergy", "s:").otherwise("v:")
    table = weights.select(F.concat(tag, F.col("term")).alias("t"), "weight")
    sums = (examples.select(key, F.explode(cells).alias("c")).select(key, "c.*").join(table, "t")
            .groupBy(key).agg(F.sum(F.col("sign") * F.col("weight")).alias("_s")))
    return examples.join(sums, key, "left").withColumn("logit", intercept + F.coalesce("_s", F.lit(0.0))).drop("_s")


def make_scorer(kind: str) -> Callable:
    """Scorer of a model type."""
    if kind not in SCORERS:
        raise KeyError(f"no scorer for model type {kind}; known: {sorted(SCORERS)}")
    return SCORERS[kind]


def win_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("logit"))))


def best_swaps(teams: DataFrame, team: str, members: str, pool: DataFrame, member: str, clause: str, score: str,
               size: int = 6) -> DataFrame:
    """Best legal replacement of one member of each team under an additive score.

    A candidate must not be in the team or share a clause with the five that stay.  A team blocks at most
    ``size`` members and ``size`` clauses, so the best candidate is always among the two best members of the
    ``size`` + 1 best clauses: that shortlist, not the pool, meets the teams.
    """
    per_clause = top_per(pool, [clause], [F.desc(score), member], 2, "_i")
    heads = per_clause.groupBy(clause).agg(F.max(score).alias("_best")).orderBy(F.desc("_best"), clause).limit(size + 1)
    short = per_clause.join(heads.select(clause), clause).agg(F.sort_array(F.collect_list(F.struct(
        F.col(score).alias("s"), F.negate(F.col(member)).alias("n"), F.col(clause).alias("c"), F.col(member).alias("m"))), asc=False))
    have = teams.select(team, F.posexplode(members).alias("slot", member)).join(pool, member)
    sets = have.groupBy(team).agg(F.collect_list(F.struct("slot", F.col(member).alias("m"), F.col(clause).alias("c"), F.col(score).alias("s"))).alias("_t"))
    # Worked out once per team, in steps: what a lambda refers to is not worked out again for each candidate.
    step = lambda df, **columns: df.select(F.inline(F.array(F.struct(*df.columns, *[c.alias(n) for n, c in columns.items()]))))
    rows = step(sets, _ids=F.transform("_t", lambda t: t["m"]), _clauses=F.transform("_t", lambda t: t["c"]), _short=short.scalar())
    rows = step(rows, _free=F.filter("_short", lambda o: ~F.array_contains("_ids", o["m"])))
    # Whoever shares no clause with the team fits every slot, so nobody after the first of them is asked for.
    alone = F.array_position(F.transform("_free", lambda o: ~F.array_contains("_clauses", o["c"])), F.lit(True)).cast("int")
    rows = step(rows, _asked=F.when(alone > 0, F.slice("_free", F.lit(1), alone)).otherwise(F.col("_free")))
    legal = lambda x: F.filter("_asked", lambda o: ~F.exists("_t", lambda t: (t["m"] != x["m"]) & (t["c"] == o["c"])))
    swaps = F.transform("_t", lambda x: F.struct(x.alias("x"), F.try_element_at(legal(x), F.lit(1)).alias("i")))
    gains = F.transform(F.filter(swaps, lambda z: z["i"].isNotNull()), lambda z: F.struct(
        (z["i"]["s"] - z["x"]["s"]).alias("gain"), F.negate(z["x"]["slot"]).alias("n"), z["x"]["slot"].alias("slot"), z["x"]["m"].alias("out"), z["i"]["m"].alias("in")))
    best = rows.select(team, F.array_max(gains).alias("b"))
    return best.where("b.gain > 0").select(team, "b.slot", "b.out", "b.in", "b.gain")


def top_team(pool: DataFrame, member: str, clause: str, score: str, size: int = 6) -> DataFrame:
    """Highest-scored members, one per clause."""
    return top_per(pool, [clause], [F.desc(score), member], 1, "_i").drop("_i").orderBy(F.desc(score), member).limit(size)


def lead_examples(first_states: DataFrame, key: str, own: Column, foe: Column, lead: Column, size: int = 6) -> DataFrame:
    """Both teams in canonical order and the index of the own lead; incomplete teams are dropped."""
    rows = first_states.select(key, F.sort_array(F.array_distinct(own)).alias("own"), F.sort_array(F.array_distinct(foe)).alias("foe"), lead.alias("_l"))
    return rows.where((F.size("own") == size) & (F.size("foe") == size)).withColumn(
        "lead_index", (F.array_position("own", F.col("_l")) - 1).cast("int")).drop("_l")
