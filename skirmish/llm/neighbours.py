"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

A table hashes a unit vector to floor((a.x + b) / width) for several Gaussian a (Datar et al. 2004).  A query visits its
own bucket and perturbed ones in the order of their expected success (Lv et al. 2007: the order of perturbation sets
depends on their ranks only, so it is worked out once).  Candidates of all tables are ranked by the exact cosine.

How likely a neighbour is found depends on its distance alone, so for each number of probes the lowest score is worked
out at which they find it with the wanted recall.  A query whose k-th neighbour found is no better than that goes on
to further rounds, with four times the probes in the same order of success.  Only a query that has fewer than k candidates
when the probes end is compared with every vector, in blocks of queries.

Equal vectors are one class, searched and ranked once, with their few smallest identifiers.  Bucket keys are dealt to
parts; the few keys with very many vectors are dealt to several parts, and their probes visit all of these.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_ROW = "part int, probe boolean, class long, ids array<long>, vector binary, keys binary"


def perturbations(hashes: int, most: int) -> np.ndarray:
    """Rows of 0/1 over the 2 * ``hashes`` ranks of single steps, most promising first; the first row is no step."""
    rank = np.arange(1, 2 * hashes + 1)
    low = rank * (rank + 1) / (4 * (hashes + 1) * (hashes + 2))
    back = 2 * hashes + 1 - rank
    high = 1 - back / (hashes + 1) + back * (back + 1) / (4 * (hashes + 1) * (hashes + 2))
    score = np.where(rank <= hashes, low, high)
    rows, heap = [()], [(score[0], (0,))]
    while heap and len(rows) < most:
        value, steps = heapq.heappop(heap)
        last = steps[-1]
        if last + 1 < 2 * hashes:
            heapq.heappush(heap, (value + score[last + 1], steps + (last + 1,)))
            heapq.heappush(heap, (value - score[last] + score[last + 1], steps[:-1] + (last + 1,)))
        if not any(2 * hashes - 1 - s in steps for s in steps):  # a coordinate can't step both ways
            rows.append(steps)
    out = np.zeros((len(rows), 2 * hashes))
    for i, steps in enumerate(rows):
        out[i, list(steps)] = 1
    return out


@dataclass
class Hasher:
    """The functions of all tables, drawn from ``seed``."""

    dimension: int
    tables: int
    hashes: int
    width: float
    probes: int
    seed: int = 11
    reach: float = 1.0

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.lines = rng.standard_normal((self.tables, self.dimension, self.hashes))
        self.shifts = rng.random((self.tables, 1, self.hashes))
        self.mixers = rng.integers(0, 1 << 63, (self.tables, self.hashes), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.starts = rng.integers(0, 1 << 63, self.tables, dtype=np.int64).astype(np.uint64)

    def places(self, unit: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tdh->tnh", unit, self.lines) / self.width + self.shifts

    def _keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        mixed = (cells.astype(np.int64).astype(np.uint64) * self.mixers[table]).sum(-1, dtype=np.uint64) + self.starts[table]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(29))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The key of each vector in each table: (vectors, tables)."""
        cells = np.floor(self.places(unit))
        return np.stack([self._keys(cells[t], t) for t in range(self.tables)], axis=1)

    def visits(self, unit: np.ndarray) -> np.ndarray:
        """The keys each query visits, in order: (vectors, tables, probes)."""
        sets = perturbations(self.hashes, self.probes)
        where = self.places(unit)
        cells = np.floor(where)
        down = where - cells
        order = np.argsort(np.concatenate([down, 1 - down], axis=-1), axis=-1, kind="stable")
        out = []
        for t in range(self.tables):
            step = np.zeros((len(unit), 2 * self.hashes, self.hashes))
            rows, ranks = np.ogrid[:len(unit), :2 * self.hashes]
            step[rows, ranks, order[t] % self.hashes] = np.where(order[t] < self.hashes, -1, 1)
            out.append(self._keys(cells[t][:, None, :] + sets @ step, t))
        return np.stack(out, axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def fit(sample: np.ndarray, rows: int, k: int, tables: int = 10, width: float = 2.0, recall: float = 0.97,
        queries: int = 128, most: int = 1 << 12) -> Hasher:
    """Hash functions for ``rows`` vectors, with the fewest probes that find ``recall`` of the ``k`` nearest
    within the sample.  Neighbours among all rows are nearer than those in a sample, so are found oftener; for
    queries of which that isn't true, ``reach`` is the lowest score that the recall of ``_reach`` still holds for."""
    hashes = max(2, round(math.log2(max(rows, 4)) / 2))
    hasher = Hasher(sample.shape[1], tables, hashes, width, most)
    some = unit(sample[:queries])
    scores = some @ unit(sample).T
    scores[np.arange(len(some)), np.arange(len(some))] = -2
    near = np.argsort(-scores, axis=1)[:, :min(k, len(sample) - 1)]
    keys = hasher.keys(unit(sample))
    found = []
    for first in range(0, len(some), 16):
        visits = hasher.visits(some[first:first + 16])
        for i, visit in enumerate(visits, first):
            hit = visit[None] == keys[near[i]][:, :, None]
            found += np.where(hit.any(2), hit.argmax(2), most).min(1).tolist()
    ranks = np.sort(found)
    if len(ranks):
        hasher.probes = int(min(most, ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)] + 1))
    hasher.reach = _reach(hasher, some[:64])
    return hasher


def _further(hasher: Hasher, some: np.ndarray, most: int) -> Hasher:
    """The same hash functions with four times the probes."""
    more = replace(hasher, probes=min(most, 4 * hasher.probes))
    more.reach = _reach(more, some[:64])
    return more


def _reach(hasher: Hasher, some: np.ndarray, recall: float = 0.93, steps: int = 32, each: int = 8) -> float:
    """The lowest of ``steps`` cosines such that the probes find ``recall`` of random vectors at it and all above."""
    if hasher.dimension < 2:
        return 1.0
    rng = np.random.default_rng(hasher.seed)
    angles = np.linspace(0, math.pi, steps + 1)[1:, None, None]
    found = np.zeros(steps)
    for first in range(0, len(some), 16):
        for x, visit in zip(some[first:first + 16], hasher.visits(some[first:first + 16])):
            aside = rng.standard_normal((each, hasher.dimension))
            aside = unit(aside - (aside @ x)[:, None] * x)
            keys = hasher.keys((np.cos(angles) * x + np.sin(angles) * aside).reshape(-1, hasher.dimension))
            hit = np.stack([np.isin(keys[:, t], visit[t]) for t in range(hasher.tables)]).any(0)
            found += hit.reshape(steps, each).mean(1)
    enough = int(np.argmin(np.append(found >= recall * len(some), False)))
    return math.cos(angles[enough - 1, 0, 0]) if enough else 1.0


def usable(vector: Column) -> Column:
    """Not null, every component a finite number, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _dealt(hasher: Hasher, parts: int, hot: dict[int, int], probe: bool):
    """Rows by part: a class with its keys there, or a query with the keys it visits there."""

    def run(batches):
        for batch in batches:
            rows = []
            for first in range(0, len(batch), 64):
                some = batch.slice(first, 64)
                vectors = _matrix(some.column("vector"), hasher.dimension)
                keys = hasher.visits(unit(vectors)) if probe else hasher.keys(unit(vectors))
                for i, (cls, ids) in enumerate(zip(some.column("class").to_pylist(), some.column("ids").to_pylist())):
                    own = np.unique(keys[i])
                    where = (own % np.uint64(parts)).astype(np.int64)
                    for key in hot.keys() & set(own.tolist()):
                        spread, at = hot[key], np.flatnonzero(own == np.uint64(key))[0]
                        if probe:  # the other parts of this key
                            own = np.append(own, np.full(spread - 1, own[at]))
                            where = np.append(where, (where[at] + np.arange(1, spread)) % parts)
                        else:
                            where[at] = (where[at] + cls % spread) % parts
                    order = np.argsort(where, kind="stable")
                    found, starts = np.unique(where[order], return_index=True)
                    for part, mine in zip(found.tolist(), np.split(own[order], starts[1:])):
                        rows.append((part, probe, cls, ids, vectors[i].tobytes(), mine.tobytes()))
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kd) for c, kd in zip(zip(*rows), kinds)],
                                                 [x.split()[0] for x in _ROW.split(", ")])

    return run


def _searched(k: int):
    """The ``k`` + 1 best classes of each query in one part."""

    def run(table: pa.Table) -> pa.Table:
        probe = table["probe"].to_numpy()
        index, queries = table.filter(pa.array(~probe)), table.filter(pa.array(probe))
        rows = []
        if len(index) and len(queries):
            vectors = np.frombuffer(b"".join(index["vector"].to_pylist()), np.float64).reshape(len(index), -1)
            units = unit(vectors).astype(np.float32)
            norms = np.sqrt((vectors * vectors).sum(1))
            ids, classes = index["ids"].to_pylist(), index["class"].to_numpy()
            firsts = np.array([x[0] for x in ids])
            listed = index["keys"].to_pylist()
            owner = np.repeat(np.arange(len(index)), [len(x) // 8 for x in listed])
            keys = np.frombuffer(b"".join(listed), np.uint64)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            for cls, vector, visited in zip(*[queries[c].to_pylist() for c in ("class", "vector", "keys")]):
                vector, visited = np.frombuffer(vector, np.float64), np.frombuffer(visited, np.uint64)
                low, high = np.searchsorted(keys, visited), np.searchsorted(keys, visited, side="right")
                sizes = high - low
                if not sizes.any():
                    continue
                entries = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                chosen = np.zeros(len(index), bool)
                chosen[owner[entries]] = True
                found = np.flatnonzero(chosen)
                norm = math.sqrt((vector * vector).sum())
                rough = units[found] @ (vector / norm).astype(np.float32)
                if len(found) > k + 1:  # single precision is right to less than this margin
                    found = found[rough >= np.partition(rough, -k - 1)[-k - 1] - 1e-5]
                exact = (vectors[found] * vector).sum(1) / (norms[found] * norm)
                best = np.lexsort((firsts[found], -exact))[:k + 1]
                rows += [(cls, int(classes[found[i]]), ids[found[i]], float(exact[i])) for i in best]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
        return pa.table([pa.array(c, kd) for c, kd in zip(list(zip(*rows)) or [[]] * 4, kinds)],
                        ["query", "class", "ids", "score"])

    return run


def _scanned(classes: np.ndarray, asked: np.ndarray, k: int):
    """The ``k`` + 1 best of all classes for each of a block of queries."""

    def run(batches):
        norms, names = np.sqrt((asked * asked).sum(1)), ["query", "class", "ids", "score"]
        wanted, best = unit(asked).astype(np.float32).T, [[] for _ in classes]
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, len(b), 4096)):
            vectors, ids = _matrix(batch.column("vector"), asked.shape[1]), batch.column("ids").to_pylist()
            own, firsts = batch.column("class").to_numpy(), np.array([x[0] for x in ids])
            lengths = np.sqrt((vectors * vectors).sum(1))
            rough = unit(vectors).astype(np.float32) @ wanted
            least = np.partition(rough, -k - 1, axis=0)[-k - 1] if len(ids) > k + 1 else np.full(len(classes), -2.0)
            for q in range(len(classes)):
                held = best[q][-1][0] if len(best[q]) > k else -2.0
                found = np.flatnonzero(rough[:, q] >= max(least[q], held) - 1e-5)
                if len(found):
                    exact = (vectors[found] * asked[q]).sum(1) / (lengths[found] * norms[q])
                    order = np.lexsort((firsts[found], -exact))[:k + 1]
                    new = [(float(exact[i]), int(firsts[found[i]]), int(own[found[i]]), ids[found[i]]) for i in order]
                    best[q] = sorted(best[q] + new, key=lambda x: (-x[0], x[1]))[:k + 1]
        rows = [(int(c), x[2], x[3], x[0]) for c, some in zip(classes, best) for x in some]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
        for first in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, kd) for c, kd in zip(zip(*rows[first:first + 8192]), kinds)], names)

    return run


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            sample: int = 2000, tables: int = 10, width: float = 2.0, recall: float = 0.97, block: int = 2048, most: int = 1 << 10) -> DataFrame:
    """query_id, rank, ``id_col``, score: the ``k`` nearest found of each row for which ``queries`` is true.

    Score is the cosine in double precision, ties go to the smaller identifier, a row is not its own neighbour.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an identifier
    or vectors of another length than the commonest; rows that repeat identifier and vector count once.  The hash
    functions are fitted on ``sample`` vectors, every row is indexed.  A query whose neighbours may have been missed is
    probed further, up to ``most`` buckets a table; one with fewer than ``k`` candidates then is compared with all vectors,
    about ``block`` such queries at once.  Each has ``k`` rows, or all there are.  An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.where(queries.isNotNull() & F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if lengths is None:
        return empty
    rows = rows.where(F.size("vector") == lengths["size"])
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.select("id", "vector").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = materialise(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                          .withColumn("class", F.xxhash64("vector")), "ann-classes")
    asking = materialise(rows.where("asks").select("id", F.xxhash64("vector").alias("class")).distinct(), "ann-asking")
    total = classes.count()
    taken = classes.orderBy(F.xxhash64("class")).limit(sample).select("vector").toPandas()["vector"]
    hasher = fit(np.stack(taken.to_numpy()).astype(np.float64), total, k, tables, width, recall)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches):
        for batch in batches:
            found = hasher.keys(unit(_matrix(batch.column("vector"), hasher.dimension)))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64).ravel())], ["key"])

    # At most 4 * parts keys can hold more than a quarter of a part's share each.
    limit = math.ceil(total * tables / (4 * parts))
    crowded = classes.select("vector").mapInArrow(keyed, "key long").groupBy("key").count().where(F.col("count") > max(limit, 1000)).collect()
    hot = {r["key"] & (1 << 64) - 1: min(parts, math.ceil(r["count"] / max(limit, 1000))) for r in crowded}
    index = classes.mapInArrow(_dealt(hasher, parts, hot, False), _ROW)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    upto = F.sum(F.size("ids")).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    pending, answers, some = asking.select("class").distinct(), [], np.stack(taken.to_numpy()[:64]).astype(np.float64)
    most = min(most, 3 ** hasher.hashes)  # all single steps there are
    while True:
        probes = classes.join(pending, "class", "left_semi").mapInArrow(_dealt(hasher, parts, hot, True), _ROW)
        found = index.unionByName(probes).groupBy("part").applyInArrow(
            _searched(k), "query long, class long, ids array<long>, score double")
        round_ = materialise(found.dropDuplicates(["query", "class"]).withColumn("nth", F.row_number().over(ranked))
                             .where(F.col("nth") <= k + 1).select("query", "ids", "score", upto.alias("upto")), "ann-round")
        last = hasher.probes >= most
        enough = (F.col("upto") > k) if last else (F.col("upto") > k) & (F.col("score") >= hasher.reach - 1e-9)
        sure = round_.where(enough).select("query").distinct()
        answers.append(round_.drop("upto").join(sure, "query", "left_semi"))
        pending = materialise(pending.join(sure, pending["class"] == sure["query"], "left_anti"), "ann-pending")
        if last or pending.isEmpty():
            break
        hasher = _further(hasher, unit(some), most)
    best = materialise(reduce(DataFrame.unionByName, answers), "ann-best")
    unsure = materialise(classes.join(pending, "class", "left_semi").select("class", "vector"), "ann-unsure")
    blocks = math.ceil(unsure.count() / block)
    if blocks:
        dealt, scans = materialise(classes.repartition(parts, "class"), "ann-dealt"), []
        for i in range(blocks):
            some = unsure.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == i).toPandas()
            if len(some):
                asked = np.stack(some["vector"].to_numpy()).astype(np.float64)
                scan = dealt.mapInArrow(_scanned(some["class"].to_numpy(), asked, k), "query long, class long, ids array<long>, score double")
                scans.append(materialise(scan.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1)
                                         .select("query", "ids", "score"), "ann-scan"))
        for scan in scans:
            best = best.unionByName(scan)
    pairs = (asking.join(best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near")),
                         F.col("class") == F.col("query"))
             .select(F.col("id").alias("query_id"), F.explode("near").alias("near"))
             .select("query_id", "near.score", F.explode("near.ids").alias("other"))
             .where(F.col("other") != F.col("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "other")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("other").alias(id_col), "score"))
