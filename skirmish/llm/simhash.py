"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Covering hashing (Pagh 2016): bit i gets a non-zero vector f(i) of radius+1 bits, table v keeps the bits with an odd
product <f(i), v>.  The differing bits of two fingerprints within the radius span at most ``radius`` dimensions, so
some v is orthogonal to all of them, and both fingerprints agree on every bit that table v keeps: no pair is missed.

A table bucket of a few fingerprints is compared in full.  Fingerprints of larger buckets (thousands of near copies)
emit all fingerprints within half the radius instead: two are within the radius exactly if they emit one in
common, and all that emit the same one are within the radius of each other, so a star holds every link among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .graph import components
from .text import word_blocks

BITS = 64


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; of all words if they are fewer."""
    tail: list[bytes] = []
    seen = False
    for block in word_blocks(text):
        words = tail + block
        tail = words[-(width - 1):] if width > 1 else []
        if len(words) >= width:
            seen = True
            parts = map(b" ".join, zip(*[words[i:] for i in range(width)]))
            yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(words) - width + 1)
        elif not seen:
            tail = words
    if not seen and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], np.uint64)


def simhash(text: bytes | None, width: int = 4) -> int:
    """Bit i is set if it is set in over half the hashes; 0 for a text without words."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes((text or b"").lower(), width):
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, fp (signed 64 bits) of every row, from whole texts; null counts as empty."""

    def run(batches):
        for batch in batches:
            fps = [simhash(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int) -> list[int]:
    """The bits each table keeps, as signed numbers; every non-zero vector serves about equally many bits."""
    vectors = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        kept = sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2)
        masks.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return masks


def _ball(radius: int) -> list[int]:
    """All bit patterns of at most ``radius`` ones, as signed numbers."""
    sets = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(BITS), n)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in sets]


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root) for each fingerprint reached from a smaller one over links within ``radius``."""
    rest, out = np.sort(fps).view(np.uint64), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for part in np.array_split(front, len(front) // 256 + 1):
                near |= (np.bitwise_count(part[:, None] ^ rest[None, :]) <= radius).any(0)
            front, rest = rest[near], rest[~near]
            out += [(x, int(root.view(np.int64))) for x in front.view(np.int64).tolist()]
    return out


def links(fps: DataFrame, radius: int = 4, compared: int = 1024) -> DataFrame:
    """a, b: links between the distinct fingerprints ``fp`` that connect all pairs within ``radius`` (an even
    number).  Buckets of up to ``compared`` fingerprints are compared in one task, larger ones through
    common neighbours; either way every pair within the radius is connected."""
    if radius % 2 or radius < 2:
        raise ValueError("radius must be even and positive")
    kept = F.explode(F.array(*[F.lit(m) for m in covering_masks(radius)])).alias("kept")
    keyed = fps.select("fp", kept).select("fp", "kept", F.col("fp").bitwiseAND(F.col("kept")).alias("key"))
    full = keyed.groupBy("kept", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Spark sizes exploded rows like those they come from and would broadcast many times its threshold.
    shared = materialise(keyed.hint("merge").join(full, ["kept", "key"]).select("kept", "key", "fp", "n"), "simhash-buckets")

    def compare(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fps_ in batch.column(0):
                out += spanning_links(fps_.values.to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                              pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    small = (shared.where(F.col("n") <= compared).groupBy("kept", "key").agg(F.collect_list("fp").alias("fps"))
             .select("fps").mapInArrow(compare, "a long, b long"))
    dense = shared.where(F.col("n") > compared).select("fp").distinct()
    around = dense.select("fp", F.explode(F.array(*[F.lit(x) for x in _ball(radius // 2)])).alias("x")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    centre = around.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1)
    stars = around.hint("merge").join(centre.select("z", "b"), "z").select(F.col("fp").alias("a"), "b")
    return small.unionByName(stars).where(F.col("a") != F.col("b")).distinct()


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                    radius: int = 4) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id.

    Fingerprints are of ``width``-word shingles of the text lower-cased in A-Z; those within ``radius`` bits are
    linked and component_id is the smallest identifier of the component.  Null and empty texts have fingerprint
    zero, linked like any other.  A null identifier is never a component_id unless the component has no other.
    Repeated rows repeat; other columns are not read; an empty table gives none.
    """
    signed = materialise(fingerprints(docs, id_col, text_col, width), "simhash-signed")
    first = materialise(signed.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = components(links(first.select("fp"), radius), "simhash-components")
    member = materialise(first.join(roots, first["fp"] == roots["node"], "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-members")
    group = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(member.join(group, "root").select("fp", "component_id"), "simhash-named")
    return signed.join(named, "fp").select(F.col("id").alias(id_col), fingerprint_hex(F.col("fp")).alias("fingerprint"),
                                           "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
             radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest identifier of their component; of several such
    rows (repeats, shared or null identifiers) one stays."""
    groups = near_duplicates(docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("key"),
                                         F.col(text_col).alias("text")), "key", "text", width, radius)
    winners = (groups.where(F.col("key").eqNullSafe(F.col("component_id"))).select("key").distinct()
               .select(F.col("key.h").alias("_h"), F.col("key.i").alias("_id")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_rid"),
                       F.xxhash64(text_col).alias("_rh"))
    kept = rows.join(winners, (F.col("_rh") == F.col("_h")) & F.col("_rid").eqNullSafe(F.col("_id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_rh", "_rid").orderBy(F.lit(1)))
    return kept.withColumn("_nth", nth).where(F.col("_nth") == 1).select("row.*")
