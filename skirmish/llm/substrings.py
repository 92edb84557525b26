"""Repeated passages by difference-cover anchors.

A window of W words that occurs twice shares, at some offset below the period v, a run of W-v+1 words that starts at
a cover position (modulo v) of both documents, whatever their alignment.  So only such runs are hashed (4 of 13
positions for W = 20), and only windows around runs that occur more than once are hashed in full.  The first
occurrence of a window stays, every later one is removed.

Hashes travel in packed rows, one per flush of about ``flush_words`` words and bucket; repeats inside a flush are
settled there, so a passage that a third of all documents share reaches a bucket once per flush.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import word_blocks

#: Perfect difference sets: every residue is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_FACTOR, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes kept of a hash beside its bucket.  An anchor that is taken for another only costs a look at its windows.
ANCHOR_BYTES, WINDOW_BYTES = 6, 8
_PACKED = "bucket int, flush long, hashes binary, offsets binary, shared binary, ids binary, ties binary, bases binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves runs of over a third of the window, and its cover."""
    period = max(p for p in COVERS if p == 1 or p <= 2 * window // 3)
    return period, COVERS[period]


def word_hashes(text: bytes) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))
             for words in word_blocks(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def rolling(hashes: np.ndarray, width: int, factor: np.uint64 = _FACTOR) -> np.ndarray:
    """A hash of each run of ``width`` values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc *= factor
        acc += hashes[k:k + n]
    acc ^= acc >> np.uint64(32)
    acc *= _SECOND
    return acc ^ (acc >> np.uint64(29))


def packed_offsets(offsets: np.ndarray) -> bytes:
    """Ascending offsets in two bytes each, behind the number of them in each page of 65,536."""
    pages = np.bincount(offsets >> 16).astype(np.uint32)
    return np.uint32(len(pages)).tobytes() + pages.tobytes() + offsets.astype(np.uint16).tobytes()


def unpacked_offsets(data: bytes) -> np.ndarray:
    size = int(np.frombuffer(data, np.uint32, 1)[0])
    pages = np.frombuffer(data, np.uint32, size, 4)
    low = np.frombuffer(data, np.uint16, offset=4 + 4 * size)
    return np.repeat(np.arange(size, dtype=np.uint32) << np.uint32(16), pages) | low


def _shortened(hashes: np.ndarray, width: int) -> bytes:
    return hashes.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _lengthened(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


class _Flush:
    """Documents gathered until they are worth a row per bucket."""

    def __init__(self) -> None:
        self.ids, self.ties, self.hashes, self.marks, self.words, self.seen = [], [], [], [], 0, set()

    def add(self, ident: int, tie: int, hashes: np.ndarray, marks: np.ndarray | None) -> None:
        if (ident, tie) not in self.seen:
            self.seen.add((ident, tie))
            self.ids.append(ident)
            self.ties.append(tie)
            self.hashes.append(hashes)
            self.marks.append(marks)
            self.words += len(hashes)

    def columns(self):
        sizes = np.array([len(h) for h in self.hashes])
        bases = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint32)
        place = np.arange(self.words) - np.repeat(bases, sizes)
        left = np.repeat(sizes, sizes) - place
        return np.array(self.ids), np.array(self.ties), bases, sizes, np.concatenate(self.hashes), place, left


def _rows(flush: int, buckets: int, where: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, shared_where: np.ndarray,
          shared: np.ndarray, settled: np.ndarray, ids, ties, bases, width: int) -> pa.RecordBatch:
    """A row per bucket, and one with the flush's documents and the offsets that are settled already.  ``offsets``
    ascend, hashes keep ``width`` bytes."""
    order, more = np.argsort(where, kind="stable"), np.argsort(shared_where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    more_cuts = np.searchsorted(shared_where[more], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        own, out = order[cuts[b]:cuts[b + 1]], more[more_cuts[b]:more_cuts[b + 1]]
        if len(own) or len(out):
            rows.append((b, flush, _shortened(hashes[own], width), packed_offsets(offsets[own]), _shortened(shared[out], width),
                         None, None, None))
    rows.append((flush % buckets, flush, None, packed_offsets(np.sort(settled)), None,
                 ids.tobytes(), ties.tobytes(), bases.tobytes()))
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                      [x.split()[0] for x in _PACKED.split(", ")])


def _packer(buckets: int, window: int, flush_words: int, marked: bool) -> Callable:
    """Packs anchors (``marked`` false) or the windows around repeated anchors (true) of id, tie, text[, marks]."""
    period, cover = cover_for(window)
    run = window - period + 1
    in_cover = np.isin(np.arange(period), cover)

    def anchors(flush: _Flush, number: int) -> pa.RecordBatch:
        ids, ties, bases, _, hashes, place, left = flush.columns()
        offsets = np.flatnonzero((left >= run) & in_cover[place % period])
        found = rolling(hashes, run)[offsets]
        order = np.argsort(found, kind="stable")
        ordered = found[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, bool)
        sizes = np.diff(np.append(np.flatnonzero(first), len(ordered)))
        single = np.repeat(sizes == 1, sizes)
        alone, several = np.sort(order[single]), order[first & ~single]
        return _rows(number, buckets, found[alone] % buckets, found[alone], offsets[alone],
                     found[several] % buckets, found[several], offsets[order[~single]], ids, ties, bases, ANCHOR_BYTES)

    def windows(flush: _Flush, number: int) -> pa.RecordBatch:
        ids, ties, bases, sizes, hashes, _, left = flush.columns()
        marks = np.zeros(len(hashes) + 1, np.int32)
        for base, size, live in zip(bases, sizes, flush.marks):
            np.add.at(marks, base + np.maximum(live.astype(np.int64) - period + 1, 0), 1)
            np.add.at(marks, base + live.astype(np.int64) + 1, -1)
        offsets = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & (left >= window))
        found = rolling(hashes, window)[offsets]
        where = rolling(hashes, window, _SECOND)[offsets] % buckets
        order = np.lexsort((found, where))  # stable: equal windows stay in the order of their offsets
        same = (found[order][1:] == found[order][:-1]) & (where[order][1:] == where[order][:-1])
        first = np.concatenate([[True], ~same]) if len(order) else np.empty(0, bool)
        kept, none = np.sort(order[first]), np.empty(0, np.uint64)
        return _rows(number, buckets, where[kept], found[kept], offsets[kept], none, none,
                     offsets[order[~first]], ids, ties, bases, WINDOW_BYTES)

    def pack(batches):
        flush, number = _Flush(), TaskContext.get().partitionId() << 32
        emit = windows if marked else anchors
        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)]):
                hashes = word_hashes(row[2].as_py())
                if len(hashes) >= window:
                    flush.add(row[0].as_py(), row[1].as_py(), hashes,
                              np.frombuffer(row[3].as_py(), np.uint32) if marked else None)
                if flush.words >= flush_words:
                    yield emit(flush, number)
                    flush, number = _Flush(), number + 1
        if flush.words:
            yield emit(flush, number)

    return pack


def _joined(parts: list[bytes | None], width: int) -> np.ndarray:
    return _lengthened(b"".join(p or b"" for p in parts), width)


def _settle_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket, the offsets of the anchors that occur more than once, by flush."""
    hashes, shared = [_joined(table[c].to_pylist(), ANCHOR_BYTES) for c in ("hashes", "shared")]
    sizes = [len(x or b"") // ANCHOR_BYTES for x in table["hashes"].to_pylist()]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found = np.concatenate([hashes, shared])
    order = np.argsort(found, kind="stable")
    run = np.cumsum(np.concatenate([[0], found[order][1:] != found[order][:-1]])) if len(found) else np.empty(0, int)
    live_run = np.bincount(run, weights=np.where(order >= len(hashes), 2, 1)) > 1
    live = np.empty(len(found), bool)
    live[order] = live_run[run]
    return _returned(table, owner, live[:len(hashes)])


def _settle_windows(table: pa.Table) -> pa.Table:
    """Of one bucket, the offsets of the windows that occur in an earlier flush too, by flush."""
    table = table.sort_by("flush")
    found = _joined(table["hashes"].to_pylist(), WINDOW_BYTES)
    owner = np.repeat(np.arange(len(table)), [len(x or b"") // WINDOW_BYTES for x in table["hashes"].to_pylist()])
    order = np.argsort(found, kind="stable")
    later = np.zeros(len(found), bool)
    later[order[1:]] = found[order][1:] == found[order][:-1]
    return _returned(table, owner, later)


def _returned(table: pa.Table, owner: np.ndarray, chosen: np.ndarray) -> pa.Table:
    rows = []
    for i, (flush, h, offsets, *docs) in enumerate(zip(*[table[c].to_pylist() for c in (
            "flush", "hashes", "offsets", "ids", "ties", "bases")])):
        if h is None:
            rows.append((flush, offsets, *docs))
        else:
            a, b = np.searchsorted(owner, [i, i + 1])
            own = unpacked_offsets(offsets)[chosen[a:b]]
            if len(own):
                rows.append((flush, packed_offsets(own), None, None, None))
    kinds = [pa.int64()] + [pa.binary()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)],
                    ["flush", "offsets", "ids", "ties", "bases"])


def _by_document(table: pa.Table) -> pa.Table:
    """Of one flush, the chosen positions of each document that has any."""
    offsets = np.sort(np.concatenate([unpacked_offsets(x) for x in table["offsets"].to_pylist()]))
    whole = table.filter(table["ids"].is_valid())
    ids, ties, bases = [np.frombuffer(whole[c][0].as_py(), k) for c, k in (
        ("ids", np.int64), ("ties", np.int64), ("bases", np.uint32))]
    cuts = np.append(np.searchsorted(offsets, bases), len(offsets))
    some = np.flatnonzero(np.diff(cuts))
    marks = [(offsets[cuts[i]:cuts[i + 1]] - bases[i]).tobytes() for i in some]
    return pa.table([pa.array(ids[some]), pa.array(ties[some]), pa.array(marks, pa.binary())], ["id", "tie", "marks"])


def _positions(docs: DataFrame, window: int, flush_words: int, marked: bool) -> DataFrame:
    """id, tie, marks: by document, the positions of repeated anchors, or of windows that occur earlier."""
    buckets = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(_packer(buckets, window, flush_words, marked), _PACKED)
    settled = packed.groupBy("bucket").applyInArrow(
        _settle_windows if marked else _settle_anchors,
        "flush long, offsets binary, ids binary, ties binary, bases binary")
    return settled.groupBy("flush").applyInArrow(_by_document, "id long, tie long, marks binary")


def covered(starts: np.ndarray, window: int, words: int) -> np.ndarray:
    """Which of ``words`` words lie in a window that begins at one of ``starts``."""
    edges = np.zeros(words + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges)[:-1] > 0


def _writer(window: int, digest: bool) -> Callable:
    """n_words, removed (flat list of starts and ends, in words) and the kept words of each row."""

    def write(batches):
        for batch in batches:
            rows: list[tuple] = []
            for text, marks in zip(batch.column("text"), batch.column("marks")):
                words = [w for block in word_blocks(text.as_py() or b"") for w in block]
                spans: list[int] = []
                n = len(words)
                if marks.as_py():
                    gone = covered(np.frombuffer(marks.as_py(), np.uint32).astype(np.int64), window, n)
                    spans = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
                    words = [w for w, out in zip(words, gone.tolist()) if not out]
                kept = b" ".join(words)
                rows.append((n, n - len(words), spans, hashlib.sha256(kept).hexdigest().encode() if digest else kept))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tie")] + [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)],
                ["id", "tie", "n_words", "n_removed", "removed", "kept"])

    return write


_WRITTEN = "id long, tie long, n_words long, n_removed long, removed array<int>, kept binary"


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                     flush_words: int = 1 << 20) -> DataFrame:
    """id, tie, text, marks of the documents that have windows which occur earlier: ``marks`` are their starts."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("id"),
                       F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("binary").alias("text"))
    live = _positions(rows.where(F.col("text").isNotNull()), window, flush_words, False).dropDuplicates(["id", "tie"])
    around = materialise(rows.join(live, ["id", "tie"]).dropDuplicates(["id", "tie"]), "repeats-around")
    # In the order of the identifiers, flushes and offsets tell which of two windows is earlier.
    ordered = around.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    found = materialise(_positions(ordered, window, flush_words, True), "repeats-windows")
    return around.drop("marks").join(found, ["id", "tie"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   digest: bool = False, flush_words: int = 1 << 20) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, n_words, n_removed, removed, and kept_text or kept_sha256.

    Words are what ASCII white space separates.  Each word in a window of ``window`` words that also starts earlier
    (smaller identifier, or same document and earlier start) is removed; ``removed`` lists starts and ends of the
    removed stretches.  Null texts count as empty, shorter texts have no windows.  Null identifiers come first;
    documents that share an identifier are ordered by a hash of the text; full repeats of a row are one document,
    and all get its result.  Other columns are not read; an empty table gives none.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("id"),
                       F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("binary").alias("text"))
    changed = (repeated_windows(docs, id_col, text_col, window, flush_words)
               .mapInArrow(_writer(window, digest), _WRITTEN).dropDuplicates(["id", "tie"])
               .select("id", "tie", F.col("n_removed").alias("r"), F.col("removed").alias("s"), F.col("kept").alias("k")))
    whole = rows.withColumn("marks", F.lit(None).cast("binary")).mapInArrow(_writer(window, digest), _WRITTEN)
    name = "kept_sha256" if digest else "kept_text"
    return (whole.join(changed, ["id", "tie"], "left")
            .select(F.when(F.col("id") != F.lit(-1 << 63), F.col("id")).alias(id_col), "n_words",
                    F.coalesce("r", "n_removed").alias("n_removed"), F.coalesce("s", "removed").alias("removed"),
                    F.coalesce("k", "kept").cast("string").alias(name)))
