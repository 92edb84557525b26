"""Phrase collocations by Rabin-Karp fingerprints.

Texts are hashed in blocks of about a megabyte with numpy: prefix polynomials over the bytes give the fingerprint of each
word, prefix polynomials over the words' fingerprints that of every n-gram.  Passes over the texts count fingerprints,
longer phrases only where all their shorter ones are frequent: words, then pairs of frequent words, then three to five
words of frequent pairs.  What is frequent reaches the next pass as a bitmap of fixed size; a bit set by chance costs a
row, never a result.

With each count the shuffle aggregates a pointer to an occurrence: 24 bits of a second, independent fingerprint, and 16
bits of a hash of text and place.  The least and the largest pointer of a fingerprint differ in the second fingerprint
where texts collided.  A last pass reads the text at the least pointers of frequent phrases, and no other; where texts
collided, the occurrences are counted by their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Bytes of a block; entries of a task's table of counts before it is sent on.
BLOCK, TABLE = 1 << 20, 1 << 21
#: log2 of the bits of a bitmap: 16 MB.
BITS = 27
#: Odd bases of the polynomials, with their inverses modulo 2^64: bytes and words, then the same of the second fingerprint.
_BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (
    0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407))
_OTHER, _BLANK, _BREAK = range(3)


def _tables() -> tuple[bytes, np.ndarray]:
    """Lower-casing of A-Z, and the kind of each byte: blank between words, break between pieces, other."""
    lower, kinds = bytearray(range(256)), np.full(256, _OTHER, np.uint8)
    for c in range(65, 91):
        lower[c] += 32
    kinds[[0x20, 0x09]] = _BLANK
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
    return bytes(lower), kinds


LOWER, KINDS = _tables()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``size``, at least, of a base and of its inverse; the longest made so far are kept."""
    if which not in _POWERS or len(_POWERS[which][0]) <= size:
        made = []
        for base in _BASES[which]:
            steps = np.full(size + size // 8 + 1, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[which] = tuple(made)
    return _POWERS[which]


def polynomials(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """The polynomial of ``values[start:end]`` for each pair, independent of where it stands."""
    up, down = _powers(which, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:len(values)], out=sums[1:])
    return (sums[end] - sums[start]) * down[start]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(x: np.ndarray) -> np.ndarray:
    return scrambled(x)


class Block:
    """Words of some bytes of lower-cased text: where they stand, their piece, fingerprints.  N-grams that end within
    the first ``lead`` words were counted in the block before.  ``texts`` has, by text in the block, its first byte here,
    its hash, and the place of that byte in the text."""

    def __init__(self, data: bytes, seed: int, texts: list[tuple[int, int, int]], lead: int = 0) -> None:
        self.data, self.seed, self.lead = np.frombuffer(data, np.uint8), np.uint64(seed), lead
        kinds = KINDS[self.data]
        inside = np.concatenate([[False], kinds == _OTHER, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(kinds == _BREAK, dtype=np.int32)[self.start] if len(self.start) else self.start
        values = self.data + np.uint64(1)
        self.words, self.seconds = (scrambled(polynomials(values, self.start, self.end, which)) for which in (0, 2))
        first, key, place = (np.array(x) for x in zip(*texts))
        owner = np.searchsorted(first, self.start, side="right") - 1
        where = (self.start - first[owner] + place[owner]).astype(np.uint64)
        #: 16 bits that tell an occurrence from most others, by its first word.
        self.places = scrambled(key.astype(np.int64).view(np.uint64)[owner] + where * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> np.ndarray:
        """First words of the n-grams within pieces that are this block's to count."""
        first = np.arange(max(0, self.lead - n + 1), max(0, len(self) - n + 1))
        return first[self.piece[first] == self.piece[first + n - 1]]

    def prints(self, first: np.ndarray, n: int) -> np.ndarray:
        found = self.words[first] if n == 1 else polynomials(self.words, first, first + n, 1)
        return fingerprint(found + self.seed + np.uint64(n))

    def pointers(self, first: np.ndarray, n: int) -> np.ndarray:
        """24 bits of the second fingerprint, and the place."""
        found = self.seconds[first] if n == 1 else polynomials(self.seconds, first, first + n, 3)
        check = scrambled(found + self.seed) >> np.uint64(40)
        return (check << np.uint64(16) | self.places[first]).astype(np.int64)

    def text(self, word: int, n: int) -> str:
        return b" ".join(self.data[self.start[i]:self.end[i]].tobytes() for i in range(word, word + n)).decode("utf-8", "replace")


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, Block]]:
    """The texts of a batch of (lang, text, key) by lang, joined by breaks in blocks of about ``BLOCK`` bytes.  A longer text
    is cut between words; the next block begins with the last four words of the block before."""
    langs = batch.column(0)
    for lang in langs.unique():
        seed = int.from_bytes(blake2b(lang.as_py().encode(), digest_size=8).digest(), "little")
        some, parts, texts, size = batch.filter(pc.equal(langs, lang)), [], [], 0
        for value, key in zip(some.column(1), some.column(2).to_pylist()):
            data = value.as_py().translate(LOWER)
            if size + len(data) > BLOCK and parts:
                yield lang.as_py(), Block(b"\n".join(parts), seed, texts)
                parts, texts, size = [], [], 0
            if len(data) > BLOCK:
                for at, stop, lead in _cuts(data):
                    yield lang.as_py(), Block(data[at:stop], seed, [(0, key, at)], lead)
            else:
                parts.append(data)
                texts.append((size, key, 0))
                size += len(data) + 1
        if parts:
            yield lang.as_py(), Block(b"\n".join(parts), seed, texts)


def _cuts(data: bytes, most: int = 4) -> Iterator[tuple[int, int, int]]:
    """(start, end, lead) of the blocks of a long text."""
    other = KINDS[np.frombuffer(data, np.uint8)] == _OTHER
    separators = np.flatnonzero(~other)
    words = np.flatnonzero(other & ~np.concatenate([[False], other[:-1]]))
    at, lead, stop = 0, 0, 0
    while True:
        place = int(np.searchsorted(separators, max(at, stop) + BLOCK))
        stop = int(separators[place]) if place < len(separators) else len(data)
        yield at, stop, lead
        if stop == len(data):
            return
        inside = words[np.searchsorted(words, at):np.searchsorted(words, stop)]
        lead = min(most, len(inside))
        at = int(inside[-lead]) if lead else stop


class Bitmap:
    """A set of fingerprints as bits; may hold others by chance."""

    def __init__(self, bits: int, places: np.ndarray, values: np.ndarray) -> None:
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[places] = values.view(np.uint64)
        self.mask, self.bytes = np.uint64((1 << bits) - 1), words.view(np.uint8)

    def has(self, prints: np.ndarray) -> np.ndarray:
        place = prints & self.mask
        return (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(prints: DataFrame, bits: int = BITS) -> Bitmap:
    """At most 2^(bits - 6) rows of two numbers reach the driver."""
    place = F.col("fp").bitwiseAND((1 << bits) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    found = prints.groupBy(F.shiftright(place, 6).alias("place")).agg(F.bit_or(one).alias("value")).toArrow()
    return Bitmap(bits, found["place"].to_numpy(), found["value"].to_numpy())


class _Counts:
    """A task's counts and least pointers by fingerprint, in tables of bounded size."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, block: Block, first: np.ndarray, n: int) -> None:
        if len(first):
            self._add(block.prints(first, n), np.ones(len(first), np.int64), block.pointers(first, n))

    def _add(self, prints: np.ndarray, count: np.ndarray, pointer: np.ndarray) -> None:
        order = np.argsort(prints)
        prints, pointer = prints[order], pointer[order]
        at = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        prints, count = prints[at], np.add.reduceat(count[order], at)
        least, most = np.minimum.reduceat(pointer, at), np.maximum.reduceat(pointer, at)
        # Texts that collide: the largest pointer gets a row of its own, so that the collision shows.
        apart = np.flatnonzero(least >> 16 != most >> 16)
        count[apart] -= 1
        self.parts.append((np.concatenate([prints, prints[apart]]), np.concatenate([count, np.ones(len(apart), np.int64)]),
                           np.concatenate([least, most[apart]])))
        self.size += len(at)

    def rows(self, least: int) -> Iterator[pa.RecordBatch]:
        """The counts as rows, if there are over ``least``."""
        if self.size <= least:
            return
        parts, self.parts, self.size = self.parts, [], 0
        self._add(*(np.concatenate(x) for x in zip(*parts)))
        if self.size > least // 2:
            prints, *columns = self.parts[0]
            for first in range(0, len(prints), 1 << 16):
                some = slice(first, first + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(prints[some].view(np.int64)), *[pa.array(c[some]) for c in columns]],
                                                 ["fp", "count", "pointer"])
            self.parts, self.size = [], 0


def _frequent(texts: DataFrame, grams: Callable[[Block], Iterator[tuple[np.ndarray, int]]], least: int, label: str) -> DataFrame:
    """fp, count, pointer (least), most (largest) of the n-grams that ``grams`` gives (by first word) ``least`` times or more."""

    def run(batches):
        counts = _Counts()
        for batch in batches:
            for _, block in blocks(batch):
                for first, n in grams(block):
                    counts.add(block, first, n)
                yield from counts.rows(TABLE)
        yield from counts.rows(0)

    # Tasks send counted rows; to aggregate them once more before the shuffle would only widen them.
    found = texts.mapInArrow(run, "fp long, count long, pointer long").repartition("fp").groupBy("fp").agg(
        F.sum("count").alias("count"), F.min("pointer").alias("pointer"), F.max("pointer").alias("most"))
    return materialise(found.where(F.col("count") >= least), label)


def _at(prints: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """One number for a fingerprint and a pointer."""
    return scrambled(prints ^ (pointers * np.uint64(0xC2B2AE3D27D4EB4F)))


_TEXT_ROW = "lang string, words int, phrase string, fp long, pointer long, count long"


def _text_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for first in range(0, len(rows), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[first:first + (1 << 14)]), kinds)],
                                         [x.split()[0] for x in _TEXT_ROW.split(", ")])


def phrase_counts(docs: DataFrame, least: int = 100, most: int = 5, lang_col: str = "lang", text_col: str = "text",
                  bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, count) of all phrases of up to ``most`` words with ``least`` occurrences or more, and
    (lang, n) with the number of words of each language.  See :func:`collocations` for words and pieces."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        text.cast("binary").alias("text"), F.xxhash64(text).alias("key"))
    share = docs.sparkSession.sparkContext.broadcast  # bitmaps only
    found = [_frequent(texts, lambda block: iter([(block.grams(1), 1)]), least, "phrases-1")]
    words = share(bitmap(found[0], bits))

    def pairs(block: Block) -> np.ndarray:
        """First words of pairs of frequent words."""
        usual = words.value.has(block.prints(np.arange(len(block)), 1))
        first = block.grams(2)
        return first[usual[first] & usual[first + 1]]

    if most > 1:
        found.append(_frequent(texts, lambda block: iter([(pairs(block), 2)]), least, "phrases-2"))
        twos = share(bitmap(found[1], bits))

    def longer(block: Block) -> Iterator[tuple[np.ndarray, int]]:
        """The same of three words and more all of whose pairs are frequent."""
        usual, first = np.zeros(len(block) + most, bool), np.arange(max(0, len(block) - 1))
        first = first[block.piece[first] == block.piece[first + 1]]
        usual[first] = twos.value.has(block.prints(first, 2))
        for n in range(3, most + 1):
            first = block.grams(n)
            yield first[np.logical_and.reduce([usual[first + k] for k in range(n - 1)])], n

    if most > 2:
        found.append(_frequent(texts, longer, least, "phrases-3"))

    def grams(block: Block) -> Iterator[tuple[np.ndarray, int]]:
        yield block.grams(1), 1
        if most > 1:
            yield pairs(block), 2
        if most > 2:
            yield from longer(block)

    frequent = found[0]
    for more in found[1:]:
        frequent = frequent.unionByName(more)
    place = share(bitmap(frequent.select(_at_column().alias("fp")), bits))

    def pointed(batches):
        """The text at each pointer, and the number of words."""
        seen: set[int] = set()  # copies of a text have its pointers; started anew when large
        for batch in batches:
            for lang, block in blocks(batch):
                rows = [(lang, 0, "", 0, 0, len(block) - min(block.lead, len(block)))]
                for first, n in grams(block):
                    prints, pointers = block.prints(first, n), block.pointers(first, n)
                    places = _at(prints, pointers.view(np.uint64))
                    hit = np.flatnonzero(place.value.has(places))
                    for w, fp, pointer, at in zip(*(x[hit].tolist() for x in (first, prints.view(np.int64), pointers, places))):
                        if at not in seen:
                            seen.add(at)
                            rows.append((lang, n, block.text(w, n), fp, pointer, 0))
                if len(seen) > TABLE:
                    seen.clear()
                yield from _text_rows(rows)

    read = materialise(texts.mapInArrow(pointed, _TEXT_ROW).groupBy("lang", "words", "phrase", "fp", "pointer").agg(
        F.sum("count").alias("n")), "phrase-texts")
    totals = read.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    known = frequent.join(read.where("words > 0").drop("n"), ["fp", "pointer"])
    # One text, and one second fingerprint: all occurrences have that text.
    sure = materialise(known.groupBy("fp").agg(F.count("*").alias("texts"), F.first("lang").alias("lang"), F.first("phrase").alias("phrase"),
                                               F.first("words").alias("words"), F.first("count").alias("count"),
                                               F.first("pointer").alias("pointer"), F.first("most").alias("most"))
                       .where((F.col("texts") == 1) & (F.shiftright("pointer", 16) == F.shiftright("most", 16))), "phrases-sure")
    counts = sure.select("lang", "phrase", "words", "count")
    collided = frequent.join(sure, "fp", "left_anti").select("fp")
    if not collided.isEmpty():
        collided = materialise(collided, "phrases-collided")
        doubt = share(bitmap(collided, bits))

        def by_text(batches):
            for batch in batches:
                for lang, block in blocks(batch):
                    held: dict[tuple, int] = {}
                    for first, n in grams(block):
                        prints = block.prints(first, n)
                        hit = doubt.value.has(prints)
                        for w, fp in zip(first[hit].tolist(), prints[hit].view(np.int64).tolist()):
                            key = (n, block.text(w, n), fp)
                            held[key] = held.get(key, 0) + 1
                    yield from _text_rows([(lang, *key, 0, count) for key, count in held.items()])

        counted = texts.mapInArrow(by_text, _TEXT_ROW).groupBy("lang", "words", "phrase", "fp").agg(F.sum("count").alias("count"))
        counted = counted.where(F.col("count") >= least).join(collided, "fp", "left_semi")
        counts = counts.unionByName(counted.select("lang", "phrase", "words", "count"))
    return materialise(counts, "phrases"), totals


def _at_column() -> Column:
    """:func:`_at` of the columns fp and pointer."""

    @F.pandas_udf("long")
    def at(prints: pd.Series, pointers: pd.Series) -> pd.Series:
        return pd.Series(_at(prints.to_numpy().view(np.uint64), pointers.to_numpy().view(np.uint64)).view(np.int64))

    return at("fp", "pointer")


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000, lang_col: str = "lang",
                 text_col: str = "text", bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language (null: ``und``).

    Texts are lower-cased (A-Z only) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into words ``[^\\x20\\x09]+``;
    n is the number of words, a phrase's count its contiguous occurrences within pieces.  Candidates have 2 to ``most``
    words and a >= ``least``.  score = floor(1000 * a * n / (l * r)) at the cut with the lowest score (ties: the shortest
    first part), l and r being the counts of its two parts.  Candidates contained in a longer one with the same count go.
    Order: score and a descending, then the phrase by bytes.  A null text has no words; repeated rows count again; only
    the two columns are read; an empty table gives no rows.  Arithmetic is exact, in decimals.
    """
    counts, totals = phrase_counts(docs, least, most, lang_col, text_col, bits)
    part = F.split("phrase", " ")
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(part, F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice(part, F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r"))
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div "
                   "(cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    scored = (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
              .withColumn("score", score).groupBy("lang", "phrase", "a", "n")
              .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    inner = phrases.where("words > 2").select(
        "lang", "a", "words", part.alias("part"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")).select(
        "lang", "a", "part", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at")).groupBy(
        "lang", F.array_join(F.slice("part", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("within"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
                    F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")))
