"""Collocations against plain Python counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import DOCS, docs, empty
from skirmish.llm import collocations
from skirmish.llm.queries import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least, most, top):
    """rows of (lang, text)"""
    counts, totals, out = {}, Counter(), []
    for lang, value in rows:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (value or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            held.update(tuple(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    for lang, held in counts.items():
        usual = {p: a for p, a in held.items() if a >= least and len(p) > 1}
        gone = {p[i:i + k] for p, a in usual.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= held[p[i:i + k]]}
        found = []
        for p, a in usual.items():
            if p not in gone:
                score, k = min((1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, n string")


def got(df):
    return sorted(map(tuple, df.collect()))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "the", "city", "of", "\u00e9t\u00e9", "a", "b", "s\u00e3o", "paulo", "big", "apple"]
    for _ in range(n):
        body = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ", ", ".", "\n", "\x0b", "! ", "\x1c"]) for _ in range(rng.randrange(80)))
        yield rng.choice([None, "en", "en", "fr", "und"]), rng.choice(["", "New York City "]) + body


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(("block", "table"), [(1 << 21, 1 << 20), (300, 64)])
def test_against_counts(spark, monkeypatch, seed, block, table):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "TABLE", table)
    rows = list(texts(seed, 250)) + [("en", None), ("xx", ""), (None, None)]
    for least, most, top in ((3, 5, 2000), (40, 3, 7), (1, 2, 50)):
        assert got(collocations.collocations(frame(spark, rows), least, most, top)) == slow(rows, least, most, top)


def test_a_bitmap_that_is_full_changes_nothing(spark):
    rows = list(texts(5, 150))
    assert got(collocations.collocations(frame(spark, rows), 4, bits=6)) == slow(rows, 4, 5, 2000)


def test_collisions_are_settled_by_text(spark, monkeypatch):
    """Fingerprints of two bits: nearly everything collides."""
    monkeypatch.setattr(collocations, "fingerprint", lambda x: x & np.uint64(3))
    rows = list(texts(6, 60))
    assert got(collocations.collocations(frame(spark, rows), 4)) == slow(rows, 4, 5, 2000)


def test_giant_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 500)
    rows = [("en", "one two three. " * 3000), ("en", "x" * 5000 + " one two " + "y" * 3000 + " one two"), (None, " " * 4000 + "one two" + "." * 4000)]
    assert got(collocations.collocations(frame(spark, rows), 100)) == slow(rows, 100, 5, 2000)


def test_odd_tables(spark):
    found = got(collocations.collocations(docs(spark), 1, 3))
    assert found == slow([("x", v) for _, v, _ in DOCS], 1, 3, 2000)
    assert got(collocations.collocations(empty(spark))) == []


def test_op11_against_counts(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = got(QUERIES["op11_collocations"](spark, "/root/testdata/sf0.01"))
    assert found == slow(rows, 100, 5, 2000) and found
