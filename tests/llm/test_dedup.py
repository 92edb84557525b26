"""Exact and near duplicates and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from cases import DOCS, LONG, docs, empty
from skirmish.llm import content_sort, graph, simhash, substrings, text

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("per_run", [1, 1000])
def test_exact_duplicates(spark, keep, per_run):
    want, groups = [], {}
    for doc_id, value, _ in DOCS:
        groups.setdefault((value or "").translate(UPPER), []).append(doc_id)
    for value, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        digest = hashlib.sha256(value.encode()).hexdigest()
        done = False
        for i in ids:
            want.append((i, best, len(ids), i == best and not done, digest))
            done |= i == best
    got = content_sort.exact_duplicates(docs(spark), keep=keep, copies_per_run=per_run)
    assert rows_of(got) == sorted(want, key=repr)
    kept = content_sort.keep_distinct(docs(spark), keep=keep, copies_per_run=per_run)
    assert kept.columns == docs(spark).columns
    assert rows_of(kept.select("doc_id")) == sorted(((i,) for i, _, _, k, _ in want if k), key=repr)


def test_exact_duplicates_of_nothing(spark):
    assert content_sort.exact_duplicates(empty(spark)).count() == 0
    assert content_sort.keep_distinct(empty(spark)).count() == 0


def slow_simhash(value, width=4):
    words = (value or "").translate(UPPER).encode().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_simhash_by_blocks(monkeypatch):
    values = ["", "a", "a b c", "A b c d", "a b c d e f g h i j"] + [v for _, v, _ in DOCS if v and len(v) < 1000]
    for size in (5, 1 << 20):
        monkeypatch.setattr(text.word_blocks, "__defaults__", (size,))
        for v in values:
            assert simhash.simhash(v.encode()) & (1 << 64) - 1 == slow_simhash(v)


def test_no_pair_escapes_the_masks():
    masks = simhash.covering_masks(4)
    rng = random.Random(1)
    for _ in range(3000):
        differing = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(m & differing == 0 for m in masks)


def slow_components(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if (a[1] ^ b[1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = {}
    for i, (ident, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(ident)
    names = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((rows[i][0], f"{rows[i][1]:016x}", names[root(i)]) for i in range(len(rows))), key=repr)


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = list(DOCS)
    for group in range(4):
        base = [rng.choice(words) for _ in range(300)]
        for copy in range(12):
            for _ in range(rng.randrange(4)):
                base[rng.randrange(300)] = rng.choice(words)
            rows.append((100 + 20 * group + copy, " ".join(base), "s"))
    want = slow_components([(i, slow_simhash(v)) for i, v, _ in rows])
    assert rows_of(simhash.near_duplicates(docs(spark, rows))) == want
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark).columns
    assert kept.count() == len({(c, f if c is None else 0) for _, f, c in want})
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_one(empty(spark)).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """Fingerprints around one centre: compared in full and through common neighbours, the components agree."""
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(250):
        fps.add(0x0123456789ABCDEF ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(9))))
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = {}
    for ident, _, root in slow_components(rows):
        want.setdefault(root, set()).add(rows[ident][1])
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    for compared in (4, 1024):
        got = {}
        for node, root in graph.components(simhash.links(df, compared=compared)).collect():
            got.setdefault(root, set()).add(node & (1 << 64) - 1)
        assert sorted(sorted(g) for g in got.values()) == want
    with pytest.raises(ValueError):
        simhash.links(df, radius=3)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (601, 600), (600, 601)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert rows_of(got) == sorted([(i, 0) for i in range(201)] + [(600, 600), (601, 600)], key=repr)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_repeats(rows, window):
    """n_words, n_removed and kept text by (id, text); identical rows are one document."""
    order = sorted({(-1 << 63 if i is None else i, xxhash.xxh64_intdigest((v or "").encode(), 42) - 0, v or "") for i, v in rows},
                   key=lambda r: (r[0], np.uint64(r[1]).astype(np.int64)))
    seen, out = set(), {}
    for ident, _, v in order:
        words = v.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        out[ident, v] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return sorted(((i, *out[-1 << 63 if i is None else i, v or ""]) for i, v in rows), key=repr)


@pytest.mark.parametrize("flush", [40, 1 << 20])
def test_repeated_passages(spark, flush):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (19, 20, 21, 35, 60)]
    rows = [(i, v) for i, v, _ in DOCS if v is not LONG and (v is None or len(v) < 1000)]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [f"x{rng.random()}" for _ in range(rng.randrange(30))]
            parts += rng.choice(passages)[rng.randrange(3):]
        rows.append((100 - i, rng.choice([" ", "\n\t"]).join(parts)))
    rows += [(7, "a b " * 40), (7, "a b " * 40), (-5, "a b " * 30), (None, "c d " * 30), (None, "c d " * 30)]
    got = substrings.remove_repeats(docs(spark, [(i, v, None) for i, v in rows]), flush_words=flush)
    assert rows_of(got.select("doc_id", "n_words", "n_removed", "kept_text")) == slow_repeats(rows, 20)
    for r in got.collect():
        assert sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_long_text_repeats(spark):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, [(1, LONG, "a"), (2, "new " + LONG, "a")])).collect()}
    assert got[1].n_removed == 0 and got[1].n_words == 120_000
    assert got[2].n_removed == 120_000 and got[2].kept_text == "new"


@pytest.mark.parametrize("window", [1, 2, 4, 10, 20, 50])
def test_covers(window):
    period, cover = substrings.cover_for(window)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert window - period + 1 >= 1
