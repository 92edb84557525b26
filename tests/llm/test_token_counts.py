"""Counts of the compiled transducers against the tokenizer itself."""

import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from cases import DOCS, docs, empty
from skirmish.llm import token_counts
from skirmish.llm.queries import QUERIES
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH)


def want(texts):
    return [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(counter):
    texts = ["", " ", "hello  World", "it's we're 'rx 'l 've!'s ''s 'veal don't '", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>",
             "E\u0301 \u0301 \u0130\u03a3 \u0391\u03a3 stra\u00dfe \u65e5\u672c\u8a9e 123 \u00bd \u1e9b\u0323", "\x1c\x1d a\x85b c\u200bd",
             "'r", "'l'l'll", "\U0001f642\u200d\U0001f642 e\u0301\u0323", "\uac00\u11a8 \u1100\u1161"]
    assert counter.count(texts).tolist() == want(texts)
    assert counter.count([]).tolist() == []


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz'' 019.!\u00e9\u00dfb\u00e1\u0301\u0300\u03a3<|>\U0001f642\t", "inthe", "aA'slv ", "\u65e5\u672c\u8a9e\u3002a"])
def test_random_texts(counter, alphabet):
    rng = random.Random(1)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(600)]
    assert counter.count(texts).tolist() == want(texts)


def test_long_words_and_blocks(counter, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdeghilnorst") for _ in range(60_000))
    texts = [long, "x" * 5000 + " tail", "ab" * 4000 + "'s", long[:3000] + "\u00e9" * 3000, "the cat's " * 5000, "1" * 3000, "!" * 3000]
    assert counter.count(texts).tolist() == want(texts)
    monkeypatch.setattr(token_counts, "BLOCK", 300)
    assert counter.count(texts).tolist() == want(texts)
    texts = ["".join(rng.choice("ab'slr .\u00e9\u0301") for _ in range(900)) for _ in range(30)]
    assert counter.count(texts).tolist() == want(texts)


def test_a_table_that_starts_anew():
    small = token_counts.Counter(PATH, slots=1 << 12, states=300)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(40)] + ["".join(rng.choice("etaoin") for _ in range(3000))]
    assert [small.count([t])[0] for t in texts] == want(texts)
    tiny = token_counts.Counter(PATH, slots=1 << 8, states=300)
    assert tiny.count(texts).tolist() == want(texts) and tiny.slots > 1 << 8  # a block may need more than the table has
    assert tiny.count(["short"]).tolist() == want(["short"]) and tiny.slots == 1 << 8


def test_splitter_against_the_pattern():
    """State maps composed over chunks give the matches of the pattern."""
    rng, kinds = random.Random(4), dict(zip("smrvle", (5, 5, 6, 7, 8, 9))) | {" ": 0, "1": 1, "!": 2, "'": 3, "a": 4}
    for n in (1, 127, 128, 129, 5000):
        value = "".join(rng.choice("smrvle 1!''a") for _ in range(n - 1)) + " "
        found = token_counts.word_starts(np.array([kinds[c] for c in value], np.uint8))
        assert found.tolist() == [m.start() for m in re.finditer(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", value)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter._check(json.load(open(public_tokenizers.path("byte_bpe_50k.json"))) | {
            "normalizer": {"normalizers": []}, "pre_tokenizer": {"pretokenizers": []}})


def test_odd_tables(spark):
    got = token_counts.count_tokens(docs(spark), PATH, limit=10)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    counts = want([v or "" for _, v, _ in DOCS])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(i, len((v or "").encode()), n, n > 10) for (i, v, _), n in zip(DOCS, counts)], key=repr)
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0


def test_op13_agrees_with_the_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.01").collect()}
    counts = want([r.text or "" for r in rows])
    assert got == {r.doc_id: (len((r.text or "").encode()), n, n > 2048) for r, n in zip(rows, counts)}
