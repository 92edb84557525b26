"""Token ids against Tokenizer.encode as it comes."""

import struct

import corpus_pipeline
import public_tokenizers
import pytest
from cases import docs
from skirmish.llm import packing
from skirmish.llm.queries import QUERIES
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "é  <|endoftext|>  don't<|endoftext|><|endoftext|>\n\n x", "<|endoftext", "plain text"]


def test_encoder_with_added_tokens():
    encoder, tokenizer = packing.Encoder(PATH, special=True), Tokenizer.from_file(PATH)
    for text in [*TEXTS, "word <|endoftext|> " * 90_000]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("name", ["op9_packing", "packing"])
def test_queries_keep_added_tokens(spark, tmp_path, name):
    tokenizer = Tokenizer.from_file(PATH)
    table = docs(spark, [(i, t, "a") for i, t in enumerate(TEXTS)]).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[name](spark, str(tmp_path)) if name in QUERIES else dict(corpus_pipeline.STAGES)[name](spark, table, str(tmp_path))
    got = {r.doc_id: r.doc_tokens for r in out.collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
