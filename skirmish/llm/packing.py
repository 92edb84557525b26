"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n, with as many pieces of the largest
length as fit.  Every piece is a sequence of its own; sequences of equal length share a bucket (the high bits of the
sequence number), from which a trainer draws batches.  No sequence crosses documents and none is padded.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import held_by_worker

#: Words of the byte-level vocabulary's pre-tokenizer, a fixed value of that vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(WORDS)
#: The character by which a byte-level vocabulary spells each byte: itself if it is printable, else one above 255.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
#: Bits of a sequence number: log2 of the length, partition, number in the partition.
PARTITION_BITS, NUMBER_BITS = 22, 30


def decompose(tokens: int, most: int) -> list[int]:
    """Lengths of the pieces, largest first."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


#: Characters of the longest word that is kept.
LONG = 256


class Encoder(dict):
    """Token ids, packed as little-endian 32-bit numbers, of a byte-level vocabulary file.

    Where ids follow the order of the merges, ids are ranks, and ``tiktoken`` encodes with them.  It gives up on runs of
    white space too long for its pattern; such texts, and other vocabularies, are encoded word by word: byte-level BPE
    never merges across the words of its pre-tokenizer, so each distinct word goes to the model once.  Of two generations of
    ``words`` entries the older goes when the younger is full.  Words of over ``LONG`` characters are not kept.
    With ``special`` the strings of the file's added tokens are those tokens, else they are ordinary text."""

    def __init__(self, path: str, words: int = 50_000, special: bool = False) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.words, self.older, self.added, self.cut, self.tokenize = path, words, {}, {}, None, None
        for token in spec["added_tokens"] if special else []:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError(f"added token {token['content']!r} takes more than its own string")
            self.added[token["content"]] = token["id"]
        if self.added:
            self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.spelling = [BYTE_CHARACTERS.get(b, chr(b)) for b in range(256)]
        self.fast = self._ranks(spec["model"], {t["content"] for t in spec["added_tokens"]})

    def _ranks(self, model: dict, added: set[str]):
        import tiktoken

        ids, bytes_of = model["vocab"], {c: b for b, c in enumerate(self.spelling)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if any(ids[a + b] != 256 + n for n, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(map(bytes_of.__getitem__, token)): number for token, number in ids.items() if token not in added}
        return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.added)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            spelt = "".join(map(self.spelling.__getitem__, word.encode()))
            ids = array("I", [t.id for t in self.tokenize(spelt)]).tobytes()
        if len(word) <= LONG:
            if len(self) >= self.words:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(self.added), disallowed_special=()).astype("<u4").tobytes()
            except ValueError:
                pass  # a run too long for the pattern
        return self.encode_by_word(text)

    def encode_by_word(self, text: str) -> bytes:
        if self.tokenize is None:
            from tokenizers import Tokenizer

            self.tokenize = Tokenizer.from_file(self.path).model.tokenize
        if self.cut and self.cut.search(text):
            return b"".join(self.added[x].to_bytes(4, "little") if i % 2 else self._words(x) for i, x in enumerate(self.cut.split(text)))
        return self._words(text)

    def _words(self, text: str) -> bytes:
        words = (m.group() for m in _WORDS.finditer(text))  # a list of them would take many times the text's size
        return b"".join(b"".join(map(self.__getitem__, some)) for some in batched(words, 1 << 16))


_PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2048,
         end: int = 1, special: bool = False) -> DataFrame:
    """A row per piece: ``id_col``, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    Token ids are those of the byte-level vocabulary in the file ``tokenizer`` with none added around the text, then
    ``end``; with ``special`` a string of an added token in the text is that token, as in ``Tokenizer.encode``.
    ``most`` is a power of two.  A null or empty text is its end token alone; a repeated row is packed again, a null
    identifier stays null; other columns are not read; an empty table gives none.  One pass, no shuffle:
    sequence numbers are unique because the number of the partition is part of them.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")

    buckets = most.bit_length()

    def run(batches):
        encoder, part = held_by_worker(("packing", tokenizer, special), lambda: Encoder(tokenizer, special=special)), TaskContext.get().partitionId()
        counts = np.zeros(buckets, np.int64)
        if part >> PARTITION_BITS:
            raise OverflowError("too many partitions for the sequence numbers")
        for batch in batches:
            for first in range(0, len(batch), 256):
                some = batch.slice(first, 256)
                ids = [encoder.encode((text.as_py() or b"").decode("utf-8", "replace")) + end.to_bytes(4, "little") for text in some.column(1)]
                tokens = np.array([len(x) // 4 for x in ids])
                lengths = [decompose(n, most) for n in tokens.tolist()]
                owner = np.repeat(np.arange(len(ids)), [len(x) for x in lengths])
                length = np.array([x for each in lengths for x in each])
                place = np.concatenate([[0], np.cumsum(length)])  # among the tokens of the slice
                start = place[:-1] - (np.cumsum(tokens) - tokens)[owner]
                bucket = np.log2(length).astype(np.int64)
                number = np.zeros(len(length), np.int64)
                for k in np.unique(bucket).tolist():
                    mine = np.flatnonzero(bucket == k)
                    number[mine] = (k << PARTITION_BITS | part) << NUMBER_BITS | (counts[k] + np.arange(len(mine)))
                    counts[k] += len(mine)
                if counts.max() >> NUMBER_BITS:
                    raise OverflowError("too many sequences in a partition")
                pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [
                    None, pa.py_buffer(4 * place), pa.py_buffer(b"".join(ids))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pieces, pa.array(tokens[owner]),
                     pa.array(number), pa.array(np.zeros(len(length), np.int64))],
                    ["id", *[x.split()[0] for x in _PIECES.split(", ")]])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    packed = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_PIECES}")
    return packed.withColumnRenamed("id", id_col)
