"""Token counts by finite-state transducers compiled from a tokenizer file.

Two deterministic transducers count the tokens of word-end byte-pair encoding without building the tokens:

* The *splitter* reads characters and marks where a word (a match of the file's pattern) begins.  It has 7 states, so
  the effect of a chunk of text is a map of 7 states to 7.  All chunks of a block are run at once from every state, a
  parallel prefix scan composes their maps, and a second sweep runs each chunk from its one true state.
* The *counter* reads the bytes of a word.  Each transition carries how many tokens the encoding of the prefix gains
  (it can lose some).  A state holds what the future depends on: for each suffix of the prefix that some token
  continues, the place of that suffix among the tokens, the token the encoding has before it, and how many tokens
  the encoding had there.  The encoding of a prefix ends in the one token that is a suffix of it and follows validly on the
  encoding of the rest, so transitions follow from the merges alone.  They are compiled when first met and kept in a
  bounded hash table that starts anew when full.  All words of a block advance by one byte together; a word of
  over ``LONG`` bytes is cut into chunks that run at once from guessed states, and chunks whose guess was wrong run again.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import BYTE_CHARACTERS
from .text import held_by_worker

#: The pattern of words that the splitter is written for: a fixed value of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Character classes: white space, number, other, apostrophe, letter, and the letters of the contractions.
SPACE, NUMBER, OTHER, APOSTROPHE, LETTER, STMD, R, V, L, E = range(10)
#: Splitter states: no open word, letters, others, an apostrophe that began a word, and 'r, 'v, 'l.
NONE, LETTERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
#: Characters of a block; of a chunk of the splitter; bytes of a chunk of a long word, and the run-up of its guess.
BLOCK, CHUNK, LONG, RUN_UP = 1 << 20, 128, 1024, 64
_END, _ROOT = 256, 0


def _splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, whether a word begins at this character, whether one began at the character before, by
    7 * class + state."""
    go, begins, began = (np.zeros((10, 7), np.uint8) for _ in range(3))
    for c in range(10):
        letter = c >= LETTER
        fresh = LETTERS if letter else (NONE, NONE, OTHERS, QUOTE)[c]
        for s in range(7):
            if s in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (L if s == QUOTE_L else E):
                    continue  # the contraction is complete
                began[c, s], s = 1, LETTERS  # it was an apostrophe and a word
                row = c, (QUOTE_R, QUOTE_V, QUOTE_L)
            else:
                row = c, s
            if s == LETTERS and letter:
                go[row] = LETTERS
            elif s in (OTHERS, QUOTE) and c in (OTHER, APOSTROPHE):
                go[row] = OTHERS
            elif s == QUOTE and c == STMD:
                go[row] = NONE
            elif s == QUOTE and c in (R, V, L):
                go[row] = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c]
            else:
                go[row], begins[row] = fresh, c != SPACE
    for s, c in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        go[c, s] = begins[c, s] = 0
    return go.ravel(), begins.ravel(), began.ravel()


GO, BEGINS, BEGAN = _splitter()


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Positions at which words begin, given the classes of characters; the last one must be white space."""
    n = len(classes)
    width = -(-n // CHUNK)
    grid = np.zeros(width * CHUNK, np.intp)  # white space behind the end
    grid[:n] = classes
    grid = np.ascontiguousarray((grid * 7).reshape(width, CHUNK).T)
    maps = np.broadcast_to(np.arange(7, dtype=np.uint8), (width, 7))
    for row in grid:
        maps = GO[row[:, None] + maps]
    step = 1
    while step < width:  # parallel prefix scan: after it, row i is the map of all chunks up to i
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.concatenate([[NONE], maps[:-1, NONE]]).astype(np.intp)
    starts, late = np.zeros((CHUNK, width), bool), np.zeros((CHUNK, width), bool)
    for k, row in enumerate(grid):
        at = row + state
        starts[k], late[k], state = BEGINS[at], BEGAN[at], GO[at]
    marks = starts.T.ravel()
    marks[:-1] |= late.T.ravel()[1:]
    return np.flatnonzero(marks[:n])


class Counter:
    """The transducers of one tokenizer file.  ``slots`` and ``states`` bound the compiled transitions, about 100 MB."""

    def __init__(self, path: str, classes: np.ndarray | None = None, slots: int = 1 << 20,
                 states: int = 1 << 18) -> None:
        from tokenizers import Tokenizer

        self.least_slots, self.most_states = slots, states
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        self.normalise = tokenizer.normalizer.normalize_str
        strings = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.classes = character_classes(path) if classes is None else classes
        self._compile(spec["model"])
        self._reset()

    @staticmethod
    def _check(spec: dict) -> None:
        model, split = spec["model"], [x.get("pattern", {}).get("Regex") for x in spec["pre_tokenizer"]["pretokenizers"]]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
        if (split != [PATTERN, None] or steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not plain
                or model["end_of_word_suffix"] != "</w>" or model["dropout"] or model.get("byte_fallback")):
            raise ValueError("the file is no lower-case word-end byte-pair vocabulary")

    def _compile(self, model: dict) -> None:
        """Symbols are bytes, plus 256 for the last byte of a word."""
        codes = {c: b for b, c in BYTE_CHARACTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_CHARACTERS}

        def symbols(token: str) -> tuple[int, ...]:
            end = token.endswith("</w>")
            found = [codes[c] for c in (token[:-4] if end else token)]
            if end:
                found[-1] += _END
            return tuple(found)

        ids = model["vocab"]
        self.rank, self.made = {}, {}  # rank of a pair; parts and rank of a token
        for n, (a, b) in enumerate(model["merges"]):
            whole = a + b
            self.rank.setdefault((ids[a], ids[b]), n)
            self.made.setdefault(ids[whole], (ids[a], ids[b], n))
        self.children: list[dict[int, int]] = [{}]  # the tokens as a tree
        self.token_at: list[int] = [-1]
        for token, number in ids.items():
            if not all(c in codes for c in token.removesuffix("</w>")):
                continue
            spelt = symbols(token)
            if len(spelt) > 1 and number not in self.made:
                continue  # no merge makes it
            at = _ROOT
            for s in spelt:
                if s not in self.children[at]:
                    self.children[at][s] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                at = self.children[at][s]
            self.token_at[at] = number
        if any(s not in self.children[_ROOT] for s in range(2 * _END)):
            raise ValueError("the vocabulary lacks a single byte")
        self.whole, self.spines = cache(self._whole), ({}, {})

    def _spine(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The parts of ``token`` at its left (0) or right (1) edge, with the rank of the merge that ends each."""
        held = self.spines[side].get(token)
        if held is None:
            made, ends, parts = self.made.get(token), sys.maxsize, [(token, sys.maxsize)]
            while made:
                part, ends = made[side], made[2]
                parts.append((part, ends))
                made = self.made.get(part)
            held = self.spines[side][token] = tuple(parts)
        return held

    def _follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both together is just the two: no merge across the border comes before the
        merges that end its two parts.  Of equal merges the left one goes first."""
        ranks, ahead = self.rank.get, self._spine(right, 0)
        for a, a_ends in self._spine(left, 1):
            for b, b_ends in ahead:
                rank = ranks((a, b))
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return False
        return True

    def _whole(self, token: int) -> bool:
        """Whether the encoding of the token's string is the token."""
        if token not in self.made:
            return True
        a, b, rank = self.made[token]
        if not (self.whole(a) and self.whole(b)):
            return False
        for x, x_ends in self._spine(a, 1):
            for y, y_ends in self._spine(b, 0):
                found = self.rank.get((x, y))
                if found is not None and (x, y) != (a, b) and found < x_ends and found <= y_ends:
                    return False
        return self.rank[a, b] == rank

    def _reset(self) -> None:
        #: A state is a tuple of (place in the tree, token before, tokens there less tokens here), longest suffix first.
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._table(self.least_slots)
        self._number(((_ROOT, -1, 0),))

    def _table(self, slots: int) -> None:
        self.slots, self.used = slots, 0
        self.keys = np.full(slots, -1, np.int64)
        self.next = np.zeros(slots, np.int32)
        self.gain = np.zeros(slots, np.int8)

    def _grow(self) -> None:
        """Twice the table, for a block that needs more than there is room for; the next block starts anew."""
        held = self.keys >= 0
        rows = zip(self.keys[held].tolist(), self.next[held].tolist(), self.gain[held].tolist())
        self._table(2 * self.slots)
        for row in rows:
            self._put(*row)

    def _put(self, key: int, following: int, gain: int) -> None:
        mask = self.slots - 1
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20 & mask
        while self.keys[slot] >= 0:
            slot = slot + 1 & mask
        self.keys[slot], self.gain[slot], self.next[slot] = key, gain, following
        self.used += 1

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _transition(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The next state, and the tokens gained."""
        moved, last, gain = [], None, 0
        for node, before, count in state:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if last is None and token >= 0 and self.whole(token) and (before < 0 or self._follows(before, token)):
                last, gain = token, count + 1
            moved.append((child, before, count))
        if last is None:
            raise ValueError("no token ends here: the merges are not in the order they were made in")
        return (*((c, b, n - gain) for c, b, n in moved if self.children[c]), (_ROOT, last, 0)), gain

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where there is none."""
        mask = self.slots - 1
        slot = ((wanted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & mask
        held = self.keys[slot]
        open_ = np.flatnonzero((held != wanted) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            held[open_] = self.keys[slot[open_]]
            open_ = open_[(held[open_] != wanted[open_]) & (held[open_] >= 0)]
        slot[held != wanted] = -1
        return slot

    def _add(self, key: int) -> None:
        state, gain = self._transition(self.states[key >> 9], key & 511)
        if 4 * self.used >= 3 * self.slots:
            self._grow()
        self._put(key, 0 if key & 511 >= _END else self._number(state), gain)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = state.astype(np.int64) << 9 | symbol
        slot = self._find(wanted)
        if (slot < 0).any():
            for key in np.unique(wanted[slot < 0]).tolist():
                self._add(key)
            slot = self._find(wanted)
        return self.next[slot], self.gain[slot]

    def _make_room(self) -> None:
        if 2 * self.used > self.slots or len(self.states) > self.most_states:
            self._reset()

    def _run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, last: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray]:
        """The final state and the tokens gained of the pieces ``data[start:end]``, all at once; ``last`` tells that the
        piece ends its word."""
        order = np.argsort(start - end, kind="stable")  # longest first, so that those still running are a prefix
        start, end, state, last = start[order], end[order], state[order].copy(), last[order]
        length = end - start
        gained = np.zeros(len(start), np.int64)
        running = len(start)
        for k in range(int(length[0]) if len(length) else 0):
            while running and length[running - 1] <= k:
                running = int(np.searchsorted(-length, -k, side="left"))
            symbol = data[start[:running] + k].astype(np.int64)
            symbol[(length[:running] == k + 1) & last[:running]] += _END
            state[:running], gain = self._step(state[:running], symbol)
            gained[:running] += gain
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], gained[back]

    def _tokens(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The tokens of each word ``data[start:end]``."""
        out = np.zeros(len(start), np.int64)
        short = end - start <= LONG
        for some in np.array_split(np.flatnonzero(short), max(1, short.sum() >> 18)):
            self._make_room()
            out[some] = self._run(data, start[some], end[some], np.zeros(len(some), np.int32), np.ones(len(some), bool))[1]
        for w in np.flatnonzero(~short).tolist():
            out[w] = self._long_word(data, int(start[w]), int(end[w]))
        return out

    def _long_word(self, data: np.ndarray, start: int, end: int) -> int:
        total, state = 0, np.zeros(1, np.int32)
        for first in range(start, end, LONG << 10):
            last = min(first + (LONG << 10), end)
            if 2 * self.used > self.slots or len(self.states) > self.most_states:
                held = self.states[int(state[0])]
                self._reset()
                state = np.array([self._number(held)], np.int32)
            cuts = np.arange(first, last, LONG)
            ends = np.append(cuts[1:], last)
            # Guess: the state after a run-up from the root.  Then each chunk's map is known at its guess.
            guess, _ = self._run(data, np.maximum(cuts - RUN_UP, first), cuts, np.zeros(len(cuts), np.int32), np.zeros(len(cuts), bool))
            guess[0] = state[0]
            final, gained = self._run(data, cuts, ends, guess, ends == end)
            for i in range(len(cuts)):  # compose; a wrong guess is mended from the true state
                if guess[i] != state[0]:
                    one = slice(i, i + 1)
                    final[one], gained[one] = self._run(data, cuts[one], ends[one], state, ends[one] == end)
                state = final[i:i + 1]
            total += int(gained.sum())
        return total

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in pieces to normalise apart: cut before ASCII characters, which join with nothing before them."""
        start = 0
        while len(text) - start > BLOCK:
            found = _ASCII.search(text, start + BLOCK)
            if not found:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:]

    def _normal(self, text: str) -> str:
        return "".join(x.lower() if not _UNUSUAL.search(x) else self.normalise(x) for x in self._blocks(text))

    def count(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owners = [], []
        for i, text in enumerate(texts):
            if self.special and "<" in text:
                pieces = self.special.split(text)
                out[i] = len(pieces) - 1
            else:
                pieces = [text]
            for piece in pieces:
                parts.append(self._normal(piece))
                owners.append(i)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1)  # white space between the pieces keeps them apart
        joined = " ".join(parts) + " "
        at = 0
        while at < len(joined):
            size = BLOCK
            while True:
                codes = joined[at:at + size]
                whole = at + len(codes) == len(joined)
                starts, kinds = self._words(codes if whole else codes + " ")
                done = len(codes)
                if whole or kinds[done - 1] == SPACE or not len(starts):
                    break
                if len(starts) > 3:  # the last words may go on, and a contraction change the last two
                    done = int(starts[-3])
                    starts = starts[:-3]
                    break
                size *= 2
            counts = self._count_block(codes, starts, kinds, done)
            owner = np.searchsorted(ends, at + starts, side="right")
            np.add.at(out, np.array(owners, np.int64)[owner], counts)
            at += done
        return out

    def _words(self, codes: str) -> tuple[np.ndarray, np.ndarray]:
        points = (np.frombuffer(codes.encode("ascii"), np.uint8) if codes.isascii()
                  else np.frombuffer(codes.encode("utf-32-le", "surrogatepass"), np.uint32))
        kinds = self.classes[points]
        return word_starts(kinds), kinds

    def _count_block(self, codes: str, starts: np.ndarray, kinds: np.ndarray, done: int) -> np.ndarray:
        """The tokens of the words that begin at ``starts``; a word ends at the next start or white space."""
        stops = np.zeros(done + 1, bool)
        stops[:done] = kinds[:done] == SPACE
        stops[starts] = True
        stops[done] = True
        where = np.flatnonzero(stops)
        ends = where[np.searchsorted(where, starts, side="right")]
        if codes.isascii():
            data = np.frombuffer(codes.encode("ascii"), np.uint8)
        else:
            data = np.frombuffer(codes.encode("utf-8", "replace"), np.uint8)
            offsets = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            starts, ends = offsets[starts], offsets[ends]
        return self._tokens(data, starts, ends)


_ASCII = re.compile(r"[\x00-\x7f]")
#: Texts without these are in normal form, and their lower case does not depend on the version of Unicode.
_UNUSUAL = re.compile(r"[^\x00-\u024f\u2010-\u2027]")


def character_classes(path: str) -> np.ndarray:
    """The class of each code point, as the tokenizer's own splitter tells them apart.

    All code points in a row are split into runs of one class.  The class of a run shows in "a" + c + c for one
    of its characters c: a letter joins the "a", and of two numbers each is a word.  White space is in no run.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    classes = np.full(0x110000, SPACE, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        for at in range(first, last, 1 << 16):
            stop = min(at + (1 << 16), last)
            for _, (a, b) in split("".join(map(chr, range(at, stop)))):
                c = chr(at + a)
                words = [x for _, x in split(f"a{c}{c}")]
                classes[at + a:at + b] = NUMBER if len(words) == 3 else LETTER if len(words) == 1 else OTHER
    classes[ord("'")] = APOSTROPHE
    for c, kind in zip("stmdrvle", (STMD, STMD, STMD, STMD, R, V, L, E)):
        classes[ord(c)] = kind
    return classes


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens): a row per row of ``docs``.

    Counts are those of the library's ``encode`` for the file ``tokenizer`` without tokens added around the text; a
    string of an added token in the text is that token.  A null text counts as empty (no tokens), a repeated row is
    counted again, a null identifier stays null, other columns are not read, an empty table gives no rows.  One pass,
    no shuffle; a task holds about a million characters at a time, or the longest text.
    """
    classes = zlib.compress(character_classes(tokenizer).tobytes())  # a few KB
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        counter = held_by_worker(("token_counts", tokenizer), lambda: Counter(
            tokenizer, np.frombuffer(zlib.decompress(classes), np.uint8)))
        for batch in batches:
            texts, first, size = [], 0, 0

            def counted(stop: int) -> pa.RecordBatch:
                ids, bytes_ = batch.column(0).slice(first, stop - first), pa.array([n for n, _ in texts], pa.int64())
                tokens = counter.count([t for _, t in texts])
                return pa.RecordBatch.from_arrays([ids, bytes_, pa.array(tokens), pa.array(tokens > limit)],
                                                  ["id", "n_bytes", "n_tokens", "over_limit"])

            for i, value in enumerate(batch.column(1)):
                data = value.as_py()
                texts.append((len(data), data.decode("utf-8", "replace")))
                size += len(data)
                if size > BLOCK:
                    yield counted(i + 1)
                    texts, first, size = [], i + 1, 0
            if texts:
                yield counted(len(batch))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
