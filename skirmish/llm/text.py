"""Text helpers shared by the operators: words, case folding, column safety."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Hashable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.  ``lower`` does just that on ASCII
    texts and is several times faster than ``translate``."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, in lists that cover about ``size`` bytes each, so that a text
    of any length is worked through in bounded memory."""
    if len(text) <= size:
        yield text.split()
        return
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, min(start + size, len(text)))
        end = cut.start() if cut else len(text)
        yield text[start:end].split()
        start = end


def held_by_worker(key: Hashable, make: Callable[[], object]) -> object:
    """The value that ``make`` gave in this Python worker, which serves many tasks.  For values of bounded size that are
    dear to make; functions that travel by value have no module to hold them in."""
    held = sys.__dict__.setdefault("_skirmish_held", {})
    if key not in held:
        held[key] = make()
    return held[key]
