"""Secrets in text: fixed patterns, and strings that look random.

A candidate string is scored by two character Markov models, one of random strings and one of ordinary identifiers:
the logarithm of the ratio of its likelihoods, per transition.  Both models are bigram counts over all documents; the
labels come from the fixed patterns (their values are random strings) and from the words of the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: The fixed patterns.  ``+`` with a later length test equals a minimum in the pattern for access and hex, whose
#: matches are whole runs; an assign match may swallow a shorter one, so its length is tested afterwards.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Characters of candidates: class of a character for the models (other characters end a candidate).
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A word that stands alone: possessive, so a longer run is never cut to fit.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_]{5,}+(?![A-Za-z0-9+/_=-])"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

_SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Running sums of an array, block by block: an array built element by element is copied each time, so
    blocks keep the work near linear for texts with very many matches."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")),
                           lambda acc, x: F.struct((acc["at"] + x).alias("at"),
                                                   F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")),
                           lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
    ends = within(sums, zero)
    return F.flatten(F.zip_with(F.arrays_zip(blocks.alias("block"), sums.alias("sum")), ends,
                                lambda b, end: within(b["block"], end - b["sum"])))


def spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Start, stop (code points, exclusive) and value of each match: gaps and matches laid end to end give the
    places.  Texts without a match are not taken apart."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    lengths = F.zip_with(gaps, hits, lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long"))
    laid = F.transform(
        F.arrays_zip(hits.alias("hit"), values.alias("value"), _running(lengths).alias("stop")),
        lambda x: F.struct((x["stop"] - F.char_length(x["hit"])).alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), laid).otherwise(F.array().cast(_SPAN))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the spans of each fixed pattern and of the candidates, from whole texts; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_enough = F.filter(spans(text, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= 8)
    return docs.select(F.col(id_col).alias("id"), long_enough.alias("assign"), spans(text, ACCESS).alias("access"),
                       spans(text, HEX).alias("hex"), spans(text, CANDIDATE).alias("candidate"))


def _transitions(strings: DataFrame) -> DataFrame:
    """How often each pair of neighbouring characters occurs in ``value``, ``n`` times each."""
    distinct = strings.groupBy("value").agg(F.sum("n").alias("n"))
    place = F.explode(F.sequence(F.lit(1), F.char_length("value") - 1)).alias("i")
    pair = distinct.where(F.char_length("value") > 1).select("value", "n", place).select(
        F.substring("value", F.col("i"), F.lit(2)).alias("pair"), "n")
    return pair.groupBy("pair").agg(F.sum("n").alias("n"))


def log_ratios(docs: DataFrame, found: DataFrame, text_col: str = "text", uniform_random: float = 0.5,
               uniform_identifier: float = 0.05, backing: float = 5.0) -> list[float]:
    """log(P(b | a, random) / P(b | a, identifier)) for each pair of characters of the alphabet, row by row.

    Both models count every labelled string of the corpus: values of the fixed patterns, and the words that stand
    alone.  Behind a pair stand ``backing`` occurrences of the second character by its own frequency, which is blended
    with the uniform distribution, for the random model by half: random strings over other characters than the labelled
    ones count as random too.  The table is of the alphabet's size squared, whatever the corpus.
    """
    random = found.select(F.explode(F.concat("assign.value", "access.value", "hex.value")).alias("value"), F.lit(1).alias("n"))
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(IDENTIFIER), F.lit(0))).alias("value"),
                        F.lit(1).alias("n"))
    counts = _transitions(random).select(F.lit(0).alias("model"), "pair", "n").unionByName(
        _transitions(words).select(F.lit(1).alias("model"), "pair", "n")).collect()
    size, place = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    tables = [[[0] * size for _ in range(size)] for _ in range(2)]
    for model, pair, n in counts:
        if pair[0] in place and pair[1] in place:
            tables[model][place[pair[0]]][place[pair[1]]] += n
    models = []
    for table, uniform in zip(tables, (uniform_random, uniform_identifier)):
        total = sum(map(sum, table))
        single = [uniform / size + (1 - uniform) * (sum(row[b] for row in table) / total if total else 1 / size) for b in range(size)]
        models.append([(n + backing * p) / (sum(row) + backing) for row in table for n, p in zip(row, single)])
    return [math.log(p / q) for p, q in zip(*models)]


def log_likelihood_ratio(value: Column, ratios: list[float]) -> Column:
    """Sum over the transitions of ``value``."""
    table, alphabet = F.lit(ratios), F.lit(ALPHABET)
    places = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.position(c, alphabet))
    return F.aggregate(
        places, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, p: F.struct(
            (acc["sum"] + F.when(acc["last"] > 0, F.element_at(table, (acc["last"] - 1) * len(ALPHABET) + p)).otherwise(0.0)).alias("sum"),
            p.alias("last")),
        lambda acc: acc["sum"])


def _labelled(kind: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("place"),
                                                 F.lit(KINDS[kind]).alias("kind"), x["stop"].alias("stop")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, base and all, arrays of (start, place, kind, stop) in order.

    ``base`` has the matches of the fixed patterns; ``all`` also the candidates that overlap none of them, hold a
    letter and have a log-likelihood ratio of ``threshold`` or more per transition.  Null texts count as empty, null identifiers and
    repeated rows stay as they are, other columns are not read; an empty table gives none.
    """
    found = materialise(scanned(docs, id_col, text_col), "secrets-scanned")
    ratios = log_ratios(docs, found, text_col)
    base = F.array_sort(F.concat(*[_labelled(i, F.col(k)) for i, k in enumerate(KINDS[:3])]))
    rows = found.select(F.col("id"), base.alias("base"), "candidate")
    likely = F.filter("candidate", lambda c: c["value"].rlike("[A-Za-z]")
                      & ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
                      & (log_likelihood_ratio(c["value"], ratios) >= threshold * (F.char_length(c["value"]) - 1)))
    return rows.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", _labelled(3, likely))).alias("all"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
