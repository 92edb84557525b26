"""Cleaning and parsing of names, log lines and team blocks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(s: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))


def clean_letters(s: Column) -> Column:
    """Letters only, lower case."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}]", ""))


def move_id(s: Column) -> Column:
    """Move name folded to one id per move with variants."""
    m = clean_letters(s)
    # fixed values: moves whose variants share one id
    return (F.when(m.startswith("hiddenpower"), "hiddenpower")
            .when(m == "vicegrip", "visegrip")
            .when(m.startswith("return"), "return")
            .when(m.startswith("frustration"), "frustration")
            .otherwise(m))


_HP = r"([0-9]+)/([0-9]+)(?:[gyr])?\b"


def hp_current(raw: Column) -> Column:
    return F.regexp_extract(raw, _HP, 1).try_cast("int")


def hp_maximum(raw: Column) -> Column:
    return F.regexp_extract(raw, _HP, 2).try_cast("int")


def hp_fraction(raw: Column) -> Column:
    return F.try_divide(hp_current(raw).cast("double"), hp_maximum(raw))


def source_of(args: Column, kind: str) -> Column:
    """Item, ability or move named in a ``[from]`` argument; null when there is none.
    The last matching argument counts."""
    hits = F.filter(args, lambda a: a.contains("[from]") & a.contains(kind))
    last = F.try_element_at(hits, F.lit(-1))
    return F.nullif(F.trim(F.regexp_replace(last, rf"\[from\]\s?{kind}:\s?", "")), F.lit(""))


def entity_of(args: Column) -> Column:
    """Entity named in an ``[of]`` argument."""
    last = F.try_element_at(F.filter(args, lambda a: a.contains("[of]")), F.lit(-1))
    return F.nullif(F.trim(F.regexp_replace(last, r"\[of\]\s?", "")), F.lit(""))


def condition_name(raw: Column) -> Column:
    """Side, field or weather condition in canonical form; null when it is not one."""
    c = F.regexp_replace(F.trim(F.lower(F.regexp_replace(raw, "move:", ""))), " ", "")
    return F.when(~(raw.contains("ability") | c.contains(":")), c)


def slot_side(slot: Column) -> Column:
    """``p1`` of ``p1a: Name``."""
    return F.substring(slot, 1, 2)


def slot_name(slot: Column) -> Column:
    """``Name`` of ``p1a: Name``."""
    return F.trim(F.regexp_extract(slot, r"^p[0-9][a-z]?: ?(.*)$", 1))


def details_species(details: Column) -> Column:
    """Species of a details field ``Species, L50, M``."""
    return F.trim(F.split(details, ",")[0])


def details_level(details: Column) -> Column:
    """Level of a details field; 100 when it is not written."""
    return F.coalesce(F.regexp_extract(details, r", L([0-9]+)", 1).try_cast("int"), F.lit(100))


def after_first(items: Column) -> Column:
    """All elements but the first."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def line_fields(line: Column) -> Column:
    """Fields of a log line ``|type|arg|arg``, trimmed, type first."""
    return F.transform(after_first(F.split(line, r"\|")), lambda f: F.trim(f))


def natural_number(s: Column) -> Column:
    """First run of digits as a number, for natural ordering of ids."""
    return F.regexp_extract(s, r"([0-9]+)", 1).try_cast("bigint")


def member_species(header: Column) -> Column:
    """Species of a team block's first line ``Nick (Species) (M) @ Item``: the first parenthesis that is no
    gender mark, else the line without parentheses."""
    name = F.trim(F.split(header, "@")[0])
    inner = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda c: F.trim(c)),
                     lambda c: ~F.upper(c).isin("M", "F"))
    return F.coalesce(F.try_element_at(inner, F.lit(1)), F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", "")))


def member_item(header: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(header, "@(.*)$", 1)), F.lit(""))


def member_moves(lines: Column) -> Column:
    """Moves of a team block: lines that start with a dash; of several options the first."""
    marked = F.filter(lines, lambda x: F.trim(x).startswith("-"))
    first = lambda x: F.trim(F.split(F.regexp_replace(F.trim(x), r"^-\s*", ""), "/")[0])
    return F.filter(F.transform(marked, first), lambda m: m != "")


def labelled(lines: Column, label: str) -> Column:
    """Value of a ``Label: value`` line."""
    hit = F.try_element_at(F.filter(lines, lambda x: F.trim(x).startswith(label + ":")), F.lit(1))
    return F.nullif(F.trim(F.regexp_replace(hit, rf"^\s*{label}:", "")), F.lit(""))
