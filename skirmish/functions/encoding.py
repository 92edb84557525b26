"""Canonical tokens, scaled features and padded arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_letters, clean_name

PAD_NUMBER = -2.0
BLANK = "<blank>"


def held_token(raw: Column, kind: str) -> Column:
    """Token of an item or ability: unknown, none and named values stay apart.
    ``kind`` is ``item`` or ``ability``."""
    # fixed values: spellings of "unknown" and "none"
    return (F.when(raw.isNull() | (raw == f"unknown_{kind}"), f"unknown{kind}")
            .when(F.trim(raw).isin("", f"No {kind.capitalize()}", f"no{kind}"), f"no{kind}")
            .otherwise(clean_letters(raw)))


def status_token(raw: Column) -> Column:
    return F.coalesce(clean_letters(raw), F.lit("nostatus"))


def effect_token(raw: Column) -> Column:
    return F.when(raw.isNull() | (raw == ""), "noeffect").otherwise(clean_letters(raw))


def types_token(types: Column, slots: int = 2) -> Column:
    """Sorted type names, padded with ``notype`` to ``slots``."""
    padded = F.concat(types, F.array_repeat(F.lit(None).cast("string"), F.greatest(slots - F.size(types), F.lit(0))))
    return F.array_join(F.sort_array(F.transform(padded, lambda t: F.coalesce(clean_name(t), F.lit("notype")))), " ")


def scale_member(hp: Column, level: Column, stats: Sequence[Column], boosts: Sequence[Column]) -> Column:
    """Numbers of an active member: hp share, level/100, stats/255, boosts/6."""
    return F.array(hp.cast("double"), level / 100.0, *[s / 255.0 for s in stats], *[b / 6.0 for b in boosts])


def scale_move(power: Column, accuracy: Column, priority: Column) -> Column:
    return F.array(power / 200.0, accuracy.cast("double"), priority / 5.0)


def pad_numbers(numbers: Column, length: int) -> Column:
    return F.concat(numbers, F.array_repeat(F.lit(PAD_NUMBER), F.greatest(length - F.size(numbers), F.lit(0))))


def pad_words(words: Column, length: int) -> Column:
    return F.concat(words, F.array_repeat(F.lit(BLANK), F.greatest(length - F.size(words), F.lit(0))))


def resource_bucket(current: Column, maximum: Column) -> Column:
    """0 empty, 1 below a quarter, 2 below a half, 3 otherwise."""
    r = current / maximum
    return (r >= 0.5).cast("int") + (r >= 0.25).cast("int") + (r > 0).cast("int")


def hp_characters(hp: Column) -> Column:
    """Two-decimal fixed point, one character per word; ``unknown`` for null."""
    return F.when(hp.isNull(), "unknown").otherwise(F.array_join(F.split(F.format_string("%.2f", hp), ""), " "))


def observation_text(fmt: Column, forced: Column, player: Column, moves: Column, switches: Column,
                     opponent: Column, conditions: Column, player_prev: Column, foe_prev: Column,
                     n_moves: int = 4, n_switches: int = 5, move_width: int = 3, switch_width: int = 8) -> Column:
    """Observation line in fixed block order.

    ``player`` and ``opponent`` are word arrays; ``moves`` and ``switches`` are
    arrays of word arrays already in canonical order, padded here with blanks.
    """
    def block(tag: str, groups: Column, count: int, width: int) -> Column:
        blank = F.array(*[F.lit(BLANK)] * width)
        padded = F.concat(groups, F.array_repeat(blank, F.greatest(count - F.size(groups), F.lit(0))))
        return F.flatten(F.transform(padded, lambda g: F.concat(F.array(F.lit(tag)), g)))

    tag = lambda t: F.array(F.lit(t))
    words = F.concat(
        F.array(F.concat(F.lit("<"), fmt, F.lit(">")),
                F.when(forced, "<forcedswitch>").otherwise("<anychoice>")),
        tag("<player>"), player, block("<move>", moves, n_moves, move_width),
        block("<switch>", switches, n_switches, switch_width),
        tag("<opponent>"), opponent, tag("<conditions>"), conditions,
        tag("<player_prev>"), player_prev, tag("<opp_prev>"), foe_prev)
    return F.array_join(words, " ")


def export_block(name: Column, moves: Column, item: Column | None = None, tera: Column | None = None,
                 ability: Column | None = None, evs: Column | None = None, nature: Column | None = None,
                 ivs: Column | None = None) -> Column:
    """Text block of one member; parts that are null are left out."""
    def line(prefix: str, c: Column | None, suffix: str = "") -> Column:
        c = F.lit(None).cast("string") if c is None else c
        return F.when(c.isNotNull(), F.concat(F.lit(prefix), c, F.lit(suffix)))

    header = name if item is None else F.concat(name, F.coalesce(F.concat(F.lit(" @ "), item), F.lit("")))
    return F.concat_ws(
        "\n", header, line("Tera Type: ", tera), line("Ability: ", ability), line("EVs: ", evs),
        line("", nature, " Nature"), line("IVs: ", ivs),
        F.array_join(F.transform(moves, lambda m: F.concat(F.lit("- "), m)), "\n"))


def append_and_pad(values: Column, end: Column, length: Column, pad: Column) -> Column:
    """Values, an end marker, then padding up to ``length``."""
    full = F.concat(values, F.array(end))
    return F.concat(F.slice(full, F.lit(1), length),
                    F.array_repeat(pad, F.greatest(length - F.size(full), F.lit(0))))
