"""Action indices: 0-3 moves, 4-8 switches, 9-12 moves with the once-per-battle boost, -1 hidden."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = -1
FIRST_SWITCH = 4
FIRST_TERA = 9


def action_index(name: Column, is_tera: Column, is_switch: Column, target: Column, active: Column,
                 moves: Column, switches: Column) -> Column:
    """Index of an action in its state; null when it cannot be mapped.

    ``moves`` and ``switches`` are name arrays in canonical order.
    """
    at = lambda arr, x: F.nullif(F.array_position(arr, x), F.lit(0)) - 1
    return (F.when(name.isNull(), HIDDEN)
            # fixed values: actions that share index 0
            .when(name.isin("Recharge", "Struggle", "Fight"), 0)
            .when(is_switch & (target == active), HIDDEN)
            .when(is_switch, FIRST_SWITCH + at(switches, target))
            .otherwise(at(moves, name) + F.when(is_tera, FIRST_TERA).otherwise(0))).cast("int")


def legal_actions(forced: Column, can_tera: Column, n_moves: Column, n_switches: Column) -> Column:
    """Ascending indices that may be legal in a state."""
    span = lambda first, n: F.when(n > 0, F.sequence(F.lit(first), F.lit(first) + n - 1)).otherwise(
        F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    return F.concat(F.when(forced, none).otherwise(span(0, n_moves)), span(FIRST_SWITCH, n_switches),
                    F.when(~forced & can_tera, span(FIRST_TERA, n_moves)).otherwise(none))


def illegal_mask(legal: Column, n: int = 13) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ~F.array_contains(legal, i))


def one_hot(action: Column, n: int = 13) -> Column:
    """One-hot array; a hidden action counts as 0."""
    at = F.greatest(action, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == at).cast("int"))


def without_tera(action: Column) -> Column:
    """Thirteen actions narrowed to nine."""
    return F.when(action >= FIRST_TERA, action - FIRST_TERA).otherwise(action)


def is_missing(action: Column) -> Column:
    return action == HIDDEN
