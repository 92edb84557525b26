"""Month and half-year arithmetic."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def clamp_month(d: Column, first: datetime.date, last: datetime.date) -> Column:
    """Month start of a date, held inside the known span."""
    return F.greatest(F.least(month_start(d), F.lit(last)), F.lit(first))


def half_year_start(d: Column) -> Column:
    """First of January or of July of the date's half-year."""
    return F.make_date(F.year(d), F.when(F.month(d) <= 6, 1).otherwise(7), F.lit(1))


def half_year_end(d: Column) -> Column:
    """Last month start of the date's half-year."""
    return F.make_date(F.year(d), F.when(F.month(d) <= 6, 6).otherwise(12), F.lit(1))


def parse_battle_date(s: Column) -> Column:
    """Date in day or second grain; null when neither pattern fits."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("MM-dd-yyyy")),
                      F.try_to_timestamp(s, F.lit("MM-dd-yyyy-HH:mm:ss")))
