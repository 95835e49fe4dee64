"""Numbers as the analytics define them: rounding of exact binary values, percentages of a base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_fixed(x: Column, digits: int) -> Column:
    """x rounded to digits places by its exact binary value, exact ties away from zero."""
    power = F.lit(float(10**digits))
    scaled = F.abs(x) * power
    halves = x * F.lit(float(2 ** (digits + 1)))
    tie = (halves == F.floor(halves)) & (scaled - F.floor(scaled) == 0.5)
    return F.when(tie, F.signum(x) * (F.floor(scaled) + 1) / power).otherwise(F.regexp_replace(F.format_number(x, digits), ",", "").cast("double"))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def utf16_length(text: Column) -> Column:
    """Code units: characters beyond the basic plane count two. Only texts that aren't ASCII are encoded to tell."""
    points = F.length(text)
    return F.when(F.octet_length(text) == points, points).otherwise(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def percent_change(base: Column, now: Column) -> Column:
    """To two places; from nothing to something is 100, to nothing 0."""
    return F.when(base > 0, to_fixed((now - base) / F.nullif(base, F.lit(0)) * 100, 2)).when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def share(x: Column, total: Column) -> Column:
    return F.when(total > 0, x / F.nullif(total, F.lit(0))).otherwise(F.lit(0.0))
