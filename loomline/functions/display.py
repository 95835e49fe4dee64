"""Text for panels: escaped markup, short numbers, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What markup escapes, letters of thousands and their powers.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
APOSTROPHE = ("'", "&#39;")
THOUSANDS = ["K", "M", "B", "T"]


def escape_html(text: Column, apostrophes: bool = False) -> Column:
    for sign, entity in [*ESCAPES, *[APOSTROPHE] * apostrophes]:
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def compact(x: Column, grouped: bool = True) -> Column:
    """A whole number to a tenth of thousands, millions and so on, half up: 999, 1K, 1.2K, 1M. What would round to 1000K is 1M.

    Beyond 9,999 trillions the digits come in groups, unless they aren't to be grouped.
    """
    size = F.abs(x.cast("long"))
    told = None
    for power, letter in reversed(list(enumerate(THOUSANDS, 1))):
        tenth = F.lit(1000**power // 10)
        tenths = F.call_function("div", size, tenth) + F.when(size % tenth * 2 >= tenth, 1).otherwise(0)
        whole = F.call_function("div", tenths, F.lit(10))
        whole = F.when(whole >= 10_000, F.format_number(whole, 0)).otherwise(whole.cast("string")) if grouped else whole.cast("string")
        own = F.concat(whole, F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit(letter))
        told = own if told is None else F.when(tenths < 10_000, own).otherwise(told)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(size < 1000, size.cast("string")).otherwise(told))


def age(at: Column, now: Column) -> Column:
    """How long ago a time was, in whole minutes, hours or days; a time that isn't known, or lies ahead, is just now."""
    past = (F.unix_millis(now) - F.unix_millis(at)) / 1000
    told = F.concat(F.floor(past / 86_400).cast("string"), F.lit("d ago"))
    for unit, letter, most in ((3600, "h", 86_400), (60, "m", 3600)):
        told = F.when(past < most, F.concat(F.floor(past / unit).cast("string"), F.lit(f"{letter} ago"))).otherwise(told)
    return F.when(F.coalesce(past, F.lit(0)) < 60, "just now").otherwise(told)
