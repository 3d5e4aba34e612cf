"""Display forms: ids, dates, times, distances, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def store_code(store_id: Column, width: int = 0) -> Column:
    """``S7`` or, with a width, ``S007``; longer ids are never cut."""
    text = store_id.cast("string")
    if width:
        text = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return F.concat(F.lit("S"), text)


def date_text(value: Column) -> Column:
    return F.date_format(value, "dd/MM/yyyy")


def time_text(value: Column) -> Column:
    return F.date_format(value, "HH:mm")


def fixed(value: Column, digits: int, half_even: bool = False) -> Column:
    """Text of a non-negative number with fixed decimals, rounded by its exact binary value."""
    total, power = _units(value, digits, half_even), 10**digits
    return F.concat(
        F.floor(total / power).cast("string"), F.lit("."), F.lpad((total % power).cast("string"), digits, "0")
    )


def round_exact(value: Column, digits: int) -> Column:
    """A non-negative number rounded by its exact binary value, exact ties to even.

    The built-in ``round`` rounds the shortest decimal form, so a value a little below a tie may go up.
    """
    return _units(value, digits, half_even=True) / F.lit(float(10**digits))


def _units(value: Column, digits: int, half_even: bool) -> Column:
    """The rounded number in units of its last decimal.

    The fraction is split into two parts whose products with the power of ten are exact.
    """
    power = 10**digits
    whole = F.floor(value)
    fraction = value - whole
    high = F.floor(fraction * (1 << 26)) / float(1 << 26)
    big, small = high * power, (fraction - high) * power
    units = F.floor(big + small)
    over = (big - units - 0.5) + small
    up = (over > 0) | ((over == 0) & (units % 2 == 1)) if half_even else over >= 0
    return whole * power + units + F.when(up, 1).otherwise(0)


def search_distance_text(km: Column) -> Column:
    """Metres below 1 km, else kilometres with one decimal."""
    return F.when(km < 1, F.format_string("%dm", F.round(km * 1000).cast("long"))).otherwise(
        F.concat(fixed(km, 1), F.lit("km"))
    )


def route_length_text(metres: Column) -> Column:
    """Kilometres with two decimals above 1000 m, else whole metres."""
    return F.when(metres > 1000, F.concat(fixed(metres / 1000, 2), F.lit(" km"))).otherwise(
        F.format_string("%d m", F.round(metres).cast("long"))
    )


def percent_text(share: Column) -> Column:
    return F.concat(fixed(share * 100, 1, half_even=True), F.lit("%"))
