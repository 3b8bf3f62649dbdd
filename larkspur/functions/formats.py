"""How values are shown: rupees and crores in Indian digit groups, shares, dates, ranges, rounded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a value that is not there.
NONE = "—"


def grouped(value: Column) -> Column:
    """A number with at most two decimals, in groups of three and then two digits: 12,34,567.5."""
    number = F.round(value.cast("decimal(30,10)"), 2)
    text = F.regexp_replace(F.abs(number).cast("string"), r"\.?0+$", "")
    # a whole number keeps its zeros
    whole = F.substring_index(F.abs(number).cast("string"), ".", 1)
    part = F.when(F.abs(number) == F.floor(F.abs(number)), "").otherwise(F.concat(F.lit("."), F.substring_index(text, ".", -1)))
    return F.concat(F.when(number < 0, "-").otherwise(""), F.regexp_replace(whole, r"(\d)(?=(\d\d)+\d$)", "$1,"), part)


def rupees(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("₹"), grouped(value)), F.lit(NONE))


def crores(value: Column) -> Column:
    """Rupees in units of ten million."""
    return F.coalesce(F.concat(F.lit("₹"), grouped(value.cast("decimal(30,10)") / 10000000), F.lit(" Cr")), F.lit(NONE))


def shares(value: Column) -> Column:
    return F.coalesce(grouped(value), F.lit(NONE))


def counted(value: Column, one: str, many: str) -> Column:
    """'1 filing', '2 filings'."""
    return F.concat(grouped(value), F.lit(" "), F.when(value == 1, one).otherwise(many))


def price_or_band(low: Column, high: Column, price: Column) -> Column:
    """A band if both its ends are there, else the price."""
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(rupees(low), F.lit("–"), rupees(high))).otherwise(rupees(price))


def day_text(day: Column, year: bool = True) -> Column:
    """'05 Mar 2024', or without its year."""
    return F.coalesce(F.date_format(day, "dd MMM yyyy" if year else "dd MMM"), F.lit(NONE))


def offer_period(first: Column, last: Column) -> Column:
    """struct(days, note) of an offer's first and last day: both with their year or years, or one and what is missing."""
    years = F.when(F.year(first) == F.year(last), F.year(last).cast("string")).otherwise(F.concat_ws("–", F.year(first), F.year(last)))
    both = first.isNotNull() & last.isNotNull()
    days = F.when(both, F.concat(day_text(first, False), F.lit(" – "), day_text(last, False))).otherwise(day_text(F.coalesce(first, last)))
    note = F.when(both, years).when(first.isNotNull(), "Opens · close unavailable").when(last.isNotNull(), "Closes · open unavailable").otherwise("Dates unavailable")
    return F.struct(days.alias("days"), note.alias("note"))


def rounded(value: Column, digits: int = 1) -> Column:
    """A double rounded half up, towards larger numbers: -0.25 becomes -0.2."""
    return F.floor(value * 10**digits + 0.5) / 10**digits
