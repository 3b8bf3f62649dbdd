"""Typed values from text: numbers, prices, amounts, dates, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of amount words; an amount with its unit; a number; a range of prices.
UNITS = {"crore": 10_000_000, "million": 1_000_000, "lakh": 100_000, "lac": 100_000}
AMOUNT = r"(?i)(?:₹|Rs\.?|INR)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s*(crore|million|lakh|lac)s?\b"
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
BAND = rf"(?i){NUMBER}\s*(?:to|[-–—])\s*(?:Rs\.?|₹)?\s*{NUMBER}"


def tolerant_number(text: Column) -> Column:
    """A number with thousands commas as double; anything else null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain.try_cast("double"))


def price_kind(text: Column) -> Column:
    """band (two numbers with 'to' or a dash between), fixed (a number) or missing."""
    return F.when(text.rlike(BAND), "band").when(text.rlike("[0-9]"), "fixed").otherwise("missing")


def price_low(text: Column) -> Column:
    """The lower end of a band, else the first number."""
    return tolerant_number(F.when(text.rlike(BAND), F.regexp_extract(text, BAND, 1)).otherwise(F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit(""))))


def price_high(text: Column) -> Column:
    """The upper end of a band."""
    return tolerant_number(F.nullif(F.regexp_extract(text, BAND, 2), F.lit("")))


def amount(text: Column) -> Column:
    """The first amount with currency mark and unit in whole currency units, rounded; null if there is none or it is zero."""
    number = tolerant_number(F.nullif(F.regexp_extract(text, AMOUNT, 1), F.lit("")))
    unit = F.lower(F.regexp_extract(text, AMOUNT, 2))
    factor = F.lit(None).cast("int")
    for word, times in UNITS.items():
        factor = F.when(unit == word, F.lit(times)).otherwise(factor)
    return F.when(number > 0, F.round(number * factor).cast("long"))


def amounts(text: Column) -> Column:
    """All amounts with currency mark and unit, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), amount))


def strict_date(text: Column) -> Column:
    """An ISO date that the calendar has; anything else null."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def lenient_date(text: Column) -> Column:
    """Year, month and day of an ISO date; days beyond the month roll over."""
    year, month, day = (F.regexp_extract(text, "^([0-9]{4})-([0-9]{2})-([0-9]{2})$", i).try_cast("int") for i in (1, 2, 3))
    return F.when(month.between(1, 12) & day.between(1, 31), F.date_add(F.make_date(year, month, F.lit(1)), day - 1))


def market_day(clock: Column) -> Column:
    """The day of a UTC clock in a market five and a half hours ahead."""
    return F.to_date(clock + F.expr("INTERVAL 330 MINUTES"))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)(:[0-9]+)?([/?#]|$)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def url_param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def flagged(text: Column) -> Column:
    """A tolerant flag: anything but null, empty, false, 0, no and n."""
    return ~F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("", "false", "0", "no", "n")


#: The names of months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_NAMES = "|".join([*MONTHS, *(m[:3] for m in MONTHS if m != "May"), "Sept"])


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name or its first three letters (or Sept), in any case; else null."""
    numbers = {m.lower(): i for i, m in enumerate(MONTHS, 1)} | {m[:3].lower(): i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)), F.lower(name))


def _assembled(day: Column, month: Column, year: Column) -> Column:
    return F.when(month.isNotNull() & (day != "") & (year != ""), F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def short_date_text(text: Column) -> Column:
    """ISO text of d-MMM-yyyy without a look at the calendar: 31-Feb passes."""
    part = lambda i: F.regexp_extract(text, "^([0-9]{1,2})-([A-Za-z]+)-([0-9]{4})$", i)
    return _assembled(part(1), month_number(part(2)), part(3))


#: Dates in prose.
AMERICAN = rf"(?i)\b({MONTH_NAMES})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(20\d{{2}})\b"
EUROPEAN = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})\s*,?\s+(20\d{{2}})\b"


def prose_date(text: Column) -> Column:
    """The earlier of the first 'Month d, yyyy' and the first 'd Month yyyy' of this century (ordinals allowed).

    Only the first of each form counts; if the calendar does not have it, that form gives none.
    """
    part = lambda form, i: F.regexp_extract(text, form, i)
    one = strict_date(_assembled(part(AMERICAN, 2), month_number(part(AMERICAN, 1)), part(AMERICAN, 3)))
    other = strict_date(_assembled(part(EUROPEAN, 1), month_number(part(EUROPEAN, 2)), part(EUROPEAN, 3)))
    first = F.regexp_instr(text, F.lit(AMERICAN)) < F.regexp_instr(text, F.lit(EUROPEAN))
    return F.when(one.isNotNull() & other.isNotNull(), F.when(first, one).otherwise(other)).otherwise(F.coalesce(one, other))


def share_quantity(text: Column) -> Column:
    """The number before 'Equity Shares'."""
    return tolerant_number(F.nullif(F.regexp_extract(text, "(?i)([0-9][0-9,]*) +equity +shares", 1), F.lit(""))).cast("long")


def without_parentheses(text: Column) -> Column:
    """Text outside of parentheses, however deep. A closing one too many is left out; what follows one that is never closed is inside.

    The innermost pairs are taken out together, as often as pairs are nested in the text.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    at = lambda s, c: F.greatest(F.lit(0), s["at"] + F.when(c == "(", 1).otherwise(-1))
    brackets = F.filter(F.split(F.regexp_replace(text, "[^()]", ""), ""), lambda c: c != "")
    depth = F.aggregate(brackets, start, lambda s, c: F.struct(at(s, c).alias("at"), F.greatest(s["most"], at(s, c)).alias("most")), lambda s: s["most"])
    # without pairs, the closing ones left stand before the opening ones left
    left = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), text, lambda t, _: F.regexp_replace(t, r"\([^()]*+\)", ""))
    return F.replace(F.substring_index(left, "(", 1), F.lit(")"), F.lit(""))


def flexible_date(text: Column) -> Column:
    """The day of an ISO date, of a timestamp that begins with one, or of d-m-yyyy with dashes or slashes, if the calendar has it."""
    plain = F.trim(text)
    part = lambda i: F.regexp_extract(plain, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", i)
    iso = strict_date(F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}(?:T|$)"), F.left(plain, F.lit(10))))
    return F.coalesce(iso, strict_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))))


def recent_date(text: Column) -> Column:
    """The day from 2020 to 2099 of an ISO date or 'Month d, yyyy' with the month in full, if the calendar has it."""
    plain = F.trim(text)
    part = lambda i: F.regexp_extract(plain, rf"(?i)^({'|'.join(MONTHS)})\s+(\d{{1,2}})\s*,\s*(\d{{4}})$", i)
    found = F.coalesce(strict_date(plain), strict_date(F.concat_ws("-", part(3), F.lpad(month_number(part(1)).cast("string"), 2, "0"), F.lpad(part(2), 2, "0"))))
    return F.when(F.year(found).between(2020, 2099), found)


def blob_sha1(content: Column) -> Column:
    """The hash that version control gives a file of this text."""
    body = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(body).cast("string")).cast("binary"), F.unhex(F.lit("00")), body))


def rfc3339(text: Column) -> Column:
    """Whether a text is a timestamp with seconds and an offset, of a day that the calendar has and a time that a clock shows; null is none."""
    form = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[Zz]|[+-](\d{2}):(\d{2}))$"
    part = lambda i: F.coalesce(F.regexp_extract(text, form, i).try_cast("int"), F.lit(0))
    times = (part(2) < 24) & (part(3) < 60) & (part(4) < 60) & (part(5) < 24) & (part(6) < 60)
    return text.rlike(form) & strict_date(F.left(text, F.lit(10))).isNotNull() & times
