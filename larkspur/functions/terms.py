"""Terms of an offer from items of title and value: one value that all parseable items agree on, or the reason why there is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.keys import collapse
from larkspur.functions.values import amount, amounts, short_date_text, strict_date, without_parentheses
from larkspur.operators.nested import let

#: How prices are written, and the titles under which terms stand.
CURRENCY = r"(?:₹|Rs\.?|INR)"
PRICE = r"\d[\d,]*(?:\.\d{1,2})?"
BAND_TITLES = ("price range", "price band")
BID_TITLES = ("minimum order quantity", "bid lot")


def unquoted(text: Column) -> Column:
    """Collapsed text without a quotation mark at either end."""
    return F.regexp_replace(collapse(text), '^"|"$', "")


def normal_title(title: Column) -> Column:
    """A title in lower case, collapsed, without a closing colon or star."""
    return F.lower(F.regexp_replace(collapse(title), r"[\s:*]+$", ""))


def titled(items: Column, titles: tuple[str, ...]) -> Column:
    """The items of array<struct(title, value, ...)> under one of the titles."""
    return F.filter(items, lambda i: normal_title(i["title"]).isin(*titles))


def _positive(digits: Column) -> Column:
    return let(F.replace(digits, F.lit(","), F.lit("")).try_cast("double"), lambda number: F.when(number > 0, number))


def scalar_price(text: Column) -> Column:
    """A text that is a price and nothing more: with a currency mark, '/-' and 'per (Equity) Share' or without. Ranges and placeholders are none."""
    bare = F.regexp_replace(unquoted(text), f"(?i)^{CURRENCY}\\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\s*per\s+(?:equity\s+)?share$", ""), r"\s*/-$", "")
    return let(bare, lambda b: F.when(b.rlike(f"^{PRICE}$"), _positive(b)))


def rupee_band(text: Column) -> Column:
    """struct(min, max) of a text that begins with a band of prices a share; null if there is none or its ends are in the wrong order.

    The lower end needs a currency mark. Either the unit 'per (Equity) Share(s)' follows the upper end, with anything behind it; or both ends name
    the unit, 'to' stands between them, the upper end has a currency mark too, and nothing follows.
    """
    mark = rf"(?i)^({CURRENCY})?\s*({PRICE})"
    share = r"(?:equity\s+)?shares?"

    def of(t: Column) -> Column:
        # '/-' behind an amount says nothing
        halves = lambda separator: F.split(F.regexp_replace(t, r"(?<=\d)\s*/-", ""), separator, 2)
        return let(F.struct(halves(r"(?i)\s*(?:\bto\b|[-–—])\s*").alias("plain"), halves(r"(?i)\s+to\s+").alias("worded")), judged)

    def judged(h: Column) -> Column:
        low = lambda h: F.get(h, F.lit(0))
        high = lambda h: F.get(h, F.lit(1))
        rest = lambda side: F.regexp_replace(side, mark, "")
        plain, worded = h["plain"], h["worded"]
        once = (F.regexp_extract(low(plain), mark, 1) != "") & (F.trim(rest(low(plain))) == "") & rest(high(plain)).rlike(rf"(?i)^\s*per\s+{share}\b")
        twice = (F.regexp_extract(low(worded), mark, 1) != "") & rest(low(worded)).rlike(rf"(?i)^\s*per\s+{share}$") & (F.regexp_extract(high(worded), mark, 1) != "") & rest(high(worded)).rlike(rf"(?i)^\s*(?:per\s+)?{share}$")
        ends = lambda h: F.struct(_positive(F.regexp_extract(low(h), mark, 2)).alias("min"), _positive(F.regexp_extract(high(h), mark, 2)).alias("max"))
        found = F.when(F.coalesce(once, F.lit(False)), ends(plain)).when(F.coalesce(twice, F.lit(False)), ends(worded))
        return let(found, lambda b: F.when(b["min"] <= b["max"], b))

    return let(unquoted(text), of)


def equity_quantity(text: Column) -> Column:
    """The whole number of shares that a text begins with, as in '1,200 Equity Shares and more'."""
    return _positive(F.regexp_extract(unquoted(text), r"(?i)^(\d[\d,]*)\s+equity\s+shares\b", 1)).cast("long")


def minimum_quantity(text: Column) -> Column:
    """``equity_quantity``, also of 'Minimum N Equity Shares' if nothing but 'and in multiples thereof' follows."""

    def of(plain: Column) -> Column:
        qualified = plain.rlike(r"(?i)^minimum\s+\d[\d,]*\s+equity\s+shares(?:\s+and\s+in\s+multiples\s+thereof)?$")
        return equity_quantity(F.when(qualified, F.regexp_replace(plain, r"(?i)^minimum\s+", "")).otherwise(plain))

    return let(unquoted(text), of)


def whole_amount(text: Column) -> Column:
    """The amount of a whole offer: the first outside of parentheses if one leg is named, the only one of the text if none is; of two legs there is none."""

    def of(outer: Column) -> Column:
        fresh, sale = outer.rlike(r"(?i)\bfresh\s+(?:issue|offer)\b"), outer.rlike(r"(?i)\boffer\s+for\s+sale\b|\bofs\b")
        only = let(amounts(text), lambda every: F.when(F.size(every) == 1, F.get(every, F.lit(0))))
        return F.when(fresh & sale, F.lit(None).cast("long")).when(fresh | sale, amount(outer)).otherwise(only)

    return let(without_parentheses(text), of)


def agreed(items: Column, parse: Callable[[Column], Column], none: str = "placeholder_or_unparseable", first: Callable[[Column], Column] | None = None) -> Column:
    """struct(value, reason, source_value, source_title) of items (title, value, ...): the value that all items give which give any.

    ``reason`` is ``term_absent`` without items, ``none`` if no item gives a value, ``official_term_conflict`` if they differ, else null. The source is the
    first item that gives the value, of those that ``first`` holds for if there are any.
    """

    def of(s: Column) -> Column:
        parsed = s["parsed"]
        kinds = F.array_distinct(F.transform(parsed, lambda p: p["v"]))
        chosen = F.coalesce(F.get(F.filter(parsed, lambda p: first(p["i"])), F.lit(0)), F.get(parsed, F.lit(0))) if first else F.get(parsed, F.lit(0))
        reason = F.when(F.coalesce(s["n"], F.lit(0)) == 0, "term_absent").when(F.size(parsed) == 0, none).when(F.size(kinds) > 1, "official_term_conflict")
        return let(F.struct(chosen.alias("chosen"), reason.alias("reason")), shown)

    def shown(s: Column) -> Column:
        source = lambda name: F.when(s["reason"].isNull(), unquoted(s["chosen"]["i"][name]))
        return F.struct(F.when(s["reason"].isNull(), s["chosen"]["v"]).alias("value"), s["reason"].alias("reason"), source("value").alias("source_value"), source("title").alias("source_title"))

    parsed = lambda its: F.filter(F.transform(its, lambda i: F.struct(parse(i["value"]).alias("v"), i.alias("i"))), lambda p: p["v"].isNotNull())
    # items are named twice, so they are computed first
    return let(let(items, lambda its: F.struct(F.when(its.isNotNull(), F.size(its)).alias("n"), parsed(its).alias("parsed"))), of)


def price_band(items: Column) -> Column:
    """``agreed`` of the bands under BAND_TITLES."""
    return agreed(titled(items, BAND_TITLES), rupee_band)


def issue_price(items: Column, titles: tuple[str, ...], preferred: str) -> Column:
    """``agreed`` of the scalar prices under the titles, with the source that is ``preferred`` (items have source too)."""
    return agreed(titled(items, titles), scalar_price, first=lambda i: i["source"] == preferred)


def issue_size(items: Column, titles: tuple[str, ...]) -> Column:
    """``agreed`` of the amounts of the whole offer under the titles."""
    return agreed(titled(items, titles), whole_amount, none="no_safe_overall_inr_total")


def minimum_bid(items: Column) -> Column:
    """``agreed`` of the quantities under BID_TITLES, with a minimum order as source before a bid lot."""
    return agreed(titled(items, BID_TITLES), minimum_quantity, first=lambda i: normal_title(i["title"]) == BID_TITLES[0])


def only_item(items: Column, title: str) -> Column:
    """struct(item, reason): the item under a title if there is exactly one, else ``missing`` or ``duplicate``."""
    return let(titled(items, (title,)), lambda found: F.struct(F.when(F.size(found) == 1, F.get(found, F.lit(0))).alias("item"), F.when(F.size(found) == 0, "missing").when(F.size(found) > 1, "duplicate").alias("reason")))


def listing_day(text: Column) -> Column:
    """struct(value, reason): an ISO day that the calendar has, else ``term_absent`` for nothing or ``unparseable_listing_date``."""
    plain = unquoted(F.coalesce(text, F.lit("")))
    day = strict_date(plain)
    return F.struct(day.alias("value"), F.when(plain == "", "term_absent").when(day.isNull(), "unparseable_listing_date").alias("reason"))


#: Titles of offer periods and bands, and of their revisions.
PERIOD, REVISED_PERIOD, REVISED_BAND = "issue period", "revised/extended issue period", "revised price range"


def revised_band(items: Column) -> Column:
    """``price_band``, or that of a revised range if there is one; beside an ordinary one it is ``competing_price_bands``, twice ``duplicate``."""
    reason = lambda text: F.struct(F.lit(None).cast("struct<min:double,max:double>").alias("value"), F.lit(text).alias("reason"), F.lit(None).cast("string").alias("source_value"), F.lit(None).cast("string").alias("source_title"))

    def of(s: Column) -> Column:
        n = F.size(s["revised"])
        chosen = F.when(n == 0, s["plain"]).otherwise(s["revised"])
        return F.when(n > 1, reason("duplicate")).when((n > 0) & (F.size(s["plain"]) > 0), reason("competing_price_bands")).otherwise(agreed(chosen, rupee_band))

    return let(F.struct(titled(items, (REVISED_BAND,)).alias("revised"), titled(items, BAND_TITLES).alias("plain")), of)


def stated_period(items: Column) -> Column:
    """struct(open, close, reason) of an offer's period, stated once, as ordinary or as revised.

    It is 'd-MMM-yyyy to d-MMM-yyyy'; an ordinary one may say in brackets to which day it is extended, which must be its last, and a
    revised one says from and to which days (dd/mm/yyyy), which must be its own. Reasons: ``missing_or_competing``, ``unrecognized``, ``inconsistent``.
    """
    day = lambda t: let(short_date_text(t), strict_date)
    slashed = lambda t: let(F.concat_ws("-", F.split_part(t, F.lit("/"), F.lit(3)), F.split_part(t, F.lit("/"), F.lit(2)), F.split_part(t, F.lit("/"), F.lit(1))), strict_date)

    # what a step names more than once is computed by the step before it
    def of(i: Column) -> Column:
        revised = normal_title(i["title"]) == REVISED_PERIOD
        return let(F.struct(unquoted(i["value"]).alias("text"), revised.alias("revised")), parts)

    def parts(s: Column) -> Column:
        text = s["text"]
        note = F.when(F.instr(text, F.lit(" (")) > 0, F.substr(text, F.instr(text, F.lit(" (")) + 2))
        return let(F.struct(F.split(F.substring_index(text, " (", 1), r"(?i)\s+to\s+").alias("ends"), note.alias("note"), s["revised"].alias("revised")), days)

    def days(s: Column) -> Column:
        extended = F.regexp_extract(s["note"], r"(?i)^The Issue is further extended to (\S+)\)$", 1)
        said = F.regexp_extract_all(F.regexp_extract(s["note"], r"(?i)^The Issue is further extended from start date \S+ to end date \S+\)$", 0), F.lit(r"(\d{2}/\d{2}/\d{4})"), F.lit(1))
        first, last = day(F.get(s["ends"], F.lit(0))), day(F.get(s["ends"], F.lit(1)))
        return let(F.struct(F.size(s["ends"]).alias("n"), first.alias("first"), last.alias("last"), s["note"].alias("note"), s["revised"].alias("revised"), extended.alias("extended"), said.alias("said")), judged)

    def judged(s: Column) -> Column:
        first, last, revised, note, said = (s[n] for n in ("first", "last", "revised", "note", "said"))
        known = (s["n"] == 2) & first.isNotNull() & last.isNotNull() & F.when(revised, F.size(said) == 2).otherwise(note.isNull() | (s["extended"] != ""))
        agrees = F.when(revised, (slashed(F.get(said, F.lit(0))) == first) & (slashed(F.get(said, F.lit(1))) == last)).otherwise(note.isNull() | (day(s["extended"]) == last))
        reason = F.when(~F.coalesce(known, F.lit(False)), "unrecognized").when(~F.coalesce(agrees, F.lit(False)), "inconsistent")
        return let(reason, lambda r: F.struct(F.when(r.isNull(), first).alias("open"), F.when(r.isNull(), last).alias("close"), r.alias("reason")))

    none = F.struct(F.lit(None).cast("date").alias("open"), F.lit(None).cast("date").alias("close"), F.lit("missing_or_competing").alias("reason"))
    return let(titled(items, (PERIOD, REVISED_PERIOD)), lambda found: F.when(F.size(found) == 1, of(F.get(found, F.lit(0)))).otherwise(none))
