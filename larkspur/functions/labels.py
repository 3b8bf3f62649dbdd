"""Dates behind labels: explicit dates in prose, labels with a date across an allowed bridge, and their consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.arrays import occurrences
from larkspur.functions.keys import collapse
from larkspur.functions.values import AMERICAN, EUROPEAN, month_number, strict_date
from larkspur.operators.nested import let

#: Labels of an offer's first and last day, and what may stand between a label and its date, in this order.
ISSUE = r"(?:bid\s*/\s*issue|bid|issue|offer)"
LABELS = {
    "open": rf"\b{ISSUE}\s+(?:opening\s+date|open(?:s|ed)?\s+on)\b",
    "close": rf"\b{ISSUE}\s+(?:closing\s+date|close(?:s|d)?\s+on)\b",
}
BRIDGE = (r"except\s+in\s+relation\s+to\s+any\s+bids?\s+received\s+from\s+the\s+anchor\s+investors?,?", r"i\.?\s*e\.?", r"being\b", r"(?:mon|tues|wednes|thurs|fri|satur|sun)day\b")
#: What before a label, or behind its date, says that the date is that of anchor investors.
ANCHOR_BEFORE = r"\banchor\s+investors?(?:\s+(?:bid(?:ding)?|offer))?\s*/?\s*$"
ANCHOR_BEHIND = r"\bbids?\s+by\s+anchor\s+investors?\s+were\s+submitted\b|\ballocation\s+to\s+anchor\s+investors?\b|\banchor\s+investor\s+allocation\b"
#: Characters behind a label in which its date must begin and end, before it and behind its date that are looked at.
REACH, LEAD, TAIL = 180, 70, 150


def _days(text: Column) -> tuple[Column, Column]:
    """The days of the first date of either form: 'Month d, yyyy' and 'd Month yyyy'; null where the calendar has none."""
    day = lambda form, d, m: strict_date(F.concat_ws("-", F.regexp_extract(text, form, 3), F.lpad(month_number(F.regexp_extract(text, form, m)).cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, form, d), 2, "0")))
    return day(AMERICAN, 2, 1), day(EUROPEAN, 1, 2)


def explicit_date(text: Column) -> Column:
    """The first 'Month d, yyyy' of a text if it has one, wherever it stands, else the first 'd Month yyyy'; full stops are overlooked.

    If the calendar does not have that day the result is null.
    """

    def of(t: Column) -> Column:
        american, european = _days(t)
        return F.when(t.rlike(AMERICAN), american).otherwise(european)

    return let(F.regexp_replace(collapse(text), r"\.", ""), of)


def first_date(text: Column) -> Column:
    """struct(day, start, raw) of the earlier of the first date of either form that the calendar has; start counts from 0. Null without one."""

    def of(t: Column) -> Column:
        at = lambda form, day: F.when(day.isNotNull(), F.struct((F.regexp_instr(t, F.lit(form)) - 1).alias("start"), F.regexp_extract(t, form, 0).alias("raw"), day.alias("day")))
        american, european = _days(t)
        return F.array_min(F.array_compact(F.array(at(AMERICAN, american), at(EUROPEAN, european))))

    return let(text, of)


def date_mentions(text: Column, label: str, bridge: tuple[str, ...] = BRIDGE) -> Column:
    """array<struct(start, length, day)>: each place where ``label`` is followed by its date, from the label's first character to the date's last.

    The first date within REACH characters behind a label is its date if nothing but white space, punctuation other than a full
    stop, and the phrases of ``bridge``, each once at most and in order, stands between, and nothing around says that the
    date is that of anchor investors. ``start`` counts from 0 in the collapsed text. Of labels without a date there is nothing.
    """
    space = r"[,:;\-–—\s]*"
    allowed = rf"(?i)^{space}{''.join(f'(?:{b})?{space}' for b in bridge)}$"
    seen = occurrences(collapse(text), f"(?i){label}", LEAD, REACH + TAIL)
    dated = F.transform(seen, lambda o: F.struct(o.alias("o"), first_date(F.left(o["tail"], F.lit(REACH))).alias("d")))

    def good(x: Column) -> Column:
        o, d = x["o"], x["d"]
        behind = F.substr(o["tail"], d["start"] + F.length(d["raw"]) + 1, F.lit(TAIL))
        return d.isNotNull() & F.left(o["tail"], d["start"]).rlike(allowed) & ~o["lead"].rlike(f"(?i){ANCHOR_BEFORE}") & ~behind.rlike(f"(?i){ANCHOR_BEHIND}")

    return F.transform(F.filter(dated, good), lambda x: F.struct(x["o"]["start"].alias("start"), (F.length(x["o"]["found"]) + x["d"]["start"] + F.length(x["d"]["raw"])).alias("length"), x["d"]["day"].alias("day")))


def offer_dates(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(id, open_date, close_date, open_page, close_page, reason) of pages (id, page, text), with listing days (id, listing_date) if given.

    Each day must be the same wherever its label stands, else both are null and the reason is ``official_date_conflict``; the first day
    must not be after the last (``invalid_offer_chronology``), nor that after the listing day (``closing_after_listing``). Without any, the
    reason is ``explicit_dates_absent``; else it is null. A page is where a day stands first. Every id of ``pages`` has a row.
    """
    found = pages.select("id", "page", *(F.transform(date_mentions(F.col("text"), label), lambda m: m["day"]).alias(kind) for kind, label in LABELS.items()))
    sides = []
    for kind in LABELS:
        each = found.select("id", "page", F.explode_outer(kind).alias("day"))
        sides.append(each.groupBy("id").agg(F.min("day").alias(f"{kind}_low"), F.max("day").alias(f"{kind}_high"), F.min(F.when(F.col("day").isNotNull(), F.col("page"))).alias(f"{kind}_page")))
    rows = sides[0].join(sides[1], "id")
    if listed is not None:
        rows = rows.join(listed.select("id", "listing_date"), "id", "left")
    else:
        rows = rows.withColumn("listing_date", F.lit(None).cast("date"))
    first, last = F.col("open_low"), F.col("close_low")
    reason = (
        F.when((first != F.col("open_high")) | (last != F.col("close_high")), "official_date_conflict")
        .when(first > last, "invalid_offer_chronology")
        .when(last > F.col("listing_date"), "closing_after_listing")
        .when(first.isNull() & last.isNull(), "explicit_dates_absent")
    )
    kept = lambda c: F.when(F.col("reason").isNull(), c)
    judged = rows.withColumn("reason", reason)
    return judged.select("id", kept(first).alias("open_date"), kept(last).alias("close_date"), kept(F.col("open_page")).alias("open_page"), kept(F.col("close_page")).alias("close_page"), "reason")


def still_extracts(source: Column, kind: str, day: Column, listed: Column | None = None) -> Column:
    """Whether a stored extraction stands under the present rules: its source text is one mention of its kind and gives its day, not after the listing for a closing day."""
    found = date_mentions(source, LABELS[kind])
    stands = (F.size(found) == 1) & (F.get(found, F.lit(0))["day"] == day)
    if kind == "close" and listed is not None:
        stands = stands & (listed.isNull() | (day <= listed))
    return F.coalesce(stands, F.lit(False))
