"""Mentions in pages of text; fields filled from mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.arrays import occurrences


def pages(docs: DataFrame, text: str = "text", mark: str = "\f") -> DataFrame:
    """(id, page, text) of documents (id, text) whose pages end with ``mark``; pages count from 1, a blank last page is none."""
    parts = F.split(text, mark)
    kept = F.when(F.trim(F.element_at(parts, -1)) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return docs.select("id", F.posexplode(kept).alias("place", "page_text")).select("id", (F.col("place") + 1).alias("page"), F.col("page_text").alias("text"))


def mentions(pages: DataFrame, patterns: dict[str, str], before: int = 90, after: int = 220, most: int = 6, needs: str | None = None) -> DataFrame:
    """(id, page, label, nth, start, found, context): where patterns occur in pages (id, page, text), with what stands around them.

    ``patterns`` maps a label to a regular expression without groups. ``start`` counts from 0. A page gives at most ``most``
    mentions of a label: the report's size, in the order of the text. With ``needs`` only contexts that match it count.
    Contexts are cut within the page's row, so no mention carries the page along.
    """

    def of(label: str, pattern: str) -> Column:
        seen = F.transform(occurrences(F.col("text"), pattern, before, after), lambda o: F.struct(F.lit(label).alias("label"), o["start"].alias("start"), o["found"].alias("found"), F.concat(o["lead"], o["found"], o["tail"]).alias("context")))
        fit = F.filter(seen, lambda m: m["context"].rlike(needs)) if needs else seen
        return F.transform(F.slice(fit, 1, most), lambda m, i: F.struct(m["label"].alias("label"), (i + 1).alias("nth"), m["start"].alias("start"), m["found"].alias("found"), m["context"].alias("context")))

    # a plain explode would look for them three times: the optimizer infers a filter from it
    found = pages.select("id", "page", F.explode_outer(F.concat(*(of(k, p) for k, p in patterns.items()))).alias("m"))
    return found.where("m is not null").select("id", "page", "m.*")


def fill_field(records: DataFrame, observed: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """Fills ``field`` of records (id, field, ...) from observed values (id, value), and counts what happened.

    The first result has (id, value, reason, outcome): one agreed value fills a gap, corroborates an equal one or is held as a
    conflict; several values are ``ambiguous``, none ``absent``. The second has one row of counters: candidates (records
    whose field is null), filled, corroborated, conflicts, ambiguous, absent, remaining (still null).
    """
    agreed = observed.where("value is not null").groupBy("id").agg(F.count_distinct("value").alias("n"), F.min("value").alias("seen"))
    rows = records.select("id", F.col(field).alias("current")).join(agreed, "id", "left")
    reason = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous").otherwise("agreed")
    outcome = F.when(reason != "agreed", "unchanged").when(F.col("current").isNull(), "filled").when(F.col("current") == F.col("seen"), "corroborated").otherwise("conflict")
    found = rows.select("id", F.when(outcome == "filled", F.col("seen")).otherwise(F.col("current")).alias("value"), reason.alias("reason"), outcome.alias("outcome"), F.col("current").isNull().alias("gap"))
    count = lambda condition, name: F.count_if(condition).alias(name)
    o, r = F.col("outcome"), F.col("reason")
    counters = found.agg(
        count(F.col("gap"), "candidates"), count(o == "filled", "filled"), count(o == "corroborated", "corroborated"), count(o == "conflict", "conflicts"),
        count(r == "ambiguous", "ambiguous"), count(r == "absent", "absent"), count(F.col("value").isNull(), "remaining"),
    )
    return found.drop("gap"), counters
