"""Sinks for reports and evidence files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str) -> None:
    """Writes evidence once: fails if ``path`` exists, so that nothing is replaced."""
    df.write.mode("errorifexists").json(path)


def markdown_row(*cells: Column) -> Column:
    """One line of a table; nulls are dashes, bars are escaped."""
    texts = [F.replace(F.coalesce(c.cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |"))


def markdown_by(df: DataFrame, group: str, order: str, row: Column, most: int = 1000) -> DataFrame:
    """(group, report): the rows of each group in ``order`` as lines of one text; groups are summaries of ``most`` rows at most.

    A larger group is an error, not a cut: a report of that size is no summary.
    """
    # counted before anything is gathered, so that a large group fails instead of filling a task
    counts = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    line = F.when(F.col("_n") <= most, row).otherwise(F.raise_error(F.lit("a group is too large for a report")).cast("string"))
    lines = df.join(counts, F.col(group).eqNullSafe(F.col("_group"))).select(group, F.col(order).alias("_order"), line.alias("line"))
    made = lines.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_order", "line"))).alias("rows"))
    return made.select(group, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("report"))


def write_both(report: DataFrame, path: str, compact: list[Column]) -> None:
    """Writes a report in full and compact form, ``full`` and ``compact`` below ``path``, once each; the report should be a written table, as it is read twice."""
    write_new(report, f"{path}/full")
    write_new(report.select(*compact), f"{path}/compact")
