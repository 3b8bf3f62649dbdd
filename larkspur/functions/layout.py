"""Columns of laid-out text: limits found from a header line and its neighbours, then slices of the lines below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.keys import collapse
from larkspur.operators.nested import let


def column_below(text: Column, header: str, neighbour: str, stop: str, width: int = 34, left: int = 2, right: int = 24, searched: int = 80, rows: int = 23, above: int = 2, below: int = 3) -> Column:
    """The text of the column below a header: struct(header_line, start, end, content); null if no line has the header.

    The header is the first match of ``header`` (in any case) in the first ``searched`` lines. The column begins where it stands and ends where the word
    ``neighbour`` begins, leftmost of those to its right in the lines from ``above`` before to ``below`` behind it, or ``width`` characters on. Of the
    ``rows`` lines below, up to one that matches ``stop``, it is what lies between the limits, moved out by ``left`` and ``right``
    characters and collapsed into one text. Tabs are four spaces; places count from 0.
    """

    def of(lines: Column) -> Column:
        at = F.array_position(F.transform(F.slice(lines, 1, searched), lambda x: x.rlike(f"(?i){header}")), F.lit(True))

        def cut(i: Column) -> Column:
            # i counts from 1
            start = F.regexp_instr(F.get(lines, i - 1), F.lit(f"(?i){header}")) - 1

            def limits(s: Column) -> Column:
                around = F.slice(lines, F.greatest(F.lit(1), i - above), F.least(i, F.lit(above + 1)) + below)
                ends = F.filter(F.transform(around, lambda x: F.instr(F.upper(x), F.lit(neighbour)) - 1), lambda e: e > s)
                end = F.coalesce(F.array_min(ends), s + width)
                lower = F.slice(lines, i + 1, rows)
                stops = F.array_position(F.transform(lower, lambda x: x.rlike(f"(?i){stop}")), F.lit(True))
                kept = F.when(stops > 0, F.slice(lower, 1, stops.cast("int") - 1)).otherwise(lower)
                first = F.greatest(F.lit(0), s - left)
                content = collapse(F.array_join(F.transform(kept, lambda x: F.substr(x, first + 1, end + right - first)), " "))
                return F.struct((i - 1).alias("header_line"), s.alias("start"), end.alias("end"), content.alias("content"))

            return let(start, limits)

        return let(at.cast("int"), lambda i: F.when(i > 0, cut(i)))

    return let(F.split(F.regexp_replace(text, "\t", "    "), "\r?\n"), of)


def million_amount(content: Column) -> Column:
    """The first 'N million' of a text, in units; null without one or for zero."""
    number = F.regexp_extract(content, r"(?i)(?:₹|Rs\.?|INR)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*million\b", 1)
    value = F.round(F.regexp_replace(number, ",", "").try_cast("decimal(30,6)") * 1000000).cast("long")
    return F.when(value > 0, value)
