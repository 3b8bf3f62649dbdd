"""Helpers over arrays within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.operators.nested import let


def running_sums(sizes: Column) -> Column:
    """For each place of an array of whole numbers the sum of those before it.

    Sums go by blocks of about the square root of the length, so a long array costs its length times that root.
    """

    def within(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)

        def by_blocks(w: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(x) - 1, w)
            sums = F.transform(starts, lambda at: add(F.slice(x, at + 1, w)))
            before = let(sums, lambda s: F.transform(s, lambda _, b: add(F.slice(s, 1, b))))
            return let(before, lambda p: F.transform(x, lambda _, i: F.get(p, F.floor(i / w).cast("int")) + add(F.slice(x, i - i % w + 1, i % w))))

        return F.when(F.size(x) > 0, let(width, by_blocks)).when(x.isNotNull(), F.expr("cast(array() as array<bigint>)"))

    return let(sizes, within)


def occurrences(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """array<struct(start, found, lead, tail)>: where a pattern without groups occurs, with up to so many characters before and behind.

    ``start`` counts from 0. Occurrences do not overlap and are in the order of the text; a null text gives null.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def placed(f: Column) -> Column:
        # what stands between occurrences, with nothing cut off at the end
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        sizes = F.zip_with(f, F.slice(gaps, 2, F.size(f)), lambda x, g: F.length(x) + g)
        first = F.get(gaps, F.lit(0))
        starts = F.transform(running_sums(sizes), lambda s: (s + first).cast("int"))
        return F.zip_with(
            f,
            starts,
            lambda x, s: F.struct(s.alias("start"), x.alias("found"), F.substr(text, F.greatest(F.lit(0), s - before) + 1, F.least(s, F.lit(before))).alias("lead"), F.substr(text, s + F.length(x) + 1, F.lit(after)).alias("tail")),
        )

    return let(found, placed)
