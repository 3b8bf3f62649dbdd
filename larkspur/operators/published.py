"""Published fields, evidence arrays and open merges by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.fields import coerced_status


def field(value: Column, status: Column, evidence: Column) -> Column:
    """An evidence-bearing field; a null value has no evidence, evidence is kept once in its first place."""
    return F.struct(value.alias("value"), coerced_status(value, status).alias("status"), F.when(value.isNull(), F.slice(evidence, 1, 0)).otherwise(F.array_distinct(evidence)).alias("evidence"))


def add_once(items: Column, item: Column, keys: list[str]) -> Column:
    """Appends ``item`` unless an item with the same ``keys`` is there; a null item changes nothing."""
    same = lambda x: [x[k].eqNullSafe(item[k]) for k in keys]

    def there(x: Column) -> Column:
        found = F.lit(True)
        for s in same(x):
            found = found & s
        return found

    return F.when(item.isNull() | F.exists(items, there), items).otherwise(F.array_append(items, item))


def replace_by(items: Column, item: Column, key: str) -> Column:
    """Drops items with the key of ``item`` and appends it: the last one wins."""
    return F.array_append(F.filter(items, lambda x: ~x[key].eqNullSafe(item[key])), item)


def without(items: Column, others: Column) -> Column:
    """Difference that keeps repeats, unlike array_except."""
    return F.filter(items, lambda x: ~F.array_contains(others, x))


def record_clock(clock: Column, *nested: Column) -> Column:
    """A record's clock, lifted to the latest of its nested clocks (arrays)."""
    return F.greatest(clock, *(F.array_max(n) for n in nested))


def three_way_paths(current: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, path, value, outcome) of a merge of three tables (id, path, value) of leaves and atomic fields.

    A path that one side lacks is absent there, which is not the same as null: presence is part of equality.
    A change applies where current still equals before, is known where current has it, and else is held as a
    conflict with the current value. Rows whose merged path is absent are left out.
    """
    c, b, a = (t.select("id", "path", F.struct(F.lit(True).alias("there"), "value").alias(n)) for t, n in ((current, "c"), (before, "b"), (after, "a")))
    # one grouped aggregate over the union instead of two full joins: one shuffle, and rows of a hot id are many keys
    stacked = c.withColumns({"b": F.lit(None).cast(b.schema["b"].dataType), "a": F.lit(None).cast(a.schema["a"].dataType)})
    stacked = stacked.unionByName(b, allowMissingColumns=True).unionByName(a, allowMissingColumns=True)
    sides = stacked.groupBy("id", "path").agg(*(F.max(n).alias(n) for n in "cba"))
    equal = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = F.when(equal("b", "a"), "unchanged").when(equal("c", "a"), "already").when(equal("c", "b"), "applied").otherwise("conflict")
    merged = F.when(outcome == "applied", F.col("a")).otherwise(F.col("c"))
    return sides.select("id", "path", merged.alias("m"), outcome.alias("outcome")).where("m is not null").select("id", "path", F.col("m.value").alias("value"), "outcome")
