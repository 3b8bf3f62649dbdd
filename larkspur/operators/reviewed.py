"""Imports of reviewed records: approval by content, identity gate, add, hold, move and guarded corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """A row's hash over ``columns`` as JSON, null fields included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def approved(batch: DataFrame, approvals: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``batch`` whose content hash is in ``approvals`` (hash): a record that changed after its review is not imported."""
    return batch.withColumn("hash", content_hash(batch, columns)).join(approvals.select("hash").distinct(), "hash", "left_semi").drop("hash")


def _exploded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, partition, key): a row's non-null keys, each with its kind in front."""
    texts = F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys)))
    return rows.select("id", "partition", F.explode(texts).alias("key"))


def identity_hits(registry: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """(batch_id, several, hits): the registry records (id, partition) that share any non-null key with a batch row; ``several`` if a key alone has more than one.

    A key's records are one row before they meet the batch, the first and the last of them, so a key that many records and
    many batch rows share costs a row each, not a pair each.
    """
    record = F.struct("id", "partition")
    known = _exploded(registry, keys).groupBy("key").agg(F.min(record).alias("first"), F.max(record).alias("last"))
    met = _exploded(batch, keys).withColumnRenamed("id", "batch_id").drop("partition").join(known, "key")
    # a row has a few keys
    return met.groupBy("batch_id").agg(F.bool_or(F.col("first") != F.col("last")).alias("several"), F.collect_set("first").alias("hits"))


def reviewed_import(registry: DataFrame, batch: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """(id, outcome) of importing reviewed rows (id, partition, keys, facts) into a registry of the same columns.

    A row without a hit on any key is ``added``. With one hit in the same partition it is ``present`` if all facts are equal,
    ``enriched`` if they are equal or the registry's are null, else ``conflict``. One hit in another partition is ``held``, as are
    several hits. Batch rows that share an id, or a key with another row of the batch, are ``repeated``: a later row would
    see what an earlier one inserts, so none of them decides (``folds.batch_fold`` decides in order). Null keys match nothing.
    """
    hits = identity_hits(registry, batch, keys)
    asked = _exploded(batch, list(dict.fromkeys(["id", *keys])))
    common = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = asked.join(common, "key", "left_semi").select(F.col("id").alias("again")).distinct()
    one = F.get("hits", F.lit(0))
    old = registry.select(F.col("id").alias("hit"), F.struct(*facts).alias("old"))
    counted = hits.select("batch_id", (F.col("several") | (F.size("hits") > 1)).alias("several"), one["id"].alias("hit"), one["partition"].alias("hit_partition"))
    joined = batch.join(again, F.col("id") == F.col("again"), "left").join(counted, F.col("id") == F.col("batch_id"), "left").join(old, "hit", "left")
    same = reduce(lambda a, b: a & b, (F.col(f).eqNullSafe(F.col(f"old.{f}")) for f in facts))
    fills = reduce(lambda a, b: a & b, (F.col(f"old.{f}").isNull() | F.col(f).eqNullSafe(F.col(f"old.{f}")) for f in facts))
    outcome = (
        F.when(F.col("again").isNotNull(), "repeated")
        .when(F.col("batch_id").isNull(), "added")
        .when(F.col("several") | (F.col("hit_partition") != F.col("partition")), "held")
        .when(same, "present")
        .when(fills, "enriched")
        .otherwise("conflict")
    )
    return joined.select("id", outcome.alias("outcome"))


def imported(registry: DataFrame, batch: DataFrame, outcomes: DataFrame, facts: list[str]) -> DataFrame:
    """The registry after an import: added rows, and rows of the same id whose null facts the batch fills; nothing else changes."""
    done = batch.join(outcomes, "id")
    fresh = done.where("outcome = 'added'").select(registry.columns)
    fills = done.where("outcome = 'enriched'").select("id", F.struct(*facts).alias("_new"))
    kept = registry.join(fills, "id", "left")
    filled = [F.coalesce(F.col(c), F.col(f"_new.{c}")).alias(c) if c in facts else F.col(c) for c in registry.columns]
    return kept.select(*filled).unionByName(fresh)


def reconciled(registry: DataFrame, actions: DataFrame) -> DataFrame:
    """(id, partition, value, outcome) after actions (id, kind, expected, target) on a registry (id, partition, value).

    Kinds: ``correct`` sets the value, ``move`` the partition. An action applies only where the registry still has the
    expected current value or partition; one that is done already is ``already``, any other ``refused``. A record with
    several actions of one kind, or an action without a record, changes nothing: ``refused`` and ``unknown``.
    """
    once = actions.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("expected").alias("expected"), F.min("target").alias("target"))
    joined = registry.join(once, "id", "full")
    current = F.when(F.col("kind") == "move", F.col("partition")).otherwise(F.col("value"))
    outcome = (
        F.when(F.col("kind").isNull(), "untouched")
        .when(F.col("partition").isNull(), "unknown")
        .when(F.col("n") > 1, "refused")
        .when(current.eqNullSafe(F.col("target")), "already")
        .when(current.eqNullSafe(F.col("expected")), "applied")
        .otherwise("refused")
    )
    applied = outcome == "applied"
    return joined.select(
        "id",
        F.when(applied & (F.col("kind") == "move"), F.col("target")).otherwise(F.col("partition")).alias("partition"),
        F.when(applied & (F.col("kind") == "correct"), F.col("target")).otherwise(F.col("value")).alias("value"),
        outcome.alias("outcome"),
    )
