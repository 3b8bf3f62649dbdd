"""Ordered folds of batches into a registry: a later row sees what earlier ones inserted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.scratch import materialize


def _keys(keys: list[str]) -> Column:
    """A row's non-null keys as texts, each with its kind in front."""
    return F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys)))


def batch_fold(registry: DataFrame, batches: DataFrame, keys: list[str], identity: list[str], facts: list[str]) -> DataFrame:
    """(batch, seq, id, outcome, hit) of folding batches (batch, seq, id, partition, keys, facts) into a registry (id, partition, keys, facts).

    Rows are taken by batch, then seq, then id. A row that shares no non-null key (``id`` is one) with the registry or a row
    added before it is ``added``. Any other row changes nothing: with exactly one record hit, of the same partition, ``identity`` columns equal
    where the record has them, it is ``present`` if all facts are equal, else ``held_existing``; else it is ``held_conflict``. ``hit`` is
    the id of the one record hit. Null keys match nothing; rows without a key are added. Of fully repeated rows the first decides.

    Which rows are added is a greedy choice in order, made in rounds instead of one row after another: a row that is
    the first undecided one of all its keys is added, rows that share a key with it are out, and the rest go on. A round is
    grouped minima and joins by key, so a key that most rows share is decided in two rounds and no group meets in one
    task; there are as many rounds as the longest chain of rows of which each waits for the one before.
    """
    keys = ["id", *(k for k in keys if k != "id")]
    held = [c for c in dict.fromkeys(["partition", *keys, *identity, *facts])]
    # rows are numbered in their order, so that a number is all that is carried of it
    entries = batches.select("batch", "seq", *held).orderBy("batch", "seq", "id").withColumn("row", F.monotonically_increasing_id())
    entries = materialize(entries, "fold-entries")
    known = registry.select(*held, F.explode(_keys(keys)).alias("key"))
    # a key's records as one row: how many, and the one if it is alone
    known = materialize(known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*held)).alias("record")), "fold-registry")

    asked = lambda rows: rows.select("row", F.explode(_keys(keys)).alias("key"))
    met = asked(entries).join(known, "key").groupBy("row").agg(F.max("n").alias("most"), F.collect_set("record").alias("records"))
    met = materialize(met, "fold-met")
    open_rows = materialize(asked(entries.join(met, "row", "left_anti")), "fold-open")
    added = [entries.where(F.size(_keys(keys)) == 0).select("row")]
    while not open_rows.isEmpty():
        firsts = open_rows.groupBy("key").agg(F.min("row").alias("first"))
        lead = open_rows.join(firsts, "key").groupBy("row").agg(F.bool_and(F.col("row") == F.col("first")).alias("leads")).where("leads").select("row")
        lead = materialize(lead, "fold-added")
        added.append(lead)
        taken = open_rows.join(lead, "row", "left_semi").select("key").distinct()
        out = open_rows.join(taken, "key", "left_semi").select("row").distinct()
        open_rows = materialize(open_rows.join(out, "row", "left_anti"), "fold-open")

    new = materialize(entries.join(reduce(DataFrame.unionByName, added), "row"), "fold-new")
    # added rows share no key, so a key has one of them at most
    grown = new.select(F.explode(_keys(keys)).alias("key"), F.col("row").alias("since"), F.struct(*held).alias("grown"))
    rest = entries.join(new.select("row"), "row", "left_anti")
    later = asked(rest).join(grown, "key").where("since < row").groupBy("row").agg(F.collect_set("grown").alias("grown"))
    # one or two records for each of a row's few keys
    hits = [F.coalesce(c, F.slice(F.array(F.struct(*held)), 1, 0)) for c in ("records", "grown")]
    found = rest.join(met, "row", "left").join(later, "row", "left").withColumns({"most": F.coalesce("most", F.lit(0)), "records": F.array_distinct(F.concat(*hits))})
    one = (F.col("most") <= 1) & (F.size("records") == 1)
    record = F.get("records", F.lit(0))
    agrees = record["partition"].eqNullSafe(F.col("partition"))
    for c in identity:
        agrees = agrees & (record[c].isNull() | record[c].eqNullSafe(F.col(c)))
    same = reduce(lambda a, b: a & b, (record[c].eqNullSafe(F.col(c)) for c in facts), F.lit(True))
    outcome = F.when(one & agrees, F.when(same, "present").otherwise("held_existing")).otherwise("held_conflict")
    decided = found.select("batch", "seq", "id", outcome.alias("outcome"), F.when(one, record["id"]).alias("hit"))
    return decided.unionByName(new.select("batch", "seq", "id", F.lit("added").alias("outcome"), F.lit(None).cast(entries.schema["id"].dataType).alias("hit")))
