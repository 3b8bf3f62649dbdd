"""From candidates to a release: verification batches, attempts by route, progress ledgers, moves that keep history, release selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_summary(results: DataFrame, group: list[str]) -> DataFrame:
    """(group, attempted, verified, rejected, unavailable, status) of results (group, status): complete if all are verified, partial if some are, else failed.

    A status that is none of the three is counted as attempted only.
    """
    s = F.col("status")
    counted = results.groupBy(*group).agg(F.count(F.lit(1)).alias("attempted"), *(F.count_if(s == name).alias(name) for name in ("verified", "rejected", "unavailable")))
    return counted.withColumn("status", F.when(F.col("verified") == F.col("attempted"), "complete").when(F.col("verified") > 0, "partial").otherwise("failed"))


def by_route(attempts: DataFrame, key: str, best: str = "verified") -> DataFrame:
    """(key, route, status, result, tried) of attempts (key, route, status, result): the first ``best`` one by route, else the last one tried.

    Routes are tried in order of their numbers, and none after the first ``best`` one: attempts beyond it do not count as ``tried`` and
    never replace it. Of attempts by one route the smallest status and result count; rows without a key or route are left out.
    """
    known = attempts.where(F.col(key).isNotNull() & F.col("route").isNotNull())
    good = F.coalesce(F.col("status") == best, F.lit(False))
    row = F.struct("route", "status", "result")
    per = known.groupBy(key, "route").agg(F.min(F.struct((~good).alias("worse"), "status", "result")).alias("r")).select(key, "route", "r.*")
    chosen = per.groupBy(key).agg(F.min(F.when(~F.col("worse"), row)).alias("good"), F.max_by(row, "route").alias("last"), F.min(F.when(~F.col("worse"), F.col("route"))).alias("until"))
    tried = per.join(chosen, key).where(F.col("until").isNull() | (F.col("route") <= F.col("until"))).groupBy(key).agg(F.count(F.lit(1)).alias("tried"), F.first(F.coalesce("good", "last")).alias("r"))
    return tried.select(key, "r.route", "r.status", "r.result", "tried")


def ledger(queue: DataFrame, progress: DataFrame, released: DataFrame) -> DataFrame:
    """(code, state, faults) of a queue (code, name_key), its progress (code, disposition, stable_id, approval) and what is released (stable_id, name_key, code, hash).

    Every code of the queue or the progress has a row; ``state`` is the disposition, or null. ``faults`` (array, empty if none) names: a code that is not in the
    queue or not in the progress, stands in either twice, an unknown disposition, an awaiting code with release fields, a
    published one whose id is not released, is released under another name, or whose approval is not the released hash; and
    ``possibly_released`` for an awaiting code whose name or code is released.
    """
    asked = queue.groupBy("code").agg(F.count(F.lit(1)).alias("queued"), F.min("name_key").alias("name_key"))
    rows = progress.groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.min("disposition").alias("disposition"), F.min("stable_id").alias("stable_id"), F.min("approval").alias("approval"))
    record = released.where("stable_id is not null").groupBy(F.col("stable_id").alias("released_id")).agg(F.min(F.struct("name_key", "hash")).alias("record"))
    # equi-joins with distinct keys: nothing is multiplied
    names = released.where("name_key is not null").select(F.col("name_key").alias("known_name")).distinct().withColumn("by_name", F.lit(True))
    codes = released.where("code is not null").select(F.col("code").alias("known_code")).distinct().withColumn("by_code", F.lit(True))
    joined = asked.join(rows, "code", "full").join(record, F.col("stable_id") == F.col("released_id"), "left")
    joined = joined.join(names, F.col("name_key") == F.col("known_name"), "left").join(codes, F.col("code") == F.col("known_code"), "left")
    d = F.col("disposition")
    published, awaiting = F.coalesce(d == "published", F.lit(False)), F.coalesce(d == "awaiting", F.lit(False))
    faults = {
        "not_in_queue": F.col("queued").isNull(),
        "not_in_progress": F.col("rows").isNull(),
        "repeated": (F.col("queued") > 1) | (F.col("rows") > 1),
        "unknown_disposition": F.col("rows").isNotNull() & ~published & ~awaiting,
        "awaiting_has_release_fields": awaiting & (F.col("stable_id").isNotNull() | F.col("approval").isNotNull()),
        "not_released": published & F.col("released_id").isNull(),
        "released_under_other_name": published & F.col("released_id").isNotNull() & ~F.col("record.name_key").eqNullSafe(F.col("name_key")),
        "approval_mismatch": published & F.col("released_id").isNotNull() & ~F.coalesce(F.col("record.hash") == F.col("approval"), F.lit(False)),
        "possibly_released": awaiting & (F.col("by_name").isNotNull() | F.col("by_code").isNotNull()),
    }
    return joined.select("code", d.alias("state"), F.array_compact(F.array(*(F.when(bad, name) for name, bad in faults.items()))).alias("faults"))


def history_row(name: str, before: Column, after: Column, at: Column) -> Column:
    """A row of a correction history: struct(field, before, after, at), values as texts."""
    return F.struct(F.lit(name).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"), at.alias("at"))


def moved(registry: DataFrame, moves: DataFrame, fields: list[str]) -> DataFrame:
    """The registry (id, partition, ``fields``, history) after moves (id, expected, target, fields, at), with their outcome.

    A move applies where the record stands in the ``expected`` partition: it then stands in ``target``, its fields are those of the move where these
    are not null, and its history gets a row for the partition and each field that changes; what it held before stays. Where it
    stands in ``target`` with the move's fields already it is ``already``; anything else, and a record with several moves, is ``refused``; a record without
    a move is ``untouched``, a move without a record ``unknown``.
    """
    new = moves.groupBy("id").agg(F.count(F.lit(1)).alias("_times"), F.min(F.struct("expected", "target", "at", *fields)).alias("_m"))
    joined = registry.join(new, "id", "full")
    wanted = {f: F.coalesce(F.col(f"_m.{f}"), F.col(f)) for f in fields}
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(wanted[f])
    here = F.col("partition")
    outcome = (
        F.when(F.col("_m").isNull(), "untouched")
        .when(here.isNull(), "unknown")
        .when(F.col("_times") > 1, "refused")
        .when((here == F.col("_m.target")) & same, "already")
        .when(here == F.col("_m.expected"), "applied")
        .otherwise("refused")
    )
    judged = joined.withColumn("outcome", outcome)
    done = F.col("outcome") == "applied"
    rows = [F.when(here != F.col("_m.target"), history_row("partition", here, F.col("_m.target"), F.col("_m.at")))]
    rows += [F.when(~F.col(f).eqNullSafe(wanted[f]), history_row(f, F.col(f), wanted[f], F.col("_m.at"))) for f in fields]
    history = F.when(done, F.concat("history", F.array_compact(F.array(*rows)))).otherwise(F.col("history"))
    return judged.select("id", F.when(done, F.col("_m.target")).otherwise(here).alias("partition"), *(F.when(done, wanted[f]).otherwise(F.col(f)).alias(f) for f in fields), history.alias("history"), "outcome")


def selection(manifests: DataFrame, most: int = 15) -> DataFrame:
    """(release, name, hash, reason) of manifests (release, name, content): those of a release, with the hash of their content.

    ``reason`` is null for what can be released; ``repeated`` for a name that a release has twice, ``same_content`` for one of several names of one content, ``too_many``
    for all of a release of more than ``most`` manifests, ``empty`` for no content.
    """
    hashed = manifests.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    per = hashed.groupBy("release").agg(F.count(F.lit(1)).alias("_all"))
    names = hashed.groupBy("release", "name").agg(F.count(F.lit(1)).alias("_times"), F.min("hash").alias("hash"))
    contents = names.where("hash is not null").groupBy("release", "hash").agg(F.count(F.lit(1)).alias("_alike"))
    joined = names.join(per, "release").join(contents, ["release", "hash"], "left")
    reason = F.when(F.col("_all") > most, "too_many").when(F.col("_times") > 1, "repeated").when(F.col("hash").isNull(), "empty").when(F.col("_alike") > 1, "same_content")
    return joined.select("release", "name", "hash", reason.alias("reason"))
