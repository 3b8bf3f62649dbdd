"""Proposals against a partitioned registry of documents: each applies or is refused, and an identity changes everywhere or nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.components import components
from larkspur.operators.nested import canonical, depth_of, merged
from larkspur.sources.scratch import materialize


def staged(records: DataFrame, proposals: DataFrame) -> DataFrame:
    """(partition, id, kind, bundle, outcome, conflicts, current, document): what each proposal would do on its own.

    ``add`` applies where the record is absent; ``remove`` where it is as ``before`` says; ``change`` merges before -> after into the record
    and applies if the merge changes it. A proposal whose work is done is ``already``, any other ``conflict``. Several
    proposals for one record in one partition are ``repeated``: none of them applies. Rows without proposals have a null kind.
    """
    now = records.where("partition is not null and id is not null").groupBy("partition", "id").agg(F.max(canonical(F.col("document"))).alias("current"))
    asked = proposals.where("partition is not null and id is not null").groupBy("partition", "id").agg(F.count(F.lit(1)).alias("times"), F.min("kind").alias("kind"), F.min("bundle").alias("bundle"), F.max(canonical(F.col("before"))).alias("before"), F.max(canonical(F.col("after"))).alias("after"))
    joined = materialize(now.join(asked, ["partition", "id"], "full"), "staged-proposals")
    c, b, a = (F.col(n) for n in ("current", "before", "after"))
    change = merged(c, b, a, depth_of(joined, "current", "before", "after"))
    rows = joined.withColumn("m", F.when((F.col("kind") == "change") & c.isNotNull(), change))
    done = F.when(F.col("m.applied") > 0, "applied").when(F.col("m.conflicts") > 0, "conflict").otherwise("already")
    outcome = (
        F.when(F.col("times") > 1, "repeated")
        .when(F.col("kind") == "add", F.when(c.isNull(), "applied").when(c == a, "already").otherwise("conflict"))
        .when(F.col("kind") == "remove", F.when(c.isNull(), "already").when(c.eqNullSafe(b), "applied").otherwise("conflict"))
        .when(F.col("kind") == "change", F.when(c.isNull(), "conflict").otherwise(done))
    )
    rows = rows.withColumn("outcome", outcome)
    applied = F.col("outcome") == "applied"
    document = F.when(applied & (F.col("kind") == "add"), a).when(applied & (F.col("kind") == "remove"), F.lit(None)).when(applied, F.col("m.document")).otherwise(c)
    conflicts = F.when(F.col("outcome").isin("conflict", "repeated"), F.greatest(F.coalesce("m.conflicts", F.lit(1)), F.lit(1))).otherwise(F.coalesce("m.conflicts", F.lit(0)))
    return rows.select("partition", "id", "kind", "bundle", "outcome", conflicts.cast("long").alias("conflicts"), "current", document.alias("document"))


def apply_proposals(records: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outcomes (partition, id, kind, bundle, outcome, conflicts) of proposals, and the records (partition, id, document) after them.

    Records are (partition, id, document), proposals (partition, id, kind, before, after, bundle) with JSON documents. An id that
    would stand in several partitions is rolled back: its proposals are ``rolled_back`` in all partitions and its records stay as they were; so are the
    proposals of an id that stands in several partitions already. Proposals of one non-null ``bundle`` hold together: if one is
    refused or rolled back, so are all, with every other proposal of their ids and the bundles of those, to the end of the chain.
    """
    rows = materialize(staged(records, proposals), "staged-rows")
    here = rows.groupBy("id").agg(
        (F.count("document") > 1).alias("twice"),
        (F.count("current") > 1).alias("was_twice"),
        F.bool_or(F.col("outcome").isin("conflict", "repeated") & F.col("bundle").isNotNull()).alias("refused"),
    )
    bad = materialize(here.where("twice or was_twice or refused").select("id"), "bad-identities")
    # ids and bundles that hold together, each kind of node with its own mark
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    ties = rows.where("bundle is not null").select(name("i", "id").alias("a"), name("b", "bundle").alias("b"))
    parts = materialize(components(ties), "bundled-identities")
    bad_parts = parts.join(bad.select(name("i", "id").alias("node")), "node", "left_semi").select("component").distinct()
    fallen = parts.join(bad_parts, "component", "left_semi").select("node")
    back = rows.select("id").distinct().join(fallen, name("i", "id") == F.col("node"), "left_semi").unionByName(bad).distinct().withColumn("back", F.lit(True))
    judged = materialize(rows.join(back, "id", "left").withColumn("back", F.coalesce("back", F.lit(False))), "judged-proposals")
    outcome = F.when(F.col("back") & F.col("outcome").isin("applied", "already"), "rolled_back").otherwise(F.col("outcome"))
    outcomes = judged.where("kind is not null").select("partition", "id", "kind", "bundle", outcome.alias("outcome"), "conflicts")
    after = judged.select("partition", "id", F.when(F.col("back"), F.col("current")).otherwise(F.col("document")).alias("document")).where("document is not null")
    return outcomes, after
