"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.base import SPACE, materialize

#: Hex digits of the document hash in each level of the nested histograms (so a source has 4096 buckets at most); levels; threshold rounds.
DIGITS, LEVELS, ROUNDS = 3, 4, 3
#: Columns that the mix adds.
RESULTS = ("size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in a text, null 0."""
    words = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.when(F.coalesce(F.length(words), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Target of each source: (source, source_size, target), one row per source.

    Sources by code point (null last) get the weights in turn and share all sizes; no target is over
    ``most`` times its source's size, and what that cuts off is shared again by weight. The fixed point is
    min(most * size, level * weight); the level is found from running sums over the sources ordered by
    most * size / weight, so the number of rounds does not matter. The table has one row per source and is
    ordered in one task: some millions of sources at most, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cap = F.lit(most) * F.col("source_size")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "source", "source_size", "weight",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double")
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")).alias("level"),
    )
    # sources up to the first whose cap is above its level are at their cap; that one's level holds for the rest
    free = F.min(F.when(cap > F.col("level") * F.col("weight"), F.struct(cap / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"), F.col("level")))).over(everything)["level"]
    return level.select("source", "source_size", F.coalesce(F.least(cap.cast("double"), free * F.col("weight")), cap.cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, rounds: int = ROUNDS, columns: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those named in ``columns``) with size, source_size, target and taken.

    ``taken`` is a whole number of copies of a document times its size: every document of a source is taken
    floor(target / source_size) times, and once more if its hash is below the source's threshold. The
    threshold comes from nested histograms: words by source and the first three hex digits of the hash, then
    within the boundary bucket alone by the next three, and so on. A long document at the boundary can leave
    much of the target open, so a further round does the same for documents above the threshold that fit
    what is left; the last round takes its boundary bucket too if that is nearer to the target. Texts are
    read once: the rows are written with their size and hash, and thresholds are found from these two alone.

    Nulls: a null text has size 0; a null source is a source of its own (last); a null doc_id is hashed as an
    empty text. The hash covers doc_id and text, so only fully repeated rows share a fate. An empty table gives
    an empty result. Columns of ``docs`` named like the results are replaced.
    """
    kept = [c for c in columns or docs.columns if c not in RESULTS]
    digest = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))), 1, DIGITS * LEVELS)
    rows = materialize(docs.select(*kept, F.col("source").alias("_mix_source"), size_of(F.col("text")).alias("size"), digest.alias("_mix_h")), "mix-rows")
    narrow = rows.select(F.col("_mix_source").alias("row_source"), "size", F.col("_mix_h").alias("h"))
    goal = materialize(targets(narrow.groupBy(F.col("row_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, most), "mix-goal")
    # the plan has one row per source; Spark broadcasts it only below its own size limit
    plan = _thresholds(narrow, goal, rounds).withColumnsRenamed({"source": "_mix_of", "copies": "_mix_copies", "cuts": "_mix_cuts"})
    extra = F.exists("_mix_cuts", lambda c: (F.col("size") <= c["fits"]) & (F.col("_mix_h") < c["below"]))
    joined = rows.join(plan, F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
    return joined.withColumn("taken", F.col("size") * (F.col("_mix_copies") + extra.cast("long"))).select(*kept, *RESULTS)


def _thresholds(narrow: DataFrame, goal: DataFrame, rounds: int) -> DataFrame:
    """Adds copies and cuts to each source: a document of a size that fits and with a hash below gets one copy more.

    The hash limits rise and the sizes fall from round to round, so the rounds' conditions can be joined by OR.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = goal.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("cuts", F.expr("cast(array() as array<struct<fits: double, below: string>>)")).withColumn("from", F.lit(""))
    rows = narrow.where("size > 0")
    for turn in range(1, rounds + 1):
        plan = plan.withColumn("fits", F.col("left") if turn > 1 else F.lit(float("inf"))).withColumn("prefix", F.lit("")).withColumn("edge_words", F.lit(None).cast("long")).withColumn("open", F.col("left") > 0).withColumn("below", F.col("from"))
        for level in range(1, LEVELS + 1):
            within = plan.where("open").select("source", "prefix", "fits", "from")
            found = rows.join(within, F.col("row_source").eqNullSafe(F.col("source")) & F.col("h").startswith(F.col("prefix")) & (F.col("size") <= F.col("fits")) & (F.col("h") >= F.col("from")))
            counted = found.groupBy("row_source", F.substring("h", 1, DIGITS * level).alias("bucket")).agg(F.sum("size").alias("words"))
            running = counted.withColumn("upto", F.sum("words").over(Window.partitionBy("row_source").orderBy("bucket")))
            # the boundary bucket is the first whose running sum passes what is left; without one, all fits
            edge = (
                running.join(plan.where("open").select("source", "left"), F.col("row_source").eqNullSafe(F.col("source")))
                .groupBy("source")
                .agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "words"))).alias("edge"), F.max("upto").alias("all_words"))
                .withColumnRenamed("source", "edge_source")
            )
            hit = F.col("open") & F.col("edge").isNotNull()
            whole = F.col("open") & F.col("edge").isNull() & (F.lit(level) == 1)
            plan = materialize(
                plan.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").select(
                    "source", "source_size", "target", "copies", "cuts", "from", "fits",
                    F.when(hit, F.col("edge.bucket")).otherwise(F.col("prefix")).alias("prefix"),
                    F.when(hit, F.col("left") - (F.col("edge.upto") - F.col("edge.words"))).when(whole, F.col("left") - F.coalesce("all_words", F.lit(0))).otherwise(F.col("left")).alias("left"),
                    F.when(hit, F.col("edge.words")).otherwise(F.col("edge_words")).alias("edge_words"),
                    hit.alias("open"),
                    # 'g' sorts after every hex digit
                    F.when(hit, F.col("edge.bucket")).when(whole, F.lit("g")).otherwise(F.col("below")).alias("below"),
                ),
                "mix-level",
            )
        if turn == rounds:
            nearer = F.col("edge_words").isNotNull() & (F.col("edge_words") - F.col("left") < F.col("left"))
            plan = plan.withColumn("below", F.when(nearer, F.concat("below", F.lit("g"))).otherwise(F.col("below")))
        plan = plan.select("source", "source_size", "target", "copies", "left", F.concat("cuts", F.array(F.struct("fits", "below"))).alias("cuts"), F.col("below").alias("from"))
    return plan.select("source", "source_size", "target", "copies", "cuts")
