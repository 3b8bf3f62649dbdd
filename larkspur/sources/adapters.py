"""Sources of different shapes read into one schema of observations, with what was left out and what is missing."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of an observation beside its source and row.
FIELDS = {"issuer_name": "string", "code": "string", "board": "string", "outcome": "string", "observation_date": "date"}


@dataclass(frozen=True)
class Adapter:
    """How a source's rows become observations.

    ``row`` names a row. ``fields`` are expressions for some of FIELDS, others are null. ``refuses`` are (reason, condition, detail):
    the first condition that holds excludes a row. ``gaps`` are (name, condition over the source's counts ``raw``, ``kept``, ``excluded`` and
    its map ``reasons``).
    """

    source: str
    row: Column
    fields: dict[str, Column]
    refuses: tuple[tuple[str, Column, Column], ...] = ()
    gaps: tuple[tuple[str, Column], ...] = field(default_factory=tuple)


def _read(adapter: Adapter, rows: DataFrame, window: tuple[Column, Column] | None) -> DataFrame:
    """Every row of a source with its fields, and the reason and detail of its exclusion if it has one."""
    values = [F.coalesce(adapter.fields.get(name, F.lit(None)).cast(kind), F.lit(None).cast(kind)).alias(name) for name, kind in FIELDS.items()]
    reasons = [F.when(condition, F.struct(F.lit(name).alias("reason"), detail.cast("string").alias("detail"))) for name, condition, detail in adapter.refuses]
    read = rows.select(F.lit(adapter.source).alias("source"), adapter.row.cast("string").alias("row"), *values, F.coalesce(*reasons, F.lit(None).cast("struct<reason:string,detail:string>")).alias("own"))
    date = F.col("observation_date")
    common = [F.col("own")]
    if window is not None:
        common.append(F.when((date < window[0]) | (date > window[1]), F.struct(F.lit("outside_window").alias("reason"), date.cast("string").alias("detail"))))
    # a name without a letter or digit names nobody
    named = F.coalesce(F.col("issuer_name").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    common.append(F.when(~named, F.struct(F.lit("missing_issuer_identity").alias("reason"), F.col("issuer_name").alias("detail"))))
    return read.withColumn("out", F.coalesce(*common)).drop("own")


def observe(sources: list[tuple[Adapter, DataFrame]], window: tuple[Column, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, exclusions, gaps) of sources, each an adapter and its rows.

    Observations have source, row and FIELDS; exclusions (source, row, reason, detail) hold every other row, so the two make up the
    source; gaps (source, gap) say what a source cannot show: ``no_rows`` for one without rows, ``nothing_kept`` for one of
    which all is excluded, and the adapter's own. Rows outside ``window`` and rows without a name are excluded after the adapter's own
    reasons. Repeated rows are observations of their own.
    """
    read = reduce(DataFrame.unionByName, (_read(adapter, rows, window) for adapter, rows in sources))
    kept = read.where("out is null").drop("out")
    excluded = read.where("out is not null").select("source", "row", "out.reason", "out.detail")
    # a few reasons for each source; sources without rows are named by their adapters
    per = read.groupBy("source", F.col("out.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("source").agg(F.sum("n").alias("raw"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"), F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("reasons"))
    names = kept.sparkSession.createDataFrame([(a.source,) for a, _ in sources], "source string")
    counts = names.join(counts, "source", "left").select("source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("raw", "kept")), F.coalesce("reasons", F.expr("cast(map() as map<string, bigint>)")).alias("reasons"))
    counts = counts.withColumn("excluded", F.col("raw") - F.col("kept"))
    own = [F.when((F.col("source") == a.source) & condition, gap) for a, _ in sources for gap, condition in a.gaps]
    found = F.array_compact(F.array(F.when(F.col("raw") == 0, "no_rows"), F.when((F.col("raw") > 0) & (F.col("kept") == 0), "nothing_kept"), *own))
    return kept, excluded, counts.select("source", F.explode(found).alias("gap"))


def roll_up(observations: DataFrame, key: Column) -> DataFrame:
    """(key, observations, sources, codes, boards, first_date, last_date, outcome) of observations by identity.

    Codes and boards are sorted distinct lists, short as an identity has few; the outcome is the one that all give, else ``conflict``, null where none gives any.
    """
    per = observations.withColumn("key", key).where("key is not null").groupBy("key")
    outcome = F.when(F.count_distinct("outcome") <= 1, F.min("outcome")).otherwise("conflict")
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return per.agg(F.count(F.lit(1)).alias("observations"), distinct("source").alias("sources"), distinct("code").alias("codes"), distinct("board").alias("boards"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"), outcome.alias("outcome"))
