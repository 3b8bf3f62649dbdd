"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The given tables of one directory, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out over all cores, evenly or by keys, before work that takes long for its size.

    A table may be one file with one row group, which one task reads. Explode what is made of the rows by ``explode_outer``: for
    a plain one the optimizer infers a filter, which computes the same again, and before the rows are dealt out.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def named(key: str, name: str) -> Column:
    """A name with a company suffix by key, so that name keys have something to do."""
    k = F.col(key) % 6
    suffix = F.when(k == 0, " Ltd").when(k == 1, " Limited").when(k == 2, " & Sons Pvt. Ltd.").when(k == 3, " (India) Limited").when(k == 4, " (formerly known as Old Co) Ltd").otherwise("")
    return F.concat(F.col(name), suffix)


def named_sql(key: str, name: str) -> str:
    return f"({name} || CASE {key} % 6 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Limited' WHEN 2 THEN ' & Sons Pvt. Ltd.' WHEN 3 THEN ' (India) Limited' WHEN 4 THEN ' (formerly known as Old Co) Ltd' ELSE '' END)"
