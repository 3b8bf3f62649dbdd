"""Shared helpers: table reading, text normalisation, bounded batches and join sides."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.scratch import materialize, scratch_scope, tidy  # noqa: F401
from larkspur.sources.scratch import shared_dir as scratch_dir  # noqa: F401

#: Whitespace that separates words in the contracts: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalized(text: Column) -> Column:
    """Lower-cased runs of letters and digits joined by one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of a value's text modulo ``modulus``: the fixed folds of the contracts (null: remainder of an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Bounds the rows of an Arrow batch while an eager step runs, so that long texts fit a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_side(df: DataFrame, array: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """A written table of numbers as a join side: broadcast if its counted size is small, shuffled otherwise.

    The size is 64 bytes a row and 8 for each element of the column ``array``.
    """
    cells = F.coalesce(F.size(array), F.lit(0)) if array else F.lit(0)
    size = df.agg(F.sum(64 + 8 * cells.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df
