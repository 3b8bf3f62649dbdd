"""Streams into keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_table(stream: DataFrame, keys: list[str], order: list[str], path: str, merge_every: int = 10) -> DataFrame:
    """Runs ``stream`` over all that is there into a table of each key's latest row under ``path``, and reads the table.

    Each micro-batch writes its own latest rows once, under its batch id, so a repeated batch overwrites itself;
    the newest row of a key over all parts is the table's. After every ``merge_every`` batches the parts are
    merged into one, which a repeat of the merge does not change, so a reader meets few parts however long the
    stream runs. Late and repeated rows change nothing they should not.
    """
    spark = stream.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def newest(rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)).alias("row"))
        return best.select(*keys, "row.*")

    def table() -> DataFrame:
        return newest(spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/rows/batch-{batch_id}")
        if batch_id % merge_every == merge_every - 1:
            merged = [part.getPath() for part in files.listStatus(root)]
            table().write.parquet(f"{path}/rows/merged-{uuid.uuid4().hex}")
            for part in merged:
                files.delete(part, True)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return table()


def windowed_counts(stream: DataFrame, clock: str, key: str, width: str, late: str) -> DataFrame:
    """Counts of each key by tumbling window of event time, with rows later than ``late`` left out (an extension)."""
    return stream.withWatermark(clock, late).groupBy(F.window(clock, width), key).agg(F.count(F.lit(1)).alias("n"))
