"""Year-partitioned JSON manifests: scan and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.sources.scratch import materialize


def write(records: DataFrame, path: str, year: str = "year") -> None:
    """One folder of JSON lines a year; only the years in ``records`` are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).json(path)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of all years with the year of their folder; a record that breaks ``schema`` fails the read.

    A filter on ``year`` prunes folders before anything is opened.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, paths: str | list[str], schema: StructType | str, rows: str = "records") -> DataFrame:
    """Rows of whole-file JSON documents, each an object whose array ``rows`` is exploded; ``file`` is where it came from."""
    documents = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(paths)
    return documents.select(F.col("_metadata.file_path").alias("file"), F.posexplode(rows).alias("row_index", "record")).select("file", "row_index", "record.*")


def digests(records: DataFrame, year: str = "year") -> DataFrame:
    """(partition, rows, digest): a hash of each partition's rows that does not depend on their order; repeats count."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(c for c in records.columns if c != year)), {"ignoreNullFields": "false"}))
    per = records.groupBy(F.col(year).cast("string").alias("partition"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.sum(row.cast("decimal(38,0)")).cast("string"), F.bit_xor(row).cast("string")).alias("digest"))


def changes(records: DataFrame, path: str, year: str = "year") -> DataFrame:
    """(partition, change, rows_before, rows_after): added, changed, removed or same, of what is in ``path`` against ``records``. Writes nothing."""
    spark = records.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    before = digests(read(spark, path, records.schema) if there else records.limit(0), year).toDF("partition", "rows_before", "digest_before")
    joined = before.join(digests(records, year), "partition", "full")
    change = F.when(F.col("digest_before").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.struct("rows_before", "digest_before") == F.struct("rows", "digest"), "same").otherwise("changed")
    return joined.select("partition", change.alias("change"), "rows_before", F.col("rows").alias("rows_after"))


def write_changed(records: DataFrame, path: str, year: str = "year") -> DataFrame:
    """Writes only the partitions of ``records`` that differ from what is in ``path``, deletes those that it lacks, and returns ``changes``.

    Files of partitions that are the same keep their names. ``records`` must hold the whole table and not be read from ``path``; a null
    partition is refused. A partition is replaced as a whole when its job commits, so a lost executor leaves the old one.
    """
    spark = records.sparkSession
    found = materialize(changes(records, path, year), "manifest-changes")
    # one row a partition
    rows = found.where("change <> 'same'").collect()
    if any(r["partition"] is None for r in rows):
        raise ValueError(f"a record has no {year}")
    fresh = [r["partition"] for r in rows if r["change"] in ("added", "changed")]
    if fresh:
        write(records.where(F.col(year).cast("string").isin(fresh)), path, year)
    for r in rows:
        if r["change"] == "removed":
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{year}={r['partition']}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return found


def named_documents(spark: SparkSession, path: str, schema: StructType | str, name: str, rows: str = "entries") -> DataFrame:
    """``read_documents`` of the files below ``path`` whose path from there on matches ``name``; the files of other names are not read."""
    documents = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    below = F.substring_index(F.col("_metadata.file_path"), path.rstrip("/") + "/", -1)
    inside = [c for c in documents.columns if c != rows]
    return documents.select(below.alias("file"), "*").where(F.col("file").rlike(name)).select("file", *inside, F.posexplode_outer(rows).alias("row_index", "entry")).select("file", *inside, "row_index", "entry.*")


def bound_batches(batches: DataFrame, queues: DataFrame) -> DataFrame:
    """Reviewed batches (file, queue, queue_sha256, ...) with ``binding``: ``bound`` to the queue (file, sha256) that they name and whose content they were made for, else ``changed`` or ``missing``.

    Of several queues of one name any with the hash will do. A null queue is missing.
    """
    named = queues.where("file is not null").groupBy(F.col("file").alias("_queue")).agg(F.collect_set("sha256").alias("_hashes"))
    joined = batches.join(named, F.col("queue") == F.col("_queue"), "left")
    binding = F.when(F.col("_queue").isNull(), "missing").when(F.coalesce(F.array_contains("_hashes", F.col("queue_sha256")), F.lit(False)), "bound").otherwise("changed")
    return joined.withColumn("binding", binding).drop("_queue", "_hashes")
