"""WARC records and a Merkle fixity audit of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.base import materialize

#: Bytes of the ordered offset range of a lowest node, and how many ranges a node above joins.
RANGE, FAN = 1 << 16, 16


def record(url: Column, record_id: Column, body: Column) -> Column:
    """A WARC/1.0 resource record (binary) with its header, content length and closing blank lines."""
    payload = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))


def stored(records: DataFrame, files: int, name: str = "warc-records") -> DataFrame:
    """(row, file, key, digest, length, data) from (key, data): records written once, dealt to ``files`` files by a number of their own.

    A record's number comes from its place in the input when it is written, so equal rows are spread over the
    files and no file is fuller than another, however often a row repeats.
    """
    numbered = records.select(F.monotonically_increasing_id().alias("row"), "key", "data")
    dealt = numbered.withColumn("file", F.pmod(F.xxhash64("row"), F.lit(files)).cast("int")).withColumn("digest", F.sha2("data", 256)).withColumn("length", F.octet_length("data").cast("long"))
    return materialize(dealt.select("row", "file", "key", "digest", "length", "data"), name)


def places(records: DataFrame) -> DataFrame:
    """(row, file, key, offset, length) of stored records, in order of key and digest within a file.

    Offsets are running sums of lengths, so the number of files bounds the rows that are ordered in one place;
    payloads are not read.
    """
    before = Window.partitionBy("file").orderBy(F.col("key").isNull(), "key", "digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    return records.select("row", "file", "key", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def lay_out(records: DataFrame, files: int) -> DataFrame:
    """(file, offset, length, key, data) from (key, data): the content of WARC files. Null data takes no byte.

    Runs a job when called: the records are written, and their places joined to them by number.
    """
    kept = stored(records.withColumn("data", F.coalesce("data", F.lit("").cast("binary"))), files)
    return kept.select("row", "data").join(places(kept), "row").select("file", "offset", "length", "key", "data")


def leaves(replica: DataFrame) -> DataFrame:
    """(file, offset, length, hash) of each record of a replica (file, offset, length, data); null data hashes as empty."""
    return replica.select("file", "offset", "length", digest_of(F.col("data")).alias("hash"))


def digest_of(data: Column) -> Column:
    return F.sha2(F.coalesce(data, F.lit("").cast("binary")), 256)


def level(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes over ordered ranges of ``span`` bytes of a file: (file, start, hash) of the hashes of the nodes (file, start, hash) below."""
    place = F.floor(F.col("start") / span) * span
    below = F.sort_array(F.collect_list(F.struct("start", "hash")))
    joined = F.array_join(F.transform(below, lambda x: F.concat_ws(":", x["start"].cast("string"), x["hash"])), "|")
    return nodes.groupBy("file", place.alias("up")).agg(F.sha2(joined, 256).alias("hash")).withColumnRenamed("up", "start")


def tree(records: DataFrame, name: str) -> list[DataFrame]:
    """The levels of a tree over the hashed records (file, offset, length, hash) of a replica, records first: each file's ranges of RANGE bytes, then FAN of them, up to one root a file.

    A range is part of a record's place, not of its rank, so a lost record changes only the nodes above it.
    A node's children are bounded by its range: at most RANGE bytes of records, then FAN nodes.
    """
    base = materialize(records, f"{name}-leaves")
    longest = base.agg(F.max("offset")).first()[0] or 0
    levels, span = [base], RANGE
    # of equal offsets (repeated rows) the length and hash put an order in the node
    nodes = base.select("file", F.col("offset").alias("start"), F.concat_ws("/", F.col("length").cast("string"), "hash").alias("hash"))
    while True:
        nodes = materialize(level(nodes, span), f"{name}-level")
        levels.append(nodes)
        if span > longest:
            return levels
        span *= FAN


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Records on which two replicas (file, offset, length, data) differ, as ``audit_leaves``."""
    return audit_leaves(leaves(one), leaves(other))


def audit_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """Records on which two replicas' hashed records (file, offset, length, hash) differ: (file, offset, length, hash, other_length, other_hash).

    Roots are compared file by file; only below nodes that differ are the next level's nodes compared, down to the
    records, so equal branches are read no further than their roots. A record that one replica lacks, or all of a
    file that one replica lacks, has nulls on its side. Repeated rows of one place are compared as a set. Empty
    replicas differ in nothing. Rows with a null file or offset have no place and take no part. Runs its jobs when called.
    """
    a, b = (tree(x.where("file is not null and offset is not null"), n) for x, n in ((one, "one"), (other, "other")))
    while len(a) < len(b):  # the shorter file's root stands for its ranges above
        a.append(materialize(level(a[-1], RANGE * FAN ** (len(a) - 1)), "one-level"))
    while len(b) < len(a):
        b.append(materialize(level(b[-1], RANGE * FAN ** (len(b) - 1)), "other-level"))
    suspect = None
    for depth in range(len(a) - 1, 0, -1):
        left, right = a[depth].toDF("file", "start", "hash"), b[depth].toDF("file", "start", "other_hash")
        if suspect is not None:
            up = (F.floor(F.col("start") / (RANGE * FAN**depth)) * (RANGE * FAN**depth)).alias("up")
            left, right = (x.withColumn("up", up).join(suspect, ["file", "up"], "left_semi").drop("up") for x in (left, right))
        differ = left.join(right, ["file", "start"], "full").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
        suspect = materialize(differ.select("file", F.col("start").alias("up")), "suspect")
    up = (F.floor(F.col("offset") / RANGE) * RANGE).alias("up")
    left, right = (x.withColumn("up", up).join(suspect, ["file", "up"], "left_semi").drop("up").distinct() for x in (a[0], b[0]))
    right = right.toDF("file", "offset", "other_length", "other_hash")
    matched = left.join(right, (left["file"] == right["file"]) & (left["offset"] == right["offset"]) & (left["length"] == right["other_length"]) & (left["hash"] == right["other_hash"]), "left_anti")
    unmatched = right.join(left, (left["file"] == right["file"]) & (left["offset"] == right["offset"]) & (left["length"] == right["other_length"]) & (left["hash"] == right["other_hash"]), "left_anti")
    return matched.join(unmatched, ["file", "offset"], "full")


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, offset, length, data) of the records of uncompressed WARC files, each read as one bounded file.

    Records are found by their Content-Length, so a payload may contain anything. A record cut short by the
    file's end has the bytes that are there.
    """
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                rows, at = [], 0
                while at < len(content):
                    body = content.find(b"\r\n\r\n", at)
                    sizes = [int(line.split(b":")[1]) for line in content[at : max(body, at)].split(b"\r\n") if line.lower().startswith(b"content-length:")]
                    stop = min(len(content), body + 8 + sizes[0]) if body >= 0 and sizes else len(content)
                    rows.append((path, at, stop - at, content[at:stop]))
                    at = stop
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "offset", "length", "data"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(parse, "file string, offset long, length long, data binary")
