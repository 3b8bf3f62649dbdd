"""Centroid clustering of integer vectors with subvector dictionaries.

Vectors are held in chunks. In a chunk, each block of dimensions is dictionary-encoded: its distinct subvectors once, and
a code for each vector. A round computes the exact distance of each distinct subvector to each centroid's part once; a
vector's distance is the sum of its codes' partial distances. Nothing is lost or rounded.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.base import arrow_rows, materialize

#: Dimensions of a block, vectors of a chunk (codes take two bytes), and components up to which squared distances fit a long.
BLOCK, CHUNK, SAFE = 2, 8192, 1 << 27


def quantized(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component x as double; only vectors of ``width`` components, all of them finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size("embedding") == width) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def encoded(vectors: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """A written table of chunks of vectors (vec_id, v): (ids, words, codes).

    ``words[b]`` holds the distinct subvectors of block b as 8-byte integers end to end, ``codes[b]`` each vector's place
    among them in two bytes. Chunks are Arrow batches of at most CHUNK vectors, so no vector is shuffled.
    """

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch["v"].flatten().to_numpy().reshape(-1, width)
            words, codes = [], []
            for at in range(0, width, block):
                part, code = np.unique(rows[:, at : at + block], axis=0, return_inverse=True)
                words.append(part.astype("<i8").tobytes())
                codes.append(code.ravel().astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))], ["ids", "words", "codes"])

    with arrow_rows(vectors.sparkSession, CHUNK):
        return materialize(vectors.mapInArrow(encode, "ids array<long>, words array<binary>, codes array<binary>"), "vector-chunks")


def chunks_of(batch: pa.RecordBatch, width: int, block: int = BLOCK):
    """Yields (ids, [(distinct subvectors, codes)]) of the chunks of a batch; Python integers where a squared distance may not fit a long."""
    for ids, words, codes in zip(batch["ids"], batch["words"].to_pylist(), batch["codes"].to_pylist()):
        parts = [np.frombuffer(w, "<i8").reshape(-1, min(block, width - b * block)) for b, w in enumerate(words)]
        large = any(p.max() >= SAFE or p.min() < -SAFE for p in parts)
        yield ids.values, [(p.astype(object) if large else p, np.frombuffer(c, "<u2")) for p, c in zip(parts, codes)]


def nearest(blocks, centroids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (of equal ones the first) and its squared distance."""
    total = 0
    for b, (words, codes) in enumerate(blocks):
        gap = words[:, None, :] - centroids[None, :, b * block : (b + 1) * block]
        total = total + (gap * gap).sum(2)[codes]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(cluster)), cluster]


def sums_of(blocks, cluster: np.ndarray, k: int) -> list[list[int]]:
    """Exact componentwise sums of the vectors of each cluster: how often a cluster has a subvector, times the subvector."""
    out = []
    for words, codes in blocks:
        often = np.bincount(cluster * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
        out.append(often.astype(words.dtype) @ words)
    return np.hstack(out).tolist()


def moved(chunks: DataFrame, centroids: np.ndarray, width: int, block: int = BLOCK) -> np.ndarray:
    """The centroids after one round: the floor of each non-empty cluster's mean. Each task adds up its own chunks first."""
    k = len(centroids)

    def add(batches):
        sums, counts = [[0] * width for _ in range(k)], np.zeros(k, np.int64)
        for batch in batches:
            for _, blocks in chunks_of(batch, width, block):
                cluster = nearest(blocks, centroids, block)[0]
                counts += np.bincount(cluster, minlength=k)
                sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, sums_of(blocks, cluster, k))]
        rows = [i for i in range(k) if counts[i]]
        # sums as text, as they may exceed a long
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(counts[rows], pa.int64()), pa.array([[str(x) for x in sums[i]] for i in rows], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    with arrow_rows(chunks.sparkSession, 4):
        parts = chunks.mapInArrow(add, "cluster int, n long, sums array<string>")
        total = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    after = centroids.copy()
    # one row for each cluster and dimension
    for r in total:
        after[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return after


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors (vec_id, embedding).

    Vectors that are null, of another length than ``width``, or hold a null, NaN or infinity have no row; components are floor(scale * x),
    at the ends of a long where they exceed it. The first centroids are the ``k`` vectors of smallest sha256 of
    ``seed:vec_id`` (a null vec_id counts as an empty text; of equal hashes the smaller vector), all vectors if fewer. After the
    rounds every vector is assigned once more. Repeated rows count each. An empty table has no rows. Distances and inertias
    beyond a long are reported as its largest value. The centroids, k x width numbers, are all that passes the driver.
    """
    spark = vectors.sparkSession
    kept = quantized(vectors, width, scale)
    first = kept.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256).alias("hash"))
    centroids = np.array([r["v"] for r in first.orderBy("hash", "v").limit(k).collect()], np.int64).reshape(-1, width)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    if np.abs(centroids.astype(object)).max() >= SAFE:
        centroids = centroids.astype(object)
    chunks = encoded(kept, width, block)
    for _ in range(rounds):
        centroids = moved(chunks, centroids, width, block)
    most = (1 << 63) - 1

    def assign(batches):
        for batch in batches:
            for ids, blocks in chunks_of(batch, width, block):
                found, distance = nearest(blocks, centroids, block)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(np.minimum(distance, most).astype(np.int64))], ["vec_id", "cluster", "distance"])

    with arrow_rows(spark, 4):
        assigned = materialize(chunks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned-vectors")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(inertia.values()), most)
    facts = [(i, min(inertia.get(i, 0), most), whole, sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # one row a cluster
    return assigned.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(*(x.split()[0] for x in schema.split(", ")))
