"""Exact top-k inner products: bounds from segment means and deviations, coarse to fine, then exact scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.base import arrow_rows, materialize

#: Rows of a block of candidates and of a chunk of queries, about; blocks whose bounds meet a chunk of queries in one place.
CANDIDATES, QUERIES, SUMMARIES = 8192, 1024, 4096
#: Segments of each resolution, coarse to fine.
RESOLUTIONS = (4, 16)
#: Vectors of the sample that cells are formed around, at most.
PIVOTS = 1024


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component x as double; vectors that are null or hold a null, NaN or infinity are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def segment_statistics(rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of each row's segments (weighted by the root of the segment's length)."""
    cuts = np.unique(np.linspace(0, rows.shape[1], min(segments, rows.shape[1]) + 1).astype(int))
    size = np.diff(cuts)
    mean = np.add.reduceat(rows, cuts[:-1], axis=1) / size
    square = np.add.reduceat(rows * rows, cuts[:-1], axis=1) / size
    return mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean, 0)) * np.sqrt(size)


def statistics_of(rows: np.ndarray) -> list[np.ndarray]:
    """Segment means and deviations side by side, for each resolution that the vectors are long enough for."""
    return [np.hstack(segment_statistics(rows.astype(np.float64), s)) for s in RESOLUTIONS if 0 < s <= rows.shape[1]]


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows of a block, all of them if fewer, ties to the smaller id.

    Within a segment an inner product is at most length * (mean * mean + deviation * deviation), as the squared
    distance is at least length * (difference of means ** 2 + difference of deviations ** 2). Rows whose bound at
    the coarse resolution is below the k-th best score among the rows first tried, or the query's ``floors`` if that
    is more, fall out, the rest are bounded at the next resolution, and what is left gets its exact score.
    Bounds carry a margin for rounding.
    """
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    exact = (lambda a, b: np.einsum("ij,j->i", a.astype(object), b.astype(object))) if largest >= 2**62 else (lambda a, b: np.einsum("ij,j->i", a, b))
    statistics = list(zip(statistics_of(queries), statistics_of(rows)))
    margin = 1e-9 * largest + 1e-6
    out: list[tuple[int, int, int]] = []
    coarse = np.einsum("ij,kj->ik", *statistics[0], optimize=True) if statistics else np.full((len(queries), len(rows)), np.inf)
    for i, query_id in enumerate(query_ids):
        bound, own = coarse[i], ids != query_id
        floor = -np.inf if floors is None else floors[i]
        if own.sum() > k:
            tried = np.argpartition(np.where(own, -bound, np.inf), k - 1)[:k]
            floor = max(floor, min(int(x) for x in exact(rows[tried], queries[i])))
        left = np.flatnonzero(own & (bound >= floor - margin))
        for sq, sr in statistics[1:]:
            left = left[np.einsum("ij,j->i", sr[left], sq[i]) >= floor - margin]
        score = exact(rows[left], queries[i])
        order = np.lexsort((ids[left], -score.astype(np.float64))) if largest < 2**53 else sorted(range(len(left)), key=lambda j: (-int(score[j]), int(ids[left[j]])))
        out += [(int(query_id), int(ids[left[j]]), int(score[j])) for j in order[:k]]
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def blocks_of(vectors: DataFrame, count: int, width: int) -> DataFrame:
    """A written table of blocks of like vectors: (block, ids, values, least, most).

    Cells are formed around a sample of at most PIVOTS vectors by coarse statistics, and cut by a hash of the row's number into
    blocks of about CANDIDATES vectors, so equal vectors and repeated rows are spread. ``values`` are the vectors end to end, short ones
    padded with zeros, ``least`` and ``most`` the smallest and largest of each statistic of all resolutions.
    """
    spark = vectors.sparkSession
    # a bounded sample, of which only the coarse statistics go to the tasks
    sample = np.array([r["v"] + [0] * (width - len(r["v"])) for r in vectors.orderBy(F.xxhash64("vec_id", "v")).limit(min(PIVOTS, -(-count // CANDIDATES))).collect()], np.float64).reshape(-1, width)
    pivots = segment_statistics(sample, RESOLUTIONS[0]) if width >= RESOLUTIONS[0] else (np.zeros((1, 1)), np.zeros((1, 1)))
    frozen = spark.sparkContext.broadcast(np.hstack(pivots))

    def place(batches):
        pivots = frozen.value
        for batch in batches:
            rows = np.array([v + [0] * (width - len(v)) for v in batch["v"].to_pylist()], np.float64).reshape(-1, width)
            cell = np.zeros(len(rows), np.int64)
            if len(pivots) > 1:
                here = np.hstack(segment_statistics(rows, RESOLUTIONS[0]))
                cell = ((pivots**2).sum(1) - 2 * np.einsum("ij,kj->ik", here, pivots)).argmin(1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(cell)], ["vec_id", "v", "cell"])

    placed = materialize(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, cell long").withColumn("row", F.monotonically_increasing_id()), "placed-vectors")
    # one row a cell, at most PIVOTS
    cells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("parts"))
    padded = F.when(F.size("v") < width, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))).otherwise(F.col("v"))
    dealt = placed.join(F.broadcast(cells), "cell").select((F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("block"), F.struct("vec_id", padded.alias("v")).alias("x"))
    gathered = dealt.groupBy("block").agg(F.collect_list("x").alias("xs")).select("block", F.col("xs.vec_id").alias("ids"), F.flatten("xs.v").alias("values"))

    def summarise(batches):
        for batch in batches:
            least, most = [], []
            for n, values in zip(pc.list_value_length(batch["ids"]).to_pylist(), batch["values"]):
                found = np.hstack(statistics_of(values.values.to_numpy().reshape(n, -1)) or [np.zeros((n, 0))])
                least.append(found.min(0))
                most.append(found.max(0))
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch["block"], batch["ids"], batch["values"], pa.array(least, lists), pa.array(most, lists)], ["block", "ids", "values", "least", "most"])

    with arrow_rows(spark, 8):
        return materialize(gathered.mapInArrow(summarise, "block long, ids array<long>, values array<long>, least array<double>, most array<double>"), "vector-blocks")


def block_bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(queries x blocks) the most that an inner product with a block's vectors can be, by the sharpest resolution."""
    out, start = np.full((len(queries), len(least)), np.inf), 0
    for stats in statistics_of(queries):
        low, high = least[:, start : start + stats.shape[1]], most[:, start : start + stats.shape[1]]
        start += stats.shape[1]
        up, down = np.maximum(stats, 0), np.minimum(stats, 0)
        bound = np.einsum("ij,kj->ik", up, high, optimize=True) + np.einsum("ij,kj->ik", down, low, optimize=True)
        reach = np.einsum("ij,kj->ik", np.abs(stats), np.maximum(np.abs(low), np.abs(high)), optimize=True)
        out = np.minimum(out, bound + 1e-9 * reach + 1e-6)
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows of the largest integer inner product with each query, itself left out.

    ``vectors`` has (vec_id, embedding); ``is_query`` is a condition on vec_id. Candidates lie in blocks of like
    vectors, and a block's smallest and largest segment statistics bound its scores. Each query searches the block
    of the highest bound first; its k-th best score there is a floor, and only blocks whose bound reaches it
    are searched too. Within a block rows are bounded one by one, coarse to fine (``best_of_block``). A search is
    one block against one chunk of queries, so work is bounded whatever the number of either; of each, k rows a
    query are left, and these are ranked once more. Ties go to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part, neither do null vec_ids. A shorter
    vector counts as padded with zeros. Of rows that repeat a query's vec_id the smallest vector asks, and none of
    them is its result; repeated rows of another vec_id each count. Fewer than k candidates: all. An empty table
    gives an empty result. Runs its jobs when called.
    """
    spark = vectors.sparkSession
    table = materialize(quantized(vectors.select("vec_id", "embedding"), scale), "quantized")
    count, width = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    result = "query_id long, vec_id long, score long"
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = blocks_of(table, count, width)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    asked = materialize(table.where(is_query).groupBy("vec_id").agg(F.min(padded).alias("q")).withColumnRenamed("vec_id", "query_id"), "queries")
    chunks = max(1, -(-asked.count() // QUERIES))
    n_summaries = max(1, -(-blocks.count() // SUMMARIES))
    summaries = blocks.select(F.pmod(F.xxhash64("block"), F.lit(n_summaries)).alias("part"), "block", "least", "most")

    def bounded(floors: DataFrame | None) -> DataFrame:
        """(query_id, block, bound): the block of the highest bound of each part of the summaries, or all other blocks that reach the floor."""
        first = floors is None
        rows = asked if first else asked.join(floors, "query_id")
        parts = rows.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_summaries - 1).cast("long"))))
        sides = summaries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["query_id", "block", "bound"]
            if not len(left) or not len(right):
                return pa.table({"query_id": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})
            block, ids = right["block"].to_numpy(), left["query_id"].to_numpy()
            bounds = block_bounds(_matrix(left["q"], len(left)), _matrix(right["least"], len(right)), _matrix(right["most"], len(right)))
            if first:
                i, j = np.arange(len(ids)), bounds.argmax(1)
            else:
                i, j = np.nonzero((bounds >= left["floor"].to_numpy()[:, None]) & (left["home"].to_numpy()[:, None] != block[None]))
            return pa.table([pa.array(ids[i]), pa.array(block[j]), pa.array(bounds[i, j])], names)

        return parts.groupBy("chunk", "part").cogroup(sides.groupBy("chunk", "part")).applyInArrow(meet, "query_id long, block long, bound double")

    def searched(pairs: DataFrame, name: str) -> DataFrame:
        """The k best rows of each (query_id, block, floor) of ``pairs``, a written table; a block that many ask is searched by chunks of them."""
        sizes = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
        right = pairs.join(sizes, "block").join(asked, "query_id").select("block", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"), "query_id", "q", "floor")
        left = blocks.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "ids", "values")

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            rows: list[tuple[int, int, int]] = []
            if len(left) and len(right):
                ids = left["ids"].combine_chunks().flatten().to_numpy()
                values, q, q_ids, floors = _matrix(left["values"], len(ids)), _matrix(right["q"], len(right)), right["query_id"].to_numpy(), right["floor"].to_numpy()
                for start in range(0, len(q), 256):
                    rows += best_of_block(q[start : start + 256], q_ids[start : start + 256], values, ids, k, floors[start : start + 256])
            return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

        return materialize(left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, result), name)

    best = bounded(None).groupBy("query_id").agg(F.max(F.struct("bound", "block")).alias("best"))
    homes = materialize(best.select("query_id", F.col("best.block").alias("block"), F.lit(float("-inf")).alias("floor")), "homes")
    found = searched(homes, "home-hits")
    floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("lowest"))
    floors = homes.join(floors, "query_id", "left").select("query_id", F.col("block").alias("home"), F.coalesce("lowest", F.lit(float("-inf"))).alias("floor"))
    others = materialize(bounded(floors).drop("bound").join(floors.select("query_id", "floor"), "query_id"), "other-blocks")
    hits = found.unionByName(searched(others, "other-hits"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
