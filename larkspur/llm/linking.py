"""Linking within shared keys and connected components, without pairs inside a group already joined."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.base import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one at most, and none that has one is such a smaller node itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, comp) for every node with an edge; comp is the smallest node.

    Alternates large-star and small-star steps until every node has one edge, to its component's smallest. Each
    step is a grouped minimum and a join on a node, written to the shared folder; nothing is gathered per component.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots), "components")


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shared_keys(members: DataFrame) -> DataFrame:
    """Memberships (key, node, hub) of the keys that two different nodes or more share; hub is one of the key's nodes.

    The hub is the member that shares its keys with most nodes: of the copies of one original that is the
    original or a copy close to it, which is similar to more of the others than they are to each other.
    ``members`` may repeat rows.
    """
    many = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    shared = materialize(members.join(many, "key").distinct(), "shared-keys")
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = shared.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = materialize(shared.join(weight, "node").select("key", "node", "weight"), "weighed-keys")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("node").alias("h"), "node")).alias("hub"))
    return materialize(weighed.join(hubs, "key").select("key", "node", F.col("hub.node").alias("hub")), "hub-keys")


def link(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], pair_up: Callable[[DataFrame], DataFrame], screen: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, linked: bool = False) -> DataFrame:
    """Components of the graph of all verified pairs of nodes that share a key, as (node, comp).

    First every node is verified against the hub of each of its keys, which joins large groups with few
    pairs. Then only pairs that share a key but lie in different components are left; all of them that were
    not tried are verified, so no link between components is lost. Pairs within a component change nothing.
    ``pair_up`` makes those pairs (a, b), a < b, from rows (key, node, hub, comp); it may leave out pairs that cannot pass.
    With ``linked`` it verifies them too, and may leave out pairs of nodes that its other links join.
    ``screen`` leaves out such pairs before the first verification.
    """
    tried = materialize(shared.where("node <> hub").select(*ordered("node", "hub")).distinct(), "hub-pairs")
    edges = materialize(verify(screen(tried)), "hub-edges")
    comp = components(edges)
    placed = materialize(shared.join(comp, "node", "left").select("key", "node", "hub", F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = materialize(placed.join(mixed, "key", "left_semi"), "mixed-keys")
    if rest.isEmpty():
        return comp
    more = pair_up(rest)
    if not linked:
        pairs = materialize(more.distinct().join(tried, ["a", "b"], "left_anti"), "rest-pairs")
        more = materialize(verify(pairs), "rest-edges")
    if more.isEmpty():
        return comp
    return components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))


def close_pairs(rest: DataFrame, prints: DataFrame, bands: int, floor: float, likely: Callable[[bytes, bytes], bool], block: int = 500) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different components that share a key: each once, and only pairs that may pass.

    ``prints`` has (node, keys, print, grams): the node's key of each of its ``bands`` bands in order, a byte
    of each signature register, and what ``likely`` takes. The nodes of a key are cut into blocks by hash; each
    pair of blocks is compared in one place, under the first band whose key both nodes have. A pair becomes
    a row if the bytes agree in a share of ``floor`` or more and ``likely`` holds.
    """
    blocks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = rest.join(blocks, "key").join(prints, "node").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "comp", "node", "keys", "print", "grams")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "comp", "node")

    def compare(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            ahead = pa.Table.from_batches([*kept, batch])
            place = np.stack([ahead[c].to_numpy() for c in ("key", "i", "j")])
            starts = np.append(0, np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1)
            yield from runs(ahead, starts)
            kept = ahead.slice(int(starts[-1])).combine_chunks().to_batches()  # the last run may go on
        if kept:
            last = pa.Table.from_batches(kept)
            yield from runs(last, np.array([0, len(last)]))

    def runs(table, starts):
        if len(starts) < 2:
            return
        cut = table.slice(0, int(starts[-1]))
        key, node, comp, mine, i, j = (cut[c].to_numpy() for c in ("key", "node", "comp", "mine", "i", "j"))
        keys = cut["keys"].combine_chunks().flatten().to_numpy().reshape(-1, bands)
        prints = np.frombuffer(b"".join(cut["print"].to_pylist()), np.uint8).reshape(len(cut), -1)
        grams = cut["grams"].to_pylist()
        found: list[tuple[int, int]] = []
        for start, stop in zip(starts[:-1], starts[1:]):
            band = int(np.flatnonzero(keys[start] == key[start])[0])
            changes = np.append(np.flatnonzero(comp[start + 1 : stop] != comp[start : stop - 1]) + 1, stop - start) + start
            first = start
            for after in changes[:-1]:  # each component against all that follow it
                for x in range(first, after, 32):
                    y = min(x + 32, after)
                    near = ~(keys[x:y, None, :band] == keys[None, after:stop, :band]).any(2)
                    near &= (prints[x:y, None, :] == prints[None, after:stop, :]).sum(2) >= floor * prints.shape[1]
                    if i[start] != j[start]:
                        near &= mine[x:y, None] != mine[None, after:stop]
                    for a, b in zip(*np.nonzero(near)):
                        if likely(grams[x + a], grams[after + b]):
                            found.append((node[x + a], node[after + b]))
                first = after
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")
