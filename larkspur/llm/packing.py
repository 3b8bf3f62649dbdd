"""Packing token pieces into fixed-length sequences: cutting-stock column generation over a length histogram."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.base import arrow_rows, materialize
from larkspur.llm.textvec import row_chunks

LENGTH = 1024
#: Lengths are counted in bins of so many tokens; a pattern's bins, rounded up, fit a sequence.
BIN = 4
#: Pieces of a bin that are ranked in one place, about, and parts of a bin at most.
RANKED, MOST_SALTS = 1000, 4096
#: Characters of white space in a run, from which on a text is left to ``tokenizers``; bytes of texts cut into pieces at once.
LONGEST_SPACE, CHUNK = 50000, 4 << 20
_SPACES = re.compile(rf"\s{{{LONGEST_SPACE}}}")


class Encoder:
    """Ids of byte-level BPE from a ``tokenizers`` file.

    Plain texts go through tiktoken with the ranks of that same file, three times as fast with the same ids
    (the tests compare them). A text that contains a special token's string goes through ``tokenizers``, and so does
    one with a run of white space of LONGEST_SPACE characters or more, which tiktoken's expressions are too deep for.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.exact = Tokenizer.from_file(path)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = tuple(special)
        # byte-level BPE writes each byte as a printable character: its own, or one from 256 on in order
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or (len(text) >= LONGEST_SPACE and _SPACES.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and ``end_id``, cut into full pieces and a rest."""

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in (whole.slice(at, stop - at) for whole in batches for at, stop in row_chunks(whole["text"], CHUNK)):
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32) if with_ids else None))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows))[:5] or [[]] * 5, [pa.int64()] * 5)]
            if with_ids:
                columns.append(pa.array([r[5] for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


@dataclass
class Pattern:
    """``copies`` sequences that each hold ``parts[bin]`` pieces of a bin."""

    parts: dict[int, int]
    copies: int


def _price(value: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of bins (bin b takes b of the capacity): an unbounded knapsack by dynamic programming."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        sums = value[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(sums.argmax())
        best[c], pick[c] = sums[k], k + 1
    parts: dict[int, int] = {}
    c = capacity
    while c > 0 and pick[c]:
        if value[pick[c]] > 0:
            parts[int(pick[c])] = parts.get(int(pick[c]), 0) + 1
        c -= int(pick[c])
    return float(best[capacity]), parts


def _first_patterns(bins: list[int], need: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, list[int]]:
    """One pattern per bin and how often it is used: the longest bin left, filled up by the bins left.

    Each pattern is used until one of its bins is exhausted, which no later pattern has: with the bins in the order
    in which they are exhausted (the third result), the patterns are a lower triangular basis.
    """
    left = {b: float(n) for b, n in zip(bins, need)}
    columns, amount, order = [], [], []
    while left:
        longest = max(left)
        value = np.zeros(capacity + 1)
        value[list(left)] = [b * (1 + b / capacity / 100) for b in left]
        parts = {longest: 1}
        for b, k in _price(value, capacity - longest)[1].items():
            parts[b] = parts.get(b, 0) + k
        gone = min(parts, key=lambda b: left[b] / parts[b])
        copies = left[gone] / parts[gone]
        for b, k in parts.items():
            left[b] = max(0.0, left[b] - k * copies)
        del left[gone]
        columns.append(parts)
        amount.append(copies)
        order.append(gone)
    return columns, np.array(amount), order


def cutting_stock(demand: dict[int, int], capacity: int, rounds: int = 4000, gap: float = 1e-3) -> list[Pattern]:
    """Patterns that hold at least ``demand[b]`` pieces of each bin b of 1..capacity, in few sequences.

    The linear program (least sequences that cover the demand) starts from patterns filled greedily and is solved
    by the revised simplex method; its dual values price new patterns by knapsack dynamic programming, until no
    pattern is worth more than one sequence or the dual bound is within ``gap``. Pattern counts are rounded
    down and what is left over, a few pieces a pattern, is packed first-fit by decreasing length.
    The work depends on the number of bins, not on the number of pieces.
    """
    bins = sorted(b for b, n in demand.items() if n > 0)
    if not bins:
        return []
    m = len(bins)
    need = np.array([demand[b] for b in bins], float)
    columns, amount, bins = _first_patterns(bins, need, capacity)
    need = np.array([demand[b] for b in bins], float)
    row_of = {b: i for i, b in enumerate(bins)}
    inverse = np.eye(m)
    for j, parts in enumerate(columns):  # the basis is lower triangular
        column = np.zeros(m)
        column[[row_of[b] for b in parts]] = list(parts.values())
        inverse[j] /= column[j]
        inverse[j + 1 :] -= np.multiply.outer(column[j + 1 :], inverse[j])
    for _ in range(rounds):
        dual = inverse.sum(0)
        value = np.zeros(capacity + 1)
        value[bins] = np.maximum(dual, 0)
        worth, parts = _price(value, capacity)
        if worth <= 1 + 1e-9 or amount.sum() - (dual * need).sum() / worth <= gap * amount.sum():
            break
        column = np.zeros(m)
        for b, k in parts.items():
            column[row_of[b]] = k
        direction = np.einsum("ij,j->i", inverse, column)  # plain loops: threaded BLAS can hang beside a JVM
        ratio = np.where(direction > 1e-10, amount / np.where(direction > 1e-10, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.multiply.outer(direction, row)
        inverse[out] = row
        columns[out] = parts
    left = {b: demand[b] for b in bins}
    found: list[Pattern] = []
    for parts, x in sorted(zip(columns, amount), key=lambda p: (-p[1], sorted(p[0].items()))):
        copies = min([int(x + 1e-9), *(left[b] // k for b, k in parts.items())])
        if copies > 0:
            found.append(Pattern(parts, copies))
            for b, k in parts.items():
                left[b] -= k * copies
    # the rest: whole sequences of one bin first, so that the loop is over a few pieces a bin only
    rooms: list[tuple[int, dict[int, int]]] = []
    for b in sorted(left, reverse=True):
        whole = left[b] // (capacity // b)
        if whole:
            found.append(Pattern({b: capacity // b}, whole))
        for _ in range(left[b] - whole * (capacity // b)):
            for i, (room, parts) in enumerate(rooms):
                if room >= b:
                    parts[b] = parts.get(b, 0) + 1
                    rooms[i] = (room - b, parts)
                    break
            else:
                rooms.append((capacity - b, {b: 1}))
    return found + [Pattern(parts, 1) for _, parts in rooms]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, bin_width: int = BIN, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on request).

    A document is its ids and ``end_id``; a null text is empty and so has one token. Documents longer than a
    sequence fill whole sequences and leave one rest. Rests are counted by bin; cutting-stock patterns over the
    bins are found on the driver from that histogram alone (at most length / bin_width counts), and pieces,
    ranked within their bin, take the patterns' places by a join. Pieces of a sequence lie gapless from 0. Full
    pieces are neither ranked nor shuffled. Sequence ids are unique, not gapless. Runs its jobs when called.

    Null doc_ids and repeated rows are packed like any other row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, 1000):
        cut = materialize(pieces(docs, tokenizer, length, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    capacity = length // bin_width
    bin_of = F.ceil(F.col("length") / bin_width).cast("int")
    demand = {r["bin"]: r["n"] for r in cut.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    demand.pop(capacity, None)  # full pieces
    patterns = cutting_stock(demand, capacity)
    slots, begin, taken = [], 0, {}
    for p in patterns:
        for order, (b, k) in enumerate(sorted(p.parts.items(), reverse=True)):
            at = taken.get(b, 0)
            slots.append((b, at, at + k * p.copies, k, begin, order))
            taken[b] = at + k * p.copies
        begin += p.copies
    # pieces are ranked within parts of their bin, by the number they were written with, so that repeated rows are spread like others
    salts = min(MOST_SALTS, -(-max(demand.values(), default=1) // RANKED))
    rests = cut.withColumn("bin", bin_of).where(F.col("bin") < capacity).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    # at most bins * salts rows, whatever the table's size
    counted = rests.groupBy("bin", "salt").agg(F.count(F.lit(1)).alias("n"))
    bases = materialize(counted.select("bin", "salt", (F.sum("n").over(Window.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("base")), "piece-bases")
    places = spark.createDataFrame(slots, "bin int, first long, stop long, each int, begin long, order int")
    rank = F.row_number().over(Window.partitionBy("bin", "salt").orderBy("row")) - 1
    ranked = rests.withColumn("rank", rank).join(F.broadcast(bases), ["bin", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # a few patterns a bin
    placed = ranked.join(F.broadcast(places), (ranked["bin"] == places["bin"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    placed = placed.withColumn("sequence_id", F.col("begin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).withColumn("slot", F.pmod(F.col("rank") - F.col("first"), F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy("order", "slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # a full piece is a sequence, named by its own number after those of the patterns
    full = cut.where(bin_of >= capacity).withColumn("sequence_id", F.col("row") + F.lit(begin)).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    return placed.select(names).unionByName(full.select(names))


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, tokens) from pieces with ids: concatenated, padded to ``length`` unless the tokens are a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("tokens"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    power = F.bit_count(F.col("tokens")) == 1
    padding = F.when(power, F.lit(0)).otherwise(length - F.col("tokens")).cast("int")
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), padding)).alias("ids"), "tokens")
