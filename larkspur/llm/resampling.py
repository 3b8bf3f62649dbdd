"""Importance resampling towards a target: hashed n-gram counts, log ratios as gains, a draw by Gumbel scores.

Features are hashed by length-bucketed CRC matrices: the distinct feature bytes of a block of words are grouped by length
into two-dimensional arrays of bytes, whose columns update the CRCs of all rows at once; buckets are scattered back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.base import arrow_rows, materialize
from larkspur.llm.textvec import row_chunks, utf8

#: Buckets of the contract, and words of the longest feature.
BUCKETS, LONGEST = 10000, 3
#: Words hashed together, rows of a CRC matrix, and bytes of its longest rows; longer features are cut into rows.
WORDS, ROWS, CUT = 1 << 16, 1 << 13, 1024

_table = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _table = np.where(_table & 1, np.uint32(0xEDB88320) ^ (_table >> 1), _table >> 1).astype(np.uint32)


def _advance(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The CRC states after the rows of a byte matrix, updated column by column."""
    for column in np.ascontiguousarray(matrix.T):
        state = _table[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def _zeros(state: np.ndarray, count: int) -> np.ndarray:
    """The CRC states after ``count`` zero bytes: linear in the state, so the tables of its four bytes are combined."""
    units = np.arange(256, dtype=np.uint32)
    out = np.zeros_like(state)
    for shift in (0, 8, 16, 24):
        moved = units << np.uint32(shift)
        for _ in range(count):
            moved = _table[moved & np.uint32(255)] ^ (moved >> np.uint32(8))
        out ^= moved[(state >> np.uint32(shift)) & np.uint32(255)]
    return out


def crc_matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the byte strings ``data[start : start + length]``.

    Strings of one length form the rows of a matrix. A string of over CUT bytes is cut: its pieces of CUT bytes are rows
    that start from state 0, and a state is carried over a piece by the linearity of the CRC.
    """
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    head = np.where(length > CUT, length % CUT, length)
    order = np.argsort(head, kind="stable")
    bounds = np.flatnonzero(np.diff(head[order], prepend=-1))
    for first, last in zip(bounds, [*bounds[1:], len(order)]):
        size = int(head[order[first]])
        if size:
            rows = np.lib.stride_tricks.sliding_window_view(data, size)
            for at in range(first, last, ROWS):
                group = order[at : min(at + ROWS, last)]
                state[group] = _advance(state[group], rows[start[group]])
    for i in np.flatnonzero(length > CUT):
        places = np.arange(start[i] + head[i], start[i] + length[i], CUT)
        rows = np.lib.stride_tricks.sliding_window_view(data, CUT)
        pieces = np.concatenate([_advance(np.zeros(len(p), np.uint32), rows[p]) for p in np.array_split(places, -(-len(places) // ROWS))])
        one = state[i : i + 1]
        carry = [_zeros(np.arange(256, dtype=np.uint32) << np.uint32(s), CUT) for s in (0, 8, 16, 24)]
        for piece in pieces:
            value = int(one[0])
            one = np.array([carry[0][value & 255] ^ carry[1][value >> 8 & 255] ^ carry[2][value >> 16 & 255] ^ carry[3][value >> 24] ^ piece], np.uint32)
        state[i] = one[0]
    return state ^ np.uint32(0xFFFFFFFF)


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_solid = np.zeros(256, bool)
_solid[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row): the words of all texts, A-Z lowered, one after the other with a space behind each.

    A word is a run of digits, ASCII letters and anything above U+007F. Null and empty texts have none.
    """
    data, offsets = utf8(texts)
    data = _lower[data]
    inside = _solid[data]
    first, last = inside.copy(), inside.copy()
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    first[1:] &= ~inside[:-1]
    first[bounds] = inside[bounds]
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    size = end - start
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    placed = np.cumsum(size + 1) - size - 1
    keep = np.ones(len(joined), bool)
    keep[placed + size] = False
    joined[keep] = data[inside]
    return joined, placed, placed + size, row


def _codes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of equal keys, and the first place of each code."""
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def feature_buckets(texts: pa.Array):
    """Yields (row, bucket) arrays of all features of the texts: each run of 1 to LONGEST consecutive words of a row, repeats included.

    Words are taken in blocks of WORDS, each with the words that its last features reach into; a block hashes each
    distinct feature once.
    """
    data, start, end, row = words_of(texts)
    for low in range(0, len(start), WORDS):
        high, reach = min(low + WORDS, len(start)), min(low + WORDS + LONGEST - 1, len(start))
        edges = np.append(start[low:reach], end[reach - 1] + 1).astype(np.int64)
        text = pa.Array.from_buffers(pa.large_binary(), reach - low, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        word, first = _codes(text)
        code, rows, found = word, [], []
        starts, lengths = [start[low + first]], [end[low + first] - start[low + first]]
        rows.append(row[low:high])
        found.append(code[: high - low])
        count = len(first)
        for n in range(2, LONGEST + 1):
            here = np.arange(min(high, reach - n + 1) - low if reach - n + 1 > low else 0)
            whole = row[low + here] == row[low + here + n - 1]
            key = code[: len(here)] * len(word) + word[here + n - 1]
            grams, first = _codes(pa.array(key[whole]))
            at = here[whole]
            starts.append(start[low + at[first]])
            lengths.append(end[low + at[first] + n - 1] - start[low + at[first]])
            rows.append(row[low + at])
            found.append(count + grams)
            count += len(first)
            code = np.zeros(len(here), np.int64)
            code[at] = grams
        buckets = (crc_matrix(data, np.concatenate(starts), np.concatenate(lengths)) % np.uint32(BUCKETS)).astype(np.int64)
        # features that begin in the words reached into are counted by the next block
        for r, f in zip(rows, found):
            yield r[: high - low], buckets[f[: high - low]]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often the features of texts (text) fall into each bucket; each task counts its own rows first."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for begin, stop in row_chunks(batch["text"]):
                for _, bucket in feature_buckets(batch["text"].slice(begin, stop - begin)):
                    total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["counts"])

    with arrow_rows(texts.sparkSession, 512):
        parts = texts.select("text").mapInArrow(count, "counts array<long>")
        sums = parts.select(F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS, np.int64)
    for r in sums:
        found[r["bucket"]] = r["n"]
    return found


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor(1000 * ln of its share in the target over its share in the source), shares with one added, in doubles."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of documents (doc_id, text)."""

    def weigh(batches):
        for batch in batches:
            for begin, stop in row_chunks(batch["text"]):
                part = batch.slice(begin, stop - begin)
                features, weight = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                words = np.bincount(words_of(part["text"])[3], minlength=len(part))
                for row, bucket in feature_buckets(part["text"]):
                    features += np.bincount(row, minlength=len(part))
                    np.add.at(weight, row, gains[bucket])
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(words, pa.int64()), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """``rows`` with a long ``rank``: 1, 2, ... in ``order`` for the first ``most``, else null.

    Rows are dealt by ranges of the order and sorted there; a rank is a row's place and the rows of the ranges before.
    """
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked-rows")
    part = F.shiftright("_place", 33)
    before, ahead = 0, []
    # one row a partition
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        ahead.append((r["part"], before))
        before += r["n"]
    offsets = placed.sparkSession.createDataFrame(ahead, "_part long, _before long")
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", F.when(rank <= most, rank)).drop("_place", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of documents (doc_id, text), drawn towards the texts of ``target`` (text).

    Of the documents of ``least_words`` words or more, the ``percent`` of highest scores (rounded down) are drawn and ranked, ties to
    the smaller doc_id (null first, then by weight, then by file order); others have no rank. A score is the weight, the sum of
    the gains of a document's features, with Gumbel noise from the sha256 of seed and doc_id, so reruns agree. Null and
    empty texts have no feature and weight 0; a null doc_id counts as an empty text in the hash; repeated rows are
    documents of their own. Without a target text every gain is that of an empty target. Two passes read the texts: one
    counts, one weighs; only doc_ids and numbers are sorted.
    """
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    with arrow_rows(docs.sparkSession, 512):
        scored = materialize(weighted(docs, gains).withColumn("score", (F.col("weight") + noise).cast("long")), "weighted-documents")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(able, [F.desc("score"), F.asc("doc_id"), F.desc("weight")], percent * able.count() // 100)
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
