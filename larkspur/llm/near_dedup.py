"""Near-duplicate documents: ProbMinHash of weighted word shingles, banding, verification, components."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import linking
from larkspur.llm.base import arrow_rows, join_side, materialize, normalized
from larkspur.llm.textvec import mix, row_chunks, shingle_hashes, utf8, word_hashes

#: 30 bands of 6 registers find a pair of similarity 0.8 with probability 1 - (1 - 0.8 ** 6) ** 30 = 0.9999.
BANDS, ROWS = 30, 6
SHINGLE, THRESHOLD = 5, 0.8
_LOW44 = np.uint64((1 << 44) - 1)


def shingles_of(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of normalised texts and the index of each row's first."""
    return shingle_hashes(*word_hashes(*utf8(texts)), k)


def prob_minhash(hashes: np.ndarray, firsts: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signatures (rows x registers, uint64) of the multisets hashes[firsts[i]:firsts[i + 1]].

    Each distinct shingle is a Poisson process whose rate is its count in the row. An arrival goes to a random
    register, which keeps the shingle of its earliest arrival. A shingle stops as soon as its next arrival is
    later than every register's earliest. Equal registers estimate the probability Jaccard similarity.
    Rows without shingles keep zeros.
    """
    n = len(firsts) - 1
    if n > 1 << 20:
        raise ValueError("at most 2**20 rows at a time")
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(firsts))
    keys = np.sort((row << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(keys))).astype(np.float64)
    row, element = (keys[at] >> np.uint64(44)).astype(np.int64), keys[at] & _LOW44
    best = np.full(n * registers, np.inf)
    signature = np.zeros(n * registers, np.uint64)
    time, turn = np.zeros(len(row)), 0
    while len(row):
        u = (mix(element, 2 * turn + 1) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        time = time - np.log1p(-u) / weight
        slot = row * registers + (mix(element, 2 * turn + 2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        signature[slot[won]] = element[won] + np.uint64(1)
        rows, where = np.unique(row, return_inverse=True)
        goes_on = time < best.reshape(n, registers)[rows].max(1)[where]
        row, element, weight, time, turn = row[goes_on], element[goes_on], weight[goes_on], time[goes_on], turn + 1
    return signature.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key (as int64) a band."""
    out = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * np.uint64(31) + signature.reshape(len(signature), bands, rows)[:, :, j], j)
        out = mix(out + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two multisets of shingle hashes, weighted by their counts."""
    (ea, ca), (eb, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    both, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if len(ea) == len(a) and len(eb) == len(b):  # no shingle twice: the Jaccard similarity of sets
        return len(both) / (len(a) + len(b) - len(both))
    va, vb = ca[ia].astype(float), cb[ib].astype(float)
    ratio, order = va / vb, np.argsort(va / vb, kind="stable")
    only_a, only_b = float(len(a)) - va.sum(), float(len(b)) - vb.sum()
    above = np.append(np.cumsum(va[order][::-1])[::-1], 0.0)  # from each place on, in order of the ratio
    below = np.append(0.0, np.cumsum(vb[order]))
    first = np.searchsorted(ratio[order], ratio, "left")
    return float((1.0 / ((above[first] + only_a) / va + (below[first] + only_b) / vb)).sum())


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, k1, keys) of every document with an id; k1 hashes its normalised text, keys is null where that has no word."""
    place = ["doc_id", "text_hash", "k1"]

    def sketch(batches):
        for batch in batches:
            for start, stop in row_chunks(batch["norm"]):
                part = batch.slice(start, stop - start)
                hashes, firsts = shingles_of(part["norm"])
                keys = band_keys(prob_minhash(hashes, firsts, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * bands, pa.int32()), pa.array(keys.ravel()), mask=pa.array(np.diff(firsts) == 0))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in place), lists], [*place, "keys"])

    norm = F.coalesce(normalized(F.col("text")), F.lit(""))
    rows_in = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), norm.alias("norm")).select("doc_id", "text_hash", F.xxhash64("norm").alias("k1"), "norm")
    return rows_in.mapInArrow(sketch, "doc_id long, text_hash long, k1 long, keys array<long>")


def fingerprints(texts: DataFrame, registers: int, shingle: int = SHINGLE) -> DataFrame:
    """(node, print, grams) of texts (node, norm): a byte of each signature register, and 32-bit hashes of the shingles."""

    def sign(batches):
        for batch in batches:
            hashes, firsts = shingles_of(batch["norm"], shingle)
            low = mix(prob_minhash(hashes, firsts, registers)).astype(np.uint8)
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            grams = [np.sort(short[x:y]).tobytes() for x, y in zip(firsts[:-1], firsts[1:])]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([r.tobytes() for r in low], pa.binary()), pa.array(grams, pa.binary())], ["node", "print", "grams"])

    return texts.mapInArrow(sign, "node long, print binary, grams binary")


def likely(a: bytes, b: bytes, least: float) -> bool:
    """Whether sorted multisets of 32-bit shingle hashes come near the probability Jaccard similarity."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.sort(np.concatenate((x, y)))
    if (both[2:] == both[:-2]).any() or (x[1:] == x[:-1]).any() or (y[1:] == y[:-1]).any():
        return probability_jaccard(x, y) >= least
    n = int((both[1:] == both[:-1]).sum())
    return n >= least * (len(both) - n)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold."""

    def check(batches):
        for batch in batches:
            (ha, fa), (hb, fb) = shingles_of(batch["ta"], shingle), shingles_of(batch["tb"], shingle)
            good = [probability_jaccard(ha[fa[i] : fa[i + 1]], hb[fb[i] : fb[i + 1]]) >= threshold for i in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first, second = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, screen: float | None = 4.5) -> DataFrame:
    """One row (doc_id, class_id, copies, text_hash, kept) per document: its class of near-duplicates, named by the smallest doc_id in it.

    Texts are compared as multisets of five-word shingles of lower-cased runs of letters and digits (a text of
    fewer words is one shingle); a link is an exact probability Jaccard similarity of ``threshold`` or more, a
    class a connected component of links. Exact copies are one node of the graph. ``copies`` counts the
    documents with the same normalised text. ``kept`` is true for the rows of the class's first text (smallest
    doc_id, then text_hash, which is xxhash64 of the text), so repeated rows of a doc_id and text are kept or not together.

    Pairs in different classes are screened by signature bytes before they are verified: a pair at the threshold is
    passed over if its bytes agree in so few places as happens at ``screen`` standard deviations (4.5: once in 300,000
    pairs). None verifies every pair that shares a band.

    A text without a word (null, empty, marks only) is linked to nothing, its own class, and kept. A document
    whose doc_id is null gets a null class and is kept. Runs its jobs when called.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    with arrow_rows(spark, 1000):
        sketch = materialize(sketches(docs, bands, rows), "sketches")
    # partial minima go through the shuffle, so a huge group of copies is a few rows
    nodes = sketch.where("keys is not null").groupBy("k1").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.select("k1", "at", "at.doc_id", "copies", "keys"), "nodes")
    shared = linking.shared_keys(nodes.select(F.col("k1").alias("node"), F.explode("keys").alias("key")))
    wanted = materialize(shared.select("node").distinct().join(nodes.select(F.col("k1").alias("node"), "doc_id"), "node"), "wanted")
    norm = F.coalesce(normalized(F.col("text")), F.lit(""))
    texts = materialize(docs.join(join_side(wanted), "doc_id").select("node", norm.alias("norm")).where(F.xxhash64("norm") == F.col("node")).dropDuplicates(["node"]), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        with arrow_rows(spark, 1000):
            return materialize(verified(pairs, texts, threshold, shingle), "verified")

    def pair_up(rest: DataFrame) -> DataFrame:
        registers = bands * rows
        floor = 0.0 if screen is None else threshold - screen * (threshold * (1 - threshold) / registers) ** 0.5
        with arrow_rows(spark, 1000):
            prints = materialize(fingerprints(texts.join(rest.select("node").distinct(), "node", "left_semi"), registers, shingle), "prints")
        prints = prints.join(nodes.select(F.col("k1").alias("node"), "keys"), "node")
        with arrow_rows(spark, 500):
            return materialize(linking.close_pairs(rest, prints, bands, floor, partial(likely, least=0.0 if screen is None else threshold - 0.01)), "close-pairs")

    comp = linking.link(shared, verify, pair_up)
    named = nodes.select("k1", "at", "copies").join(comp, F.col("k1") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "k1"))
    names = named.groupBy("comp").agg(F.min("at").alias("first"))
    classes = materialize(named.join(names, "comp").select("k1", "first", "copies"), "classes")
    worded, first = F.col("keys").isNotNull(), F.struct("doc_id", "text_hash") == F.col("first")
    found = sketch.join(classes, "k1", "left").select(
        "doc_id",
        F.when(worded, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("copies")).otherwise(F.lit(1)).alias("copies"),
        "text_hash",
        F.when(worded, first).otherwise(F.lit(True)).alias("kept"),
    )
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.xxhash64("text").alias("text_hash"), F.lit(True).alias("kept"))
    return found.unionByName(nameless)


def drop_duplicates(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class: of the rows that repeat its first document's id and text, one (smallest by hash of its columns).

    Documents without a word or an id stay, repeated or not. Texts that share a doc_id are told apart by their hash.
    """
    key = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")]
    drop = materialize(classes.where("not kept").select(*key).distinct(), "dropped")
    again = materialize(classes.where("kept and class_id is not null and copies > 1").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_text"), "repeated")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    gone = drop.unionByName(again)
    once = docs.join(join_side(again), same, "left_semi").groupBy(F.col("doc_id"), F.xxhash64("text")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return docs.join(join_side(gone), same, "left_anti").unionByName(once.select("_row.*"))
