"""Quality classifier: naive Bayes support vectors over hashed byte n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.base import arrow_rows, materialize
from larkspur.llm.textvec import mix, row_chunks, utf8, word_hashes

#: Hashed n-grams of 1 to 3 bytes and of 1 to 6 word repeats; labelled rows of each class that the classifier is fitted on at most.
BITS, LONGEST, LONGEST_REPEATS = 17, 3, 6
ROWS_PER_CLASS = 3000
#: Bytes of a class's training texts at most, which meet on the driver.
BYTES_PER_CLASS = 24 << 20


@dataclass
class Model:
    """Weight of each n-gram bucket, the bias, and the logistic scale and shift that make scores of margins."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct n-gram bucket of each row; n-grams do not cross rows.

    Beside byte n-grams there are n-grams of marks that say whether a word repeats the one before it.
    """
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    keys = []
    code = np.zeros(len(data), np.uint64)
    for n in range(1, longest + 1):
        code = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :].astype(np.uint64) if len(data) >= n else code[:0]
        same = row[: len(code)] == row[n - 1 :] if len(code) else np.zeros(0, bool)
        bucket = (mix(code, n) >> np.uint64(64 - BITS)).astype(np.int64)
        keys.append(((row[: len(code)] << BITS) | bucket)[same])
    words, firsts = word_hashes(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(firsts))
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    code = np.ones(len(words), np.uint64)
    for n in range(1, LONGEST_REPEATS + 1):
        code = (code[: len(words) - n + 1] << np.uint64(1)) | again[n - 1 :] if len(words) >= n else code[:0]
        bucket = (mix(code, LONGEST + n) >> np.uint64(64 - BITS)).astype(np.int64)
        keys.append(((row[: len(code)] << BITS) | bucket)[row[: len(code)] == row[n - 1 :]] if len(code) else bucket)
    each = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    new = np.ones(len(each), bool)
    new[1:] = each[1:] != each[:-1]
    each = each[new]
    return each >> BITS, each & ((1 << BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[DataFrame, float]:
    """(text, y, h, bytes) and the share of class 1 among all labelled ids; the table has at most ``rows`` labelled documents of each class, chosen by a hash h of doc_id; null labels are left out.

    A doc_id with several labels counts once, with the larger one; of several texts under an id the smallest teaches.
    """
    known = materialize(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y")), "labels")
    chosen = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(rows)  # a top-k by hash: no class is sorted whole
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = materialize(chosen, "chosen")
    # at most two times ``rows`` ids, so the side is bounded; repeated rows of an id teach once
    share = known.agg(F.avg("y")).first()[0]
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = materialize(found.select("text", "y", F.xxhash64("doc_id").alias("h"), F.octet_length("text").cast("long").alias("bytes")), "training")
    return sample, 0.5 if share is None else float(share)


def for_driver(sample: DataFrame, rows: int, most_bytes: int = BYTES_PER_CLASS) -> pd.DataFrame:
    """The first ``rows`` documents of each class by hash; from the one that passes ``most_bytes`` of texts on none is taken, but one is always."""
    parts = []
    for y in (0, 1):
        order = Window.orderBy("h", F.xxhash64("text"))  # over a top-k of ``rows`` rows
        first = sample.where(F.col("y") == y).orderBy("h", F.xxhash64("text")).limit(rows)
        running = first.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("place", F.row_number().over(order))
        parts.append(running.where((F.col("upto") <= most_bytes) | (F.col("place") == 1)).select("text", "y", "h").toPandas())
    return pd.concat(parts).sort_values(["h", "text"])


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss; row i has the value values[j] at each j of rows[i]."""
    weights, alpha, bias = np.zeros(len(values)), np.zeros(len(rows)), 0.0
    square = np.array([(values[r] ** 2).sum() + 1 for r in rows])
    random = np.random.default_rng(seed)
    for _ in range(passes):
        for i in random.permutation(len(rows)):
            at = values[rows[i]]
            gradient = y[i] * ((weights[rows[i]] * at).sum() + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                weights[rows[i]] += (new - alpha[i]) * y[i] * at
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return weights, bias


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Scale and shift of a logistic curve through margins: Newton steps, halved while they don't help, on smoothed targets."""
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    middle, spread = float(margins.mean()), max(float(margins.std()), 1e-9)
    x = (margins - middle) / spread
    loss = lambda a, b: (np.logaddexp(0, a * x + b) - target * (a * x + b)).sum() + 5e-4 * a * a
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        ga, gb, w = ((p - target) * x).sum() + 1e-3 * a, (p - target).sum(), p * (1 - p)
        haa, hab, hbb = (w * x**2).sum() + 1e-3, (w * x).sum(), w.sum() + 1e-9
        determinant = haa * hbb - hab**2 + 1e-12
        da, db = (hbb * ga - hab * gb) / determinant, (haa * gb - hab * ga) / determinant
        step = 1.0
        while step > 1e-6 and loss(a - step * da, b - step * db) > loss(a, b):
            step /= 2
        if step <= 1e-6:
            break
        a, b = a - step * da, b - step * db
    return float(a / spread), float(b - a * middle / spread)


def at_share(curve: tuple[float, float], sampled: np.ndarray, share: float) -> tuple[float, float]:
    """A logistic curve fitted to a sample, shifted from the sample's share of class 1 to that of all labels."""
    odds = lambda x: float(np.log(x / (1 - x)))
    return curve[0], curve[1] + odds(min(max(share, 0.001), 0.999)) - odds(min(max(float(sampled.mean()), 0.001), 0.999))


def fit(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_CLASS, cost: float = 0.1, smooth: float = 1.0, folds: int = 4) -> Model:
    """Learns ``label`` from at most ``rows`` documents and BYTES_PER_CLASS bytes of each class.

    Each n-gram indicator is scaled by the log ratio of the classes' smoothed counts, then a hinge-loss model is
    fitted by dual coordinate descent. The logistic curve is fitted to margins of models that had not seen the
    document. Without labels of both classes all scores are the share of class 1 (one half if nothing is labelled).
    """
    sample, share = labelled_sample(docs, labels, label, rows)
    table = for_driver(sample, rows)
    y = np.where(table["y"].to_numpy() > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        share = (np.clip((y > 0).mean(), 0.001, 0.999)) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    texts, features = pa.array(table["text"].tolist(), pa.string()), []
    for start, stop in row_chunks(texts, 1 << 20):
        row, bucket = ngram_buckets(*utf8(texts.slice(start, stop - start)))
        cuts = np.searchsorted(row, np.arange(stop - start + 1))
        features += [bucket[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:])]

    def train(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        counts = [np.bincount(np.concatenate([features[i] for i in chosen if y[i] == side] or [bucket[:0]]), minlength=1 << BITS) + smooth for side in (1.0, -1.0)]
        ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        norm = np.array([max(1e-9, (ratio[features[i]] ** 2).sum()) for i in chosen])
        rate = {side: len(chosen) / (2 * max(1, (y[chosen] == side).sum())) for side in (1.0, -1.0)}
        per_row = np.array([cost * rate[y[i]] for i in chosen]) * 100 / np.median(norm)
        w, b = dual_coordinate_descent([features[i] for i in chosen], ratio, y[chosen], per_row)
        return w * ratio, b

    margins = np.zeros(len(y))
    for fold in range(folds):
        mine = np.arange(len(y)) % folds == fold
        if not mine.any() or abs(y[~mine].sum()) == (~mine).sum():
            continue
        w, b = train(np.flatnonzero(~mine))
        margins[mine] = [w[features[i]].sum() + b for i in np.flatnonzero(mine)]
    scale, shift = at_share(platt(margins, y), y > 0, share)
    w, b = train(np.arange(len(y)))
    return Model(w, b, scale, shift)


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The columns of ``docs`` but the text, with score (0 to 1) and predicted (1 if score >= ``threshold``).

    Whole texts are scored; a null text counts as empty, whose score is the bias alone. Columns of ``docs`` named
    like the results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in ("score", "predicted") if c in docs.columns))
    frozen = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["score double", "predicted int"])

    def run(batches):
        model = frozen.value
        for batch in batches:
            for start, stop in row_chunks(batch["text"]):
                part = batch.slice(start, stop - start)
                row, bucket = ngram_buckets(*utf8(part["text"]))
                margin = np.bincount(row, model.weights[bucket], len(part)) + model.bias
                value = 1 / (1 + np.exp(-np.clip(model.scale * margin + model.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(value), pa.array((value >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    with arrow_rows(spark, 1000):
        return materialize(docs.select(*kept, "text").mapInArrow(run, schema), "quality-scores")
