"""Toxicity: a linear-chain conditional random field tags toxic words; marginals make document scores and spans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.base import arrow_rows, materialize
from larkspur.llm.quality_classifier import at_share, for_driver, labelled_sample, platt
from larkspur.llm.textvec import row_chunks, shingle_hashes, utf8, word_hashes, word_parts

#: Hash bits of the features, lengths in bytes of word beginnings and ends.
BITS, PREFIXES, SUFFIXES = 18, range(3, 10), range(3, 6)
#: Labelled rows of each class that features are counted in at most, and that the field is fitted on.
COUNTED_PER_CLASS, ROWS_PER_CLASS = 20000, 900


@dataclass
class Model:
    """Emission weight of each feature bucket (label 1 against 0), transition scores, and the logistic curve of scores."""

    weights: np.ndarray
    transitions: np.ndarray
    scale: float
    shift: float


def words_of(texts: pa.Array) -> pa.Array:
    """Runs of letters and digits joined by one space, in lower case; null gives an empty string."""
    plain = pc.replace_substring_regex(texts.cast(pa.string()).fill_null(""), r"[^\p{L}\p{N}]+", " ")
    return pc.utf8_lower(pc.utf8_trim(plain, " "))


def feature_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words x features) buckets of all words of all rows, bucket 0 for none, and each row's first word."""
    parts, rows = word_parts(*utf8(words), PREFIXES, SUFFIXES)
    return np.stack([(p >> np.uint64(64 - BITS)).astype(np.int32) for p in parts], 1), rows


def _step(logit: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds that a chain's next label is 1, before its emission, from the log odds of this one."""
    return np.logaddexp(t[0, 1], logit + t[1, 1]) - np.logaddexp(t[0, 0], logit + t[1, 0])


def _sweep(emission: np.ndarray, ends: np.ndarray, t: np.ndarray, tolerance: float) -> np.ndarray:
    """Forward messages (log odds before a word's emission) of chains laid end to end; ``ends`` marks first words.

    A message depends on the one before it. All are set from the background's fixed point and then corrected
    where the one before has changed, until none changes by more than ``tolerance``: the recursion forgets, so
    few words near tagged ones need more than a few corrections.
    """
    fixed = 0.0
    background = float(np.median(emission)) if len(emission) else 0.0
    for _ in range(200):
        fixed = float(_step(np.array(background + fixed), t))
    message = np.full(len(emission), fixed)
    message[ends] = 0.0
    at = np.arange(1, len(emission))[~ends[1:]] if len(emission) else np.zeros(0, np.int64)
    while len(at):
        new = _step(message[at - 1] + emission[at - 1], t)
        moved = np.abs(new - message[at]) > tolerance
        message[at] = new
        at = at[moved] + 1
        at = at[at < len(emission)]
        at = at[~ends[at]]
    return message


def marginals(emission: np.ndarray, rows: np.ndarray, t: np.ndarray, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of label 1 at each word by forward and backward messages, and the forward log odds."""
    first, last = np.zeros(len(emission), bool), np.zeros(len(emission), bool)
    filled = np.flatnonzero(np.diff(rows) > 0)
    first[rows[:-1][filled]] = True
    last[rows[1:][filled] - 1] = True
    forward = _sweep(emission, first, t, tolerance) + emission
    backward = _sweep(emission[::-1], last[::-1], t.T, tolerance)[::-1]
    return forward + backward, forward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def once_each(sample: DataFrame) -> DataFrame:
    """The documents (text, y, h, ...) without copies within a class, which would make their rare words look like signs of it.

    Of texts with the same smallest shingle hash, which copies share always and texts of similarity s with odds s,
    the one of the smallest h stays.
    """

    def sketch(batches):
        for batch in batches:
            shingles, at = shingle_hashes(*word_hashes(*utf8(words_of(batch["text"]))))
            least = [int(shingles[a:b].min().view(np.int64)) if b > a else -1 for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch["h"], batch["y"], pa.array(least, pa.int64())], ["h", "y", "least"])

    kept = sample.select("h", "y", "text").mapInArrow(sketch, "h long, y int, least long").groupBy("least", "y").agg(F.min("h").alias("h"))
    # as many rows as the sample has at most, which a parameter bounds
    return sample.join(F.broadcast(kept.select("h", "y")), ["h", "y"], "left_semi")


def signs(sample: DataFrame, least_gain: float = 30.0, odds: float = 3.0) -> np.ndarray:
    """Whether each bucket is a feature that is found nearly only in toxic documents of the sample (text, y).

    Documents alone are labelled, so words get their labels from the features' document frequencies: log odds of
    ``odds`` or more, and a likelihood ratio statistic of ``least_gain`` or more, which chance reaches in one of
    twenty million features. The statistic grows with the number of labelled documents, so rarer signs count with more of them.
    """

    def count(batches):
        for batch in batches:
            buckets, rows = feature_buckets(words_of(batch["text"]))
            y, row = batch["y"].to_numpy(), np.repeat(np.arange(len(batch)), np.diff(rows))
            seen = np.zeros((2, 1 << BITS), np.int64)
            for k in range(buckets.shape[1]):
                pairs = np.unique(row.astype(np.int64) << BITS | buckets[:, k])
                for side in (0, 1):
                    seen[side] += np.bincount(pairs[y[pairs >> BITS] == side] & ((1 << BITS) - 1), minlength=1 << BITS)
            bucket = np.flatnonzero(seen.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(seen[0, bucket]), pa.array(seen[1, bucket])], ["bucket", "clean", "toxic"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counted = sample.select("text", "y").mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    part = lambda s, n: F.when(s > 0, s * F.log(s * max(1, n0 + n1) / ((F.col("toxic") + F.col("clean")) * max(1, n)))).otherwise(0.0)
    gain = 2 * (part(F.col("toxic"), n1) + part(F.col("clean"), n0))
    marked = np.zeros(1 << BITS, bool)
    # bucket 0 stands for features that a word has not
    marked[[r["bucket"] for r in counted.where((ratio >= odds) & (gain >= least_gain) & (F.col("bucket") > 0)).select("bucket").collect()]] = True
    return marked


def train(buckets: np.ndarray, rows: np.ndarray, tags: np.ndarray, rounds: int = 60, ridge: float = 0.02, settled: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient ascent on the chain's conditional likelihood (per-weight steps from past gradients).

    Ends once no round changes the words' marginal probabilities by more than ``settled`` of the tagged words in sum.
    """
    weights, t = np.zeros(1 << BITS), np.array([[2.0, -2.0], [0.0, 0.0]])
    # one row per distinct word: its buckets as digits of a 64-bit number stand for it
    key = np.zeros(len(buckets), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(buckets.shape[1]):
            key = key * np.uint64(0x9E3779B97F4A7C15) + buckets[:, k].astype(np.uint64)
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    kinds = buckets[at]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inner = np.flatnonzero(row[1:] == row[:-1])
    pair = np.zeros((2, 2))
    np.add.at(pair, (tags[inner].astype(int), tags[inner + 1].astype(int)), 1)
    past, past_t = np.full(len(weights), 1e-8), np.full((2, 2), 1e-8)
    before = np.zeros(len(tags))
    for _ in range(rounds):
        emission = weights[kinds].sum(1)[which]
        logit, forward = marginals(emission, rows, t, 1e-4)
        p = _sigmoid(logit)
        if np.abs(p - before).sum() <= settled * max(1.0, tags.sum()):
            break
        before = p
        by_kind = np.bincount(which, tags - p, len(kinds))
        gradient = np.bincount(kinds.ravel(), np.repeat(by_kind, kinds.shape[1]), len(weights)) - ridge * weights
        gradient[0] = 0
        # expected transitions: from the forward odds of a word and the backward odds of the next
        backward = logit[inner + 1] - forward[inner + 1] + emission[inner + 1]
        joint = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] + backward, forward[inner] + t[1, 0], forward[inner] + t[1, 1] + backward], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        expected = (joint / joint.sum(1, keepdims=True)).sum(0).reshape(2, 2)
        step = (pair - expected) - ridge * t
        past += gradient**2
        past_t += step**2
        weights += 0.5 * gradient / np.sqrt(past)
        t = t + 0.2 * step / np.sqrt(past_t)
    return weights, t


def document_margin(logit: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of each row's squared marginals (plus 0.3): sure words count, a long text's background does not."""
    p = np.append(0.0, np.cumsum(_sigmoid(logit) ** 2))
    return np.log(np.maximum(p[rows[1:]] - p[rows[:-1]], 0) + 0.3)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS_PER_CLASS, counted: int = COUNTED_PER_CLASS) -> Model:
    """Learns from at most ``counted`` documents of each class; null labels teach nothing.

    Words of toxic documents get labels from features that nearly only toxic documents have, counted by Spark. The
    field is fitted to at most ``rows`` documents of each class (and so many bytes as quality_classifier bounds), and a
    logistic curve turns a document's squared marginals into a score. Without labels of both classes every score
    is the share of class 1 (one half if nothing is labelled).
    """
    spark = docs.sparkSession
    sample, share = labelled_sample(docs, labels, label, counted)
    with arrow_rows(spark, 200):
        unique = materialize(once_each(sample), "toxicity-sample")
        marked = signs(unique)
    table = for_driver(unique, rows)
    toxic = (table["y"].to_numpy() > 0).astype(int)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        share = np.clip(toxic.mean(), 0.001, 0.999) if len(toxic) else 0.5
        return Model(np.zeros(1 << BITS), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    buckets, first = feature_buckets(words_of(pa.array(table["text"].tolist(), pa.string())))
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    weights, t = train(buckets, first, (marked[buckets].any(1) & (toxic[row] == 1)).astype(float))
    margin = document_margin(marginals(weights[buckets].sum(1), first, t)[0], first)
    return Model(weights, t, *at_share(platt(margin, toxic), toxic, share))


def tag(docs: DataFrame, model: Model, threshold: float = 0.5, spans: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with score (0 to 1), predicted and, on request, the toxic spans.

    ``spans`` are (start, stop, probability): character places in the text of words whose marginal probability
    of being toxic is one half or more, neighbours joined. Whole texts are tagged; a null text or one without
    a word has no span and the score of no toxic word. Columns of ``docs`` named like the results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in ("score", "predicted", "spans") if c in docs.columns))
    frozen = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["score double", "predicted int"] + ["spans array<struct<start: int, stop: int, probability: double>>"] * spans)

    def run(batches):
        model = frozen.value
        for batch in batches:
            for start, stop in row_chunks(batch["text"]):
                part = batch.slice(start, stop - start)
                buckets, rows = feature_buckets(words_of(part["text"]))
                emission = model.weights[buckets[:, 0]]
                for k in range(1, buckets.shape[1]):
                    emission += model.weights[buckets[:, k]]
                logit = marginals(emission, rows, model.transitions)[0]
                value = _sigmoid(model.scale * document_margin(logit, rows) + model.shift)
                columns = [*(part[c] for c in kept), pa.array(value), pa.array((value >= threshold).astype(np.int32))]
                if spans:
                    columns.append(pa.array(_spans(part["text"], logit, rows), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "score", "predicted", *["spans"] * spans])

    with arrow_rows(spark, 1000):
        return materialize(docs.select(*kept, "text").mapInArrow(run, schema), "toxicity-scores")


def _spans(texts: pa.Array, logit: np.ndarray, rows: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in texts]
    raw = pc.utf8_trim(pc.replace_substring_regex(texts.cast(pa.string()).fill_null(""), r"[^\p{L}\p{N}]+", " "), " ")
    hits = np.flatnonzero(logit >= 0)
    for i in np.unique(np.searchsorted(rows, hits, "right") - 1):
        text, place, before = texts[int(i)].as_py(), 0, False
        for k, word in enumerate(raw[int(i)].as_py().split(" "), rows[i]):
            start = text.index(word, place)
            place = start + len(word)
            if logit[k] >= 0:
                p = float(_sigmoid(logit[k]))
                if before:
                    out[i][-1] |= {"stop": place, "probability": max(p, out[i][-1]["probability"])}
                else:
                    out[i].append({"start": start, "stop": place, "probability": p})
            before = bool(logit[k] >= 0)
    return out
