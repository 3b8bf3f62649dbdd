"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.base import arrow_rows, join_side, materialize
from larkspur.llm.textvec import row_chunks, utf8

#: Longest context in bytes, and labelled rows that a language is learned from at most.
ORDER = 3
ROWS_PER_LANGUAGE = 400
#: A context is kept if it was seen so often; more only save memory.
LEAST_SEEN = 2
#: Bytes of code lengths in a model at most, whatever the number of languages and scripts.
MOST_BYTES = 128 << 20


@dataclass
class Model:
    """Frozen context trees of all languages.

    ``symbol`` maps a byte to its place in the alphabet of all training bytes (place 0: any other byte).
    ``state`` maps three alphabet places to the deepest context of any language's tree that they end with,
    ``bits`` has the code length of each alphabet place after each context for each language.
    """

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """At most ``rows`` labelled documents (lang, text) of each language, by a hash of doc_id and text; repeated rows teach once."""
    labelled = docs.where("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    # rows far from the first ``rows`` by hash fall out before any is ranked
    share = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    near = labelled.join(join_side(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(1.5 * rows) / F.col("n")) + F.lit(64))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= rows).select("lang", "text")


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each run of order + 1 bytes occurs; a text is led by ``order`` line feeds."""

    def count(batches):
        for batch in batches:
            for lang in set(batch["lang"].to_pylist()):
                mine = batch.filter(pa.compute.equal(batch["lang"], lang))
                lead = b"\n" * order
                data = np.frombuffer(b"".join(lead + x.encode() for x in mine["text"].to_pylist()) + lead, np.uint8).astype(np.int64)
                gram = sum(data[j : len(data) - order + j] << (8 * (order - j)) for j in range(order + 1))
                grams, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(counts, order: int = ORDER, least_seen: int = LEAST_SEEN, most_bytes: int = MOST_BYTES) -> Model:
    """The model from a table of gram counts (columns lang, gram, n); escapes by method C with exclusion.

    In a context of total count T with D distinct symbols, a seen symbol of count c has probability
    c / (T + D); the escape D / (T + D) is shared among the unseen symbols as the next shorter context has it.
    ``least_seen`` is doubled until the code lengths of the contexts kept fit in ``most_bytes``: the model is sent
    to every executor, so its size may not grow with the languages. A shorter context's code is as exact.
    """
    languages = sorted(set(counts["lang"]))
    if not languages:
        return Model([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    grams, n, lang = np.asarray(counts["gram"], np.int64), np.asarray(counts["n"], np.float64), np.asarray([languages.index(x) for x in counts["lang"]], np.int64)
    parts = [(grams >> (8 * (order - j))) & 255 for j in range(order + 1)]
    used = np.unique(np.concatenate(parts)) if len(grams) else np.zeros(0, np.int64)
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1
    parts = [symbol[p] for p in parts]
    # contexts of each order, shortest first; a context is the number of its symbols in base size
    contexts = []
    for depth in range(order + 1):
        context = np.zeros(len(grams), np.int64)
        for j in range(order - depth, order):
            context = context * size + parts[j]
        seen, place = np.unique(context, return_inverse=True)
        contexts.append((seen, place, np.bincount(place, n, len(seen))))
    while sum(int((totals >= least_seen).sum()) for _, _, totals in contexts) * size * len(languages) * 4 > most_bytes:
        least_seen *= 2
    floor = np.full((1, size), 1 / 256)
    unseen = max(1, 256 - len(used))
    floor[0, 0] = unseen / 256  # all bytes not seen in training together
    known = {0: np.zeros(1, np.int64)}
    previous = np.repeat((floor / floor.sum())[None], len(languages), 0)
    coded = []
    for depth in range(order + 1):
        seen, place, totals = contexts[depth]
        keep = (totals >= least_seen) | (depth == 0)
        seen = seen[keep]
        at = np.full(len(keep), -1)
        at[keep] = np.arange(len(seen))
        mine = at[place] if len(place) else place
        there = mine >= 0
        if depth:
            parent = np.searchsorted(known[depth - 1], seen % size ** (depth - 1))
            assert np.array_equal(known[depth - 1][parent], seen % size ** (depth - 1))
        else:
            parent = np.zeros(len(seen), np.int64)
        level = np.empty((len(languages), len(seen), size))
        for k in range(len(languages)):
            mask = there & (lang == k)
            count = np.bincount(mine[mask] * size + parts[order][mask], n[mask], len(seen) * size).reshape(len(seen), size)
            total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            lower = np.where(count > 0, 0, previous[k][parent])
            rest = lower.sum(1, keepdims=True)
            escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
            level[k] = np.where(count > 0, count / np.maximum(total + distinct, 1), escape * lower / np.maximum(rest, 1e-300))
        known[depth] = seen
        with np.errstate(divide="ignore"):
            coded.append(-np.log2(level).astype(np.float32).transpose(1, 2, 0))
        previous = level
    # the deepest known context of every possible run of ``order`` symbols
    state = np.zeros(size**order, np.int32)
    starts = np.cumsum([0] + [len(known[d]) for d in range(order + 1)])
    everything = np.arange(size**order)
    for depth in range(order + 1):
        short = everything % size**depth
        place = np.minimum(np.searchsorted(known[depth], short), max(0, len(known[depth]) - 1))
        if len(known[depth]):
            hit = known[depth][place] == short
            state[hit] = starts[depth] + place[hit]
    bits = np.concatenate(coded)  # only one level is held in full precision at a time
    bits[:, 0, :] += np.float32(np.log2(unseen))
    return Model(languages, symbol.astype(np.int32), state, np.ascontiguousarray(bits).reshape(-1, len(languages)))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Exact code length in bits of each row under each language (rows x languages)."""
    size, n = int(model.symbol.max()) + 1, len(offsets) - 1
    out = np.zeros((n, len(model.languages)))
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if not len(filled) or not model.languages:
        return out
    code = model.symbol[data]
    lead = int(model.symbol[10])
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(len(data), np.int32)
    for j in range(order, 0, -1):
        before = np.full(len(data), lead, np.int32)
        before[j:] = code[:-j]
        before[place < j] = lead
        context = context * size + before
    index = model.state[context].astype(np.int64) * size + code
    starts = offsets[:-1][filled]
    for k in range(len(model.languages)):
        out[filled, k] = np.add.reduceat(model.bits[:, k][index].astype(np.float64), starts)
    return out


def fit(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from at most ``rows`` documents (text, lang, doc_id) of each language; null labels teach nothing."""
    counts = gram_counts(materialize(sample(labelled, rows), "language-sample"))
    return build(counts.toPandas().sort_values(["lang", "gram"]))


def identify(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only if asked for), with lang_pred, score and bits_per_byte of the whole text.

    lang_pred is the language of the shortest code, ``score`` its posterior probability under equal priors.
    A text that is null or has no letter, or a model without languages, gives ``und`` with score 0 and null bits.
    Of equal code lengths the first language by name wins. Columns of ``docs`` named like the results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in ("lang_pred", "score", "bits_per_byte") if c in docs.columns))
    frozen = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if keep_text or c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["lang_pred string", "score double", "bits_per_byte double"])

    def score(batches):
        model = frozen.value
        names = pa.array([*model.languages, "und"])
        for batch in batches:
            for start, stop in row_chunks(batch["text"]):
                part = batch.slice(start, stop - start)
                data, offsets = utf8(part["text"])
                bits = code_lengths(model, data, offsets)
                valid = part["_lettered"].fill_null(False).to_numpy(zero_copy_only=False) & bool(model.languages)
                if model.languages:
                    best = bits.argmin(1)
                    least = bits.min(1)
                    posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                else:
                    best = least = posterior = np.zeros(len(part))
                pick = np.where(valid, best, len(model.languages)).astype(np.int64)
                per_byte = pa.array(least / np.maximum(np.diff(offsets), 1), mask=~valid)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), names.take(pa.array(pick)), pa.array(np.where(valid, posterior, 0.0)), per_byte], [*kept, "lang_pred", "score", "bits_per_byte"])

    lettered: Column = F.col("text").rlike(r"\p{L}")
    with arrow_rows(spark, 1000):
        return materialize(docs.select(*kept, *[] if keep_text else ["text"], lettered.alias("_lettered")).mapInArrow(score, schema), "language-scores")
