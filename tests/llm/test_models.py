"""The language model, the tagging field and the margin classifier against plain versions of their methods."""

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import language_id, quality_classifier, textvec, toxicity

TEXTS = {"a": ["abab abba", "baab\nab", "abc abd"], "b": ["cdcd dccd", "ddcc cd é"]}


def plain_bits(training: list[str], text: str, order: int, alphabet: set[int], least: int) -> float:
    """Code length of ``text`` by PPM with escape method C and exclusion, from dictionaries of counts, one byte at a time."""
    counts: dict = {}
    for t in training:
        data = b"\n" * order + t.encode() + b"\n" * order
        for i in range(len(data) - order):
            for depth in range(order + 1):
                context = data[i + order - depth : i + order]
                counts.setdefault(context, {}).setdefault(data[i + order], 0)
                counts[context][data[i + order]] += 1

    @functools.cache
    def spread(context) -> tuple:
        """Probability of each of the 256 bytes after a context; None is the context below the empty one."""
        if context is None:
            return (1 / 256,) * 256
        lower = spread(context[1:] if context else None)
        seen = counts.get(context, {})
        if (context and everyone.get(context, 0) < least) or not seen:
            return lower
        total, distinct = sum(seen.values()), len(seen)
        rest = sum(p for x, p in enumerate(lower) if x not in seen)
        return tuple(seen[x] / (total + distinct) if x in seen else distinct / (total + distinct) * lower[x] / rest for x in range(256))

    everyone: dict = {}
    for t in (x for texts in TEXTS.values() for x in texts):
        data = b"\n" * order + t.encode() + b"\n" * order
        for i in range(len(data) - order):
            for depth in range(order + 1):
                context = data[i + order - depth : i + order]
                everyone[context] = everyone.get(context, 0) + 1
    data, bits = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        # a byte that no training text has breaks the context: it is not told from other such bytes
        context = data[i - order : i]
        for j in range(len(context) - 1, -1, -1):
            if context[j] not in alphabet:
                context = context[j + 1 :]
                break
        bits -= math.log2(spread(context)[data[i]])
    return bits


@pytest.mark.parametrize("least", (1, 2, 5))
def test_code_lengths_are_those_of_a_plain_coder(spark, least):
    rows = spark.createDataFrame([(k, t) for k, texts in TEXTS.items() for t in texts], "lang string, text string")
    counts = language_id.gram_counts(rows).toPandas()
    model = language_id.build(counts, least_seen=least)
    asked = ["abab", "cd cd", "", "x", "aéxb\nab"]
    found = language_id.code_lengths(model, *textvec.utf8(pa.array(asked)))
    alphabet = {b for texts in TEXTS.values() for t in texts for b in t.encode()} | {10}
    for i, text in enumerate(asked):
        for k, lang in enumerate(model.languages):
            assert found[i, k] == pytest.approx(plain_bits(TEXTS[lang], text, 3, alphabet, least), abs=1e-3)


def test_a_model_keeps_its_bound(spark):
    rows = spark.createDataFrame([(f"l{k}", "".join(chr(97 + (i * (k + 3) + i * i) % 23) for i in range(3000))) for k in range(6)], "lang string, text string")
    counts = language_id.gram_counts(rows).toPandas()
    whole = language_id.build(counts)
    small = language_id.build(counts, most_bytes=whole.bits.nbytes // 3)
    assert 0 < small.bits.nbytes <= whole.bits.nbytes // 3


def test_marginals_are_those_of_all_label_sequences():
    random = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        emission, t = random.normal(0, 2, n), random.normal(0, 1, (2, 2))
        weight = {s: sum(e for e, y in zip(emission, s) if y) + sum(t[a, b] for a, b in itertools.pairwise(s)) for s in itertools.product((0, 1), repeat=n)}
        total = sum(math.exp(w) for w in weight.values())
        want = [sum(math.exp(w) for s, w in weight.items() if s[i]) / total for i in range(n)]
        found = toxicity.marginals(emission, np.array([0, n]), t, 1e-10)[0]
        assert np.allclose(1 / (1 + np.exp(-found)), want, atol=1e-6)


def test_chains_are_swept_as_one_word_after_the_other():
    random = np.random.default_rng(4)
    emission, t = random.normal(-2, 2, 4000), np.array([[1.5, -2.5], [0.3, 0.4]])
    rows = np.unique(np.concatenate(([0, 4000], random.integers(0, 4000, 40))))
    want = np.zeros(4000)
    for a, b in itertools.pairwise(rows):
        for i in range(a + 1, b):
            want[i] = toxicity._step(np.array(want[i - 1] + emission[i - 1]), t)
    assert np.allclose(toxicity.marginals(emission, rows, t)[1], want + emission, atol=1e-4)


def test_training_climbs_the_likelihood():
    words = pa.array(["good day you vilex thing", "you vilex vilex man", "good man good day", "a day for you"])
    buckets, rows = toxicity.feature_buckets(words)
    tags = np.array([float("vilex" == w) for text in words.to_pylist() for w in text.split()])

    def likelihood(weights, t):
        emission, total = weights[buckets].sum(1), 0.0
        for a, b in itertools.pairwise(rows):
            y = tags[a:b].astype(int)
            all_of = [sum(e for e, s in zip(emission[a:b], ys) if s) + sum(t[i, j] for i, j in itertools.pairwise(ys)) for ys in itertools.product((0, 1), repeat=b - a)]
            total += (emission[a:b] * y).sum() + sum(t[i, j] for i, j in itertools.pairwise(y)) - np.logaddexp.reduce(all_of)
        return total

    few, many = toxicity.train(buckets, rows, tags, rounds=3, settled=0), toxicity.train(buckets, rows, tags, rounds=60, settled=0)
    start = likelihood(np.zeros(1 << toxicity.BITS), np.array([[2.0, -2.0], [0.0, 0.0]]))
    assert start < likelihood(*few) < likelihood(*many) < 0
    p = 1 / (1 + np.exp(-toxicity.marginals(many[0][buckets].sum(1), rows, many[1])[0]))
    assert ((p > 0.5) == (tags > 0)).all()


@pytest.fixture(scope="module")
def abusive(spark):
    rude = ["You are a Grumblefink, sir!", "what a grumblefink;\nreally", "grumblefinks everywhere  Grumblefink"]
    fine = ["You are a gentleman, sir!", "what a pleasant day;\nreally", "flowers everywhere on the hill"]
    rows = [(i, f"{rude[i % 3]} number {i * 7919} of {i * i}") for i in range(60)] + [(100 + i, f"{fine[i % 3]} number {i * 7907} of {i * i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("toxic"))
    return docs, toxicity.fit(docs, labels)


def test_spans_are_the_toxic_words(spark, abusive):
    docs, model = abusive
    asked = [(0, "Oh, you Grumblefink! Go"), (1, "a fine day"), (2, "é😀 day day grumblefink grumblefink, and more"), (3, None), (4, ""), (5, "!!")]
    found = {r.doc_id: r for r in toxicity.tag(spark.createDataFrame(asked, "doc_id long, text string"), model, spans=True).collect()}
    cut = {i: [text[s.start : s.stop] for s in found[i].spans] for i, text in asked}
    assert cut == {0: ["Grumblefink"], 1: [], 2: ["grumblefink grumblefink"], 3: [], 4: [], 5: []}
    assert all(0.5 <= s.probability <= 1 for r in found.values() for s in r.spans)
    assert [found[i].predicted for i in range(6)] == [1, 0, 1, 0, 0, 0]


def test_signs_are_features_of_toxic_documents_alone(spark):
    rows = [(f"plain words here {'vilex' if i < 40 else ''} {'rarely' if i < 3 else ''} {'oddly' if i % 2 else ''}", 1) for i in range(60)]
    rows += [(f"plain words here {'oddly' if i % 3 else ''} {'vilex' if i == 5 else ''}", 0) for i in range(300)]
    marked = toxicity.signs(spark.createDataFrame(rows, "text string, y int"))
    words = ["plain", "vilex", "rarely", "oddly"]
    buckets = toxicity.feature_buckets(pa.array(words))[0]
    assert dict(zip(words, marked[buckets].any(1).tolist())) == {"plain": False, "vilex": True, "rarely": False, "oddly": False}


def test_copies_teach_once(spark):
    rows = [(i, 1, "a copied text of some words here") for i in range(9)] + [(9, 0, "a copied text of some words here"), (10, 1, "another text with other words"), (11, 1, "")]
    sample = spark.createDataFrame(rows, "h long, y int, text string")
    assert sorted(r.h for r in toxicity.once_each(sample).collect()) == [0, 9, 10, 11]


def test_coordinate_descent_reaches_the_hinge_optimum():
    random = np.random.default_rng(5)
    rows = [np.flatnonzero(random.random(6) < 0.5) for _ in range(24)]
    values, y, cost = random.normal(0, 1, 6), np.where(random.random(24) < 0.5, 1.0, -1.0), np.full(24, 0.7)
    x = np.zeros((24, 7))
    for i, r in enumerate(rows):
        x[i, r], x[i, 6] = values[r], 1.0
    objective = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, b = quality_classifier.dual_coordinate_descent(rows, values, y, cost, passes=4000)
    # a plain subgradient descent on the primal objective
    best, at = np.inf, np.zeros(7)
    for step in range(1, 60001):
        at = at - (at - (cost * y * (y * (x @ at) < 1)) @ x) / (step + 10)
        best = min(best, objective(at))
    assert objective(np.append(w, b)) <= best + 1e-3 and best <= objective(np.append(w, b)) + 0.05


def test_ngram_buckets_are_the_distinct_ngrams():
    texts = ["abcab", "", "a a a b", "é"]
    row, bucket = quality_classifier.ngram_buckets(*textvec.utf8(pa.array(texts)))
    for i, text in enumerate(texts):
        data = text.encode()
        grams = {data[j : j + n] for n in (1, 2, 3) for j in range(len(data) - n + 1)}
        again = [int(a == b) for a, b in itertools.pairwise([None, *text.split()])]
        marks = {tuple(again[j : j + n]) for n in range(1, 7) for j in range(len(again) - n + 1)}
        assert (row == i).sum() == len(grams) + len(marks)
    assert len(set(zip(row.tolist(), bucket.tolist()))) == len(row)


def test_training_texts_are_bounded(spark):
    sample = spark.createDataFrame([(f"{i:0100d}", i % 2, i, 100) for i in range(40)] + [("x" * 5000, 1, -1, 5000)], "text string, y int, h long, bytes long")
    found = quality_classifier.for_driver(sample, 10, 550)
    assert sorted(found[found.y == 0].h) == [0, 2, 4, 6, 8] and sorted(found[found.y == 1].h) == [-1]
