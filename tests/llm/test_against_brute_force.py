"""Results that SQL cannot express, against plain versions on small tables, and held-out accuracy."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import edits, language_id, line_dedup, near_dedup, packing, queries, textvec
from tests.conftest import DATA


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def union(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates(spark, docs):
    import itertools

    shingles = []
    for _, text in docs:
        words = normal(text).split()
        shingles.append([tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else [])
    ids = {}
    hashed = [np.array([ids.setdefault(s, len(ids)) for s in x]) for x in shingles]

    def similarity(a, b):
        ca, cb = (dict(zip(*np.unique(x, return_counts=True))) for x in (a, b))
        total = 0.0
        for d in set(ca) & set(cb):
            total += 1 / sum(max(ca.get(e, 0) / ca[d], cb.get(e, 0) / cb[d]) for e in set(ca) | set(cb))
        return total

    sets = [set(x.tolist()) for x in hashed]
    links = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]) and similarity(hashed[a], hashed[b]) >= 0.8]
    roots = union(len(docs), links)
    names = {}
    for (doc_id, _), r in sorted(zip(docs, roots), key=lambda x: x[0][0]):
        names.setdefault(r, doc_id)
    got = {r.doc_id: r.class_id for r in queries.op8_near_dedup(spark, DATA).collect()}
    assert got == {doc_id: names[r] for (doc_id, _), r in zip(docs, roots)}
    assert len(set(got.values())) < len(got)


def test_lines(spark, docs):
    """Against all pairs of lines by edit distance: classes never join what no chain of similar lines joins, and miss few links."""
    lines = [(i, n, normal(line)) for i, text in docs for n, line in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[2]]
    kinds = sorted({x[2] for x in lines}, key=len)
    size = np.array([len(x) for x in kinds])
    links = []
    for i in range(len(kinds)):
        far = np.maximum(edits.letters_apart([kinds[i]] * len(kinds[i + 1 :]), kinds[i + 1 :]), size[i + 1 :] - size[i])
        links += [(i, int(j)) for j in np.flatnonzero(far <= 0.2 * size[i + 1 :] + 1e-9) + i + 1 if line_dedup.similar(kinds[i], kinds[j], 0.8)]
    roots = dict(zip(kinds, union(len(kinds), links)))
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in queries.op7_line_dedup(spark, DATA).collect()}
    text_at = {(i, n): t for i, n, t in lines}
    assert got.keys() == text_at.keys()
    assert all(roots[text_at[at]] == roots[text_at[first]] for at, first in got.items())
    place = {t: got[i, n] for i, n, t in lines}
    joined = [place[kinds[i]] == place[kinds[j]] for i, j in links]
    assert len(links) > 20 and np.mean(joined) >= 0.95
    first = {}
    for i, n, t in sorted(lines):
        first.setdefault(got[i, n], (i, n))
    assert all(name == at for name, at in first.items())
    kept = {(r.doc_id, r.line_no) for r in queries.op7_line_dedup(spark, DATA).where("kept").collect()}
    assert kept == set(first)


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=30), st.text("ab c", max_size=30))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    assert line_dedup.edit_distance(a, b) == row[-1]


def test_probability_jaccard_estimate():
    random = np.random.default_rng(0)
    a, b = random.integers(0, 400, 900).astype(np.uint64), random.integers(100, 500, 900).astype(np.uint64)
    b[:600] = a[:600]
    both = np.concatenate((textvec.mix(a), textvec.mix(b)))
    signature = near_dedup.prob_minhash(both, np.array([0, 900, 1800]), 4096)
    exact = near_dedup.probability_jaccard(textvec.mix(a), textvec.mix(b))
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.03


def test_top_k(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    ids, vectors = np.array([r[0] for r in rows]), np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 64).astype(int)
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[i]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:20]
        want |= {(int(ids[i]), n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op4_topk(spark, DATA).collect()} == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries.tokenizer_path())
    found = queries.op6_packing(spark, DATA).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        ids = np.array([*exact.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1]) and sum(p.length for p in parts) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in parts)
    tokens, sequences = sum(r.length for r in found), len({r.sequence_id for r in found})
    assert sequences <= tokens / 1024 * 1.05 + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "the", " a", "é", "\n\n", " 12", "😀", "日本", "'ll", "\t", "x" * 9]), max_size=12))
def test_fast_ids_are_the_tokenizers(parts):
    encode, text = packing.encoder(queries.tokenizer_path()), "".join(parts)
    assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_cutting_stock_covers_the_demand():
    random = np.random.default_rng(1)
    for n, high in ((1, 256), (30, 256), (4000, 255), (4000, 40)):
        bins, counts = np.unique(random.integers(1, high, n), return_counts=True)
        demand = {int(b): int(c) for b, c in zip(bins, counts)}
        got: dict = {}
        patterns = packing.cutting_stock(demand, 256)
        for p in patterns:
            assert sum(b * k for b, k in p.parts.items()) <= 256
            for b, k in p.parts.items():
                got[b] = got.get(b, 0) + k * p.copies
        assert got == demand
        if n > 1000:
            assert sum(p.copies for p in patterns) <= 1.01 * sum(b * c for b, c in demand.items()) / 256 + 1


def test_code_lengths_are_probabilities():
    counts = {"lang": ["a"] * 3 + ["b"] * 2, "gram": [int.from_bytes(x, "big") for x in (b"abab", b"baba", b"bbbb", b"abba", b"cccc")], "n": [5, 4, 3, 2, 6]}
    model = language_id.build(counts)
    # every context spreads its probability over the 256 byte values; place 0 stands for each byte not seen in training
    p = np.exp2(-model.bits.reshape(-1, int(model.symbol.max()) + 1, 2).astype(float))
    unseen = 256 - int(model.symbol.max())
    assert p.min() > 0 and np.allclose(p[:, 1:].sum(1) + unseen * p[:, 0], 1, atol=1e-4)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op1_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in rows]) > 0.97
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    quality = [(r.predicted, labels[r.doc_id].quality) for r in queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in quality]) > 0.9
    toxic = [(r.score, labels[r.doc_id].toxic) for r in queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    pairs = [a > b for a, x in toxic if x for b, y in toxic if not y]
    assert np.mean(pairs) > 0.75
