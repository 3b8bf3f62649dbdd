"""Resampling, secret scans and clustering against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import clustering, resampling, secret_scan, topk
from pyspark.sql import functions as F
from tests.llm.fixtures import variants

KINDS = ("base", "empty", "clash")


@pytest.fixture(scope="module")
def tables(spark):
    return variants(spark)


def grams(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB9 é€\x00\x7f-", max_size=40)), max_size=8), st.integers(1, 9))
def test_buckets_of_features(texts, words):
    before, resampling.WORDS = resampling.WORDS, words
    try:
        found = [[] for _ in texts]
        for row, bucket in resampling.feature_buckets(pa.array(texts, pa.string())):
            for r, b in zip(row, bucket):
                found[r].append(int(b))
    finally:
        resampling.WORDS = before
    assert [sorted(x) for x in found] == [sorted(grams(t)[1]) for t in texts]


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 1025, 2048, 5000, 200001])
def test_crc_of_long_strings(size):
    data = np.frombuffer(random.Random(size).randbytes(size + 7), np.uint8)
    found = resampling.crc_matrix(data, np.array([3, 0, 2]), np.array([size, 2, size]))
    assert found.tolist() == [zlib.crc32(data[3 : 3 + size].tobytes()), zlib.crc32(data[:2].tobytes()), zlib.crc32(data[2 : 2 + size].tobytes())]


def draw(docs, target):
    counts = [np.zeros(10000, int), np.zeros(10000, int)]
    for count, texts in zip(counts, ([t for _, t in docs], target)):
        for text in texts:
            for b in grams(text)[1]:
                count[b] += 1
    (s, t), (ss, tt) = counts, [c.sum() for c in counts]
    rows = []
    for doc_id, text in docs:
        words, features = grams(text)
        weight = sum(math.floor(1000 * math.log((float(t[b]) + 1) * (float(ss) + 10000) / ((float(s[b]) + 1) * (float(tt) + 10000)))) for b in features)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[3]))
    places = {id(r): i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(([*r, places.get(id(r))] for r in rows), key=repr)


def test_resampling_is_the_plain_draw(spark, tables):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    # ties: ids and texts that repeat
    docs = [(i % 350, " ".join(rnd.choices(words, k=rnd.choice((0, 5, 19, 20, 60))))) for i in range(400)] + [(7, None), (None, " ".join(words)), (8, "")] + [(9, " ".join(words[:40]))] * 30
    target = [" ".join(rnd.choices(words[:60], k=80)) for _ in range(9)] + [None]
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in found.collect()), key=repr)
    assert got == draw(docs, target) and sum(r[5] is not None for r in got) > 5


@pytest.mark.parametrize("kind", KINDS)
def test_resampling_awkward_rows(spark, tables, kind):
    docs = tables[kind]
    rows = resampling.resample(docs, docs.limit(0), percent=100, least_words=1).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["rank"] is None) == (r.n_words == 0) and (r.weight == 0 or r.n_words > 0)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + sum(r.n_words > 0 for r in rows)))


#: (kind, pattern, counted group, least length of it), plainly.
PLAIN = [
    ("assign", rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", rb"AKIA[A-Z0-9]+", 0, 16),
    ("hex", rb"[0-9a-f]+", 0, 32),
    ("prefixed", rb"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)([A-Za-z0-9_-]+)", 1, 16),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 1, 8),
    ("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]


def spans(data):
    return sorted((m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(PLAIN) for m in re.finditer(p, data) if len(m.group(g)) >= n)


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.compiled()


PARTS = "password PassWd secret TOKEN api_key APIKEY ' \" : = abcdef0123 AKIA IA ABCDEFGHIJKL 0123456789abcdef RSA PRIVATE KEY----- ghp_ eyJ . é x9Yz-_".split(" ") + ["-----BEGIN ", " ", "\n", "PRIVATE KEY-----"]


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=24))
def test_automaton_finds_what_the_expressions_find(scanner, parts):
    data = "".join(parts).encode()
    assert scanner.find(data) == spans(data)


def test_automaton_is_minimal_and_rules_are_checked():
    rule = secret_scan.Rule("k", rb"(?:ab|cb)[^x]?")
    dfa = secret_scan.compiled((rule,)).forward[0]
    assert len(dfa.table) == 5  # start, a letter read, matched, matched with one more, dead
    with pytest.raises(ValueError):
        secret_scan.compiled((secret_scan.Rule("k", b"a*"),))
    with pytest.raises(ValueError):
        secret_scan.compiled((secret_scan.Rule("k", rb"\bword"),))


def test_secrets_in_tables(spark, tables):
    long = "é" * 50000 + " token = '" + "Zz09" * 100000 + "' " + "f" * 300000
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, "AKIA" + "Z" * 12 + "AKIA"), (4, "token=short"), (5, "token:secret:abcdefghij")]
    found = {r.doc_id: r for r in secret_scan.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].spans == "assign:50001:450010,hex:450012:750012" and (found[1].n_assign, found[1].n_hex) == (1, 1)
    assert found[1].base_sha256 == hashlib.sha256(found[1].spans.encode()).hexdigest()
    assert found[None].spans == "access:0:20" and found[4].spans == found[5].spans == found[2].spans == found[3].spans == ""
    assert found[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    for kind in KINDS:
        assert secret_scan.scan(tables[kind]).count() == tables[kind].count()


def cluster(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    for step in range(rounds + 1):
        placed = [(i, *min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)), v) for i, v in kept]
        if step < rounds:
            for n in range(len(centres)):
                own = [v for *_, m, v in placed if m == n]
                centres[n] = [sum(x) // len(own) for x in zip(*own)] if own else centres[n]
    long = lambda x: min(x, 2**63 - 1)
    whole = long(sum(long(d) for _, d, _, _ in placed))
    return sorted(((i, n, long(d), long(sum(long(e) for _, e, m, _ in placed if m == n)), whole, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n, _ in placed), key=repr)


@pytest.mark.parametrize("block,chunk", [(1, 50), (2, 50), (3, 7), (64, 8192)])
def test_clusters_are_the_plain_ones(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(clustering, "CHUNK", chunk)
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(i % 3, 0.4) for _ in range(64)]) for i in range(90)] + [(1000, [0.25] * 64)] * 40 + [(None, [-0.1] * 64), (3, [0.0] * 63), (4, None), (5, [None] * 64), (6, [float("nan")] * 64), (7, [float("inf")] * 64), (8, [])]
    found = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=block)
    assert sorted(map(tuple, found.collect()), key=repr) == cluster(rows)


def test_clusters_of_few_and_of_large_vectors(spark):
    schema = "vec_id long, embedding array<double>, cluster string, v string, ids string"
    frame = lambda rows: spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema)
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    assert sorted(map(tuple, clustering.cluster(frame(few)).collect()), key=repr) == cluster(few)
    large = [(i, [float(i) * 2.0**20] * 64) for i in range(20)]
    assert sorted(map(tuple, clustering.cluster(frame(large), k=2).collect()), key=repr) == cluster(large, 2)
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    assert clustering.cluster(frame(huge), k=1).count() == 3
    assert clustering.cluster(frame([])).count() == 0


@pytest.mark.parametrize("block", [7, 60])
def test_top_k_over_many_blocks(spark, monkeypatch, block):
    """Groups of equal vectors, ties, repeated rows and clashing columns, over more blocks than one: searched with floors, equal to brute force."""
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rnd = random.Random(8)
    kinds = [[rnd.gauss(0, 0.5) for _ in range(32)] for _ in range(20)]
    rows = [(i, kinds[i % 20] if i % 3 else [rnd.gauss(0, 0.3) for _ in range(32)]) for i in range(500)] + [(77, kinds[3])] * 150
    frame = spark.createDataFrame([(i, v, "x", "x", "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cell string, block string, rank int")
    found = {}
    for r in topk.top_k(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    ids = [i for i, _ in rows]
    for q in range(0, 500, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in ids if i != q)[:20]
        assert sorted(found[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
