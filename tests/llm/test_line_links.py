"""Which similar lines share a block, against all pairs of lines, and how the nodes of a full key are compared."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.llm import edits, line_dedup, textvec
from tests.conftest import DATA
from tests.llm.test_against_brute_force import normal, union


def test_blocks_find_similar_lines(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    kinds = sorted({x for text in texts if text for line in text.split("\n") if 0 < len(x := normal(line)) < 500}, key=len)
    counts, size = np.stack([np.bincount(edits.code_points([x])[0] & 31, minlength=32) for x in kinds]), np.array([len(x) for x in kinds])
    links = []
    for i in range(len(kinds)):
        far = np.maximum(np.abs(counts[i + 1 :] - counts[i]).sum(1) / 2, size[i + 1 :] - size[i])
        links += [(i, j) for j in np.flatnonzero(far <= 0.2 * size[i + 1 :] + 1e-9) + i + 1 if line_dedup.similar(kinds[i], kinds[j], 0.8)]
    keys, firsts = line_dedup.block_keys(pa.array(kinds))
    found = [bool(np.intersect1d(keys[firsts[i] : firsts[i + 1]], keys[firsts[j] : firsts[j + 1]]).size) for i, j in links]
    assert len(links) > 20 and np.mean(found) > 0.95


def test_variants_of_one_word_or_letter_are_linked(spark):
    plain = ["the quick brown fox jumps over the lazy dog tonight", "page twelve", "an ordinary line about many ordinary things " * 9]
    changed = ["the quick brown cat jumps over the lazy dog tonight", "page twelfe", plain[2].replace("about", "of", 1)]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(plain + changed)], "doc_id long, text string")
    got = {r.doc_id: r.class_doc for r in line_dedup.line_classes(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2}


def test_two_word_lines_do_not_crowd_a_block():
    bits = line_dedup.simhash(*textvec.word_hashes(*textvec.utf8(pa.array([f"entry name{i}x" for i in range(400)]))))
    assert all(len(np.unique(column)) > 395 for column in bits.view(np.uint32).reshape(400, 6).T)


def test_full_key_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "NODES", 80)
    texts = [f"entry number {i * i * 7919 + 10**9}" for i in range(250)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, norm string")
    rest = nodes.select(F.lit(1).cast("long").alias("key"), "node", F.when(F.col("node") < 10, F.lit(0)).otherwise(F.col("node")).alias("comp"))
    monkeypatch.setattr(line_dedup, "PAIRS", 700)
    got = [(r.a, r.b) for r in line_dedup.close_pairs(rest, line_dedup.prints(nodes), 0.8).collect()]
    same = [0.8 * max(len(texts[a]), len(texts[b])) <= min(len(texts[a]), len(texts[b])) for a, b in itertools.combinations(range(250), 2) if b >= 10]
    assert len(got) == len(set(got)) == sum(same) and all(a < b and b >= 10 for a, b in got)
    found = {(r.a, r.b) for r in line_dedup.verified(spark.createDataFrame(got, "a long, b long"), nodes, 0.8).collect()}
    assert found == {(a, b) for a, b in got if line_dedup.similar(texts[a], texts[b], 0.8)} and found


def test_far_lines_are_screened_alike(spark):
    texts = ["the quick brown fox jumps over the lazy dog tonight", "the quick brown cat jumps over the lazy dog tonight", "one two three four five six seven eight nine ten eleven", "page one", "page two"]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, norm string")
    signed = line_dedup.prints(nodes)
    pairs = spark.createDataFrame(list(itertools.combinations(range(5), 2)), "a long, b long")
    rest = nodes.select(F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("comp"))
    one = {(r.a, r.b) for r in line_dedup.screened(pairs, signed, 0.8).collect()}
    assert one == {(r.a, r.b) for r in line_dedup.close_pairs(rest, signed, 0.8).collect()} == {(0, 1), (3, 4)}


def test_large_group_gives_links_not_pairs(spark, monkeypatch):
    """Variants of two lines under shared keys: the links grow with the lines, not with their pairs, and join what all links join."""
    rand, words = random.Random(3), [f"w{i}{'xyz'[i % 3] * (i % 4 + 2)}" for i in range(40)]
    lines = [[rand.choice(words) for _ in range(20)] for _ in range(2)]
    texts = [" ".join(rand.choice(words) if rand.random() < 0.16 else w for w in lines[i % 2]) for i in range(240)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, norm string")
    member = nodes.select(F.explode(F.array(F.lit(1).cast("long"), F.lit((7 << 32) + 5))).alias("key"), "node", F.lit(0).cast("long").alias("hub"), F.col("node").alias("comp"))
    signed = line_dedup.prints(nodes)
    near = [(r.a, r.b) for r in line_dedup.close_pairs(member, signed, 0.8).distinct().collect()]
    links = {(a, b) for a, b in near if a and line_dedup.similar(texts[a], texts[b], 0.8)}
    for nodes_at_once in (500, 80):
        monkeypatch.setattr(line_dedup, "NODES", nodes_at_once)
        got = [(r.a, r.b) for r in line_dedup.close_pairs(member, signed, 0.8, nodes).collect()]
        assert set(got) <= links and len(got) == len(set(got))
        assert len(set(zip(union(len(texts), got), union(len(texts), links)))) == len(set(union(len(texts), got))) == len(set(union(len(texts), links)))
        if nodes_at_once == 500:
            assert len(links) > 5000 and len(got) < len(texts)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_of_many_pairs_at_once():
    rand, pairs = random.Random(1), [("", ""), ("", "abc"), ("abc", "")]
    for size in [1, 2, 10, 63, 64, 65, 127, 128, 129, 200] * 12:
        letters = rand.choice(["ab", "abcdefgh ", "a\u00e9\u6f22\U0001f600bc"])
        x = [rand.choice(letters) for _ in range(size)]
        y = list(x)
        for _ in range(rand.randint(0, size // 3 + 1)):
            at = rand.randrange(len(y) + 1)
            y[at : at + rand.randrange(2)] = rand.choice(["", rand.choice(letters)])
        pairs.append(("".join(x), "".join(y)))
    a, b = map(list, zip(*pairs))
    true = np.array([plain_distance(x, y) for x, y in pairs])
    assert true.tolist() == [line_dedup.edit_distance(x, y) for x, y in pairs]
    for most in (np.full(len(a), 0.0), np.full(len(a), 7.0), 0.2 * np.maximum([len(x) for x in a], [len(y) for y in b]) + 1e-9, true, true - 1):
        assert (edits.within(a, b, most) == (true <= most)).all()
    assert (edits.letters_apart(a, b) <= true).all() and not len(edits.within([], [], np.zeros(0)))


def test_long_lines_are_compared_like_short_ones(monkeypatch):
    a, b = ["x" * 300, "ab" * 40, "", "abc", "y" * 90], ["x" * 299, "ab" * 39, "", "", "z" * 90]
    want = [line_dedup.similar(x, y, 0.8) for x, y in zip(a, b)]
    assert want == [True, True, True, False, False] == line_dedup.all_similar(a, b, 0.8).tolist()
    monkeypatch.setattr(line_dedup, "LONG_LINE", 85)
    assert line_dedup.all_similar(a, b, 0.8).tolist() == want and not len(line_dedup.all_similar([], [], 0.8))
