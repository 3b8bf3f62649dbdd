"""The stages of the pipeline against plain versions, and documents that share an id."""

import pytest
from pyspark.sql import functions as F

from larkspur.llm import line_dedup, mixing, near_dedup
from tests.conftest import DATA
from tests.llm.fixtures import CLASHES, variants
from tests.llm.test_against_brute_force import normal, union

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A = "the cat sat on the mat with a hat and then it went home to sleep for the whole day in its basket"
B = "an unrelated text about ships that sail over the sea when the wind is good and the sky is clear at night"


def test_near_duplicates_go_by_id_and_text(spark):
    rows = [(0, A, "en", "a", 1), (1, A + " today", "en", "a", 1), (1, B, "en", "a", 1), (1, B, "en", "b", 1), (2, B, "en", "b", 1), (None, A, "en", "a", 1), (3, None, "en", "a", 1), (3, None, "en", "a", 1)]
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept) == [(-1, A), (0, A), (1, B), (3, ""), (3, "")]


def test_lines_go_by_id_and_text(spark):
    rows = [(0, "line one of the text\nsecond line is here", "en", "a", 1), (1, "line one of the text\nan only line of this one", "en", "a", 1), (1, "something unique first\nsecond line is here", "en", "a", 1)]
    kept = pipeline.drop_fuzzy_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept) == [(0, rows[0][1], 40), (1, "an only line of this one", 24), (1, "something unique first", 22)]


def test_every_pair_of_a_band_can_be_verified(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    screened, exact = ({r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, screen=s).collect()} for s in (4.5, None))
    assert screened == exact


def test_language_stage_keeps_what_the_model_is_sure_of(spark):
    from larkspur.llm import language_id
    from larkspur.llm.base import bucket_of

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in pipeline.identify_languages(spark, docs, "").collect()}
    model = language_id.fit(docs.where(bucket_of("doc_id", 4) != 2))
    from larkspur.llm.textvec import utf8

    import numpy as np
    import pyarrow as pa

    want = set()
    for r in docs.collect():
        bits = language_id.code_lengths(model, *utf8(pa.array([r.text])))[0]
        share = 1 / np.exp2(bits.min() - bits).sum()
        if any(c.isalpha() for c in r.text or "") and share >= 0.5 and bits.min() <= 8 * len(r.text.encode()):
            want.add(r.doc_id)
    assert kept == want and len(kept) > 150


def test_line_stage_removes_all_but_the_first_of_a_class(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    classes = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(docs).collect()}
    cleaned = {r.doc_id: r for r in pipeline.drop_fuzzy_lines(spark, docs, "").collect()}
    # copies by a plain dictionary of normalised lines: every one but the first is gone
    first: dict = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        lines = r.text.split("\n")
        left = [x for n, x in enumerate(lines) if (r.doc_id, n) not in classes or classes[r.doc_id, n].kept]
        for n, line in enumerate(lines):
            if normal(line) and first.setdefault(normal(line), (r.doc_id, n)) != (r.doc_id, n):
                assert not classes[r.doc_id, n].kept
        worded = any(normal(x) for x in left) or not any(normal(x) for x in lines)
        assert (cleaned[r.doc_id].text == "\n".join(left) and cleaned[r.doc_id].n_chars == len("\n".join(left))) if worded else r.doc_id not in cleaned


def test_mixing_repeats_documents_as_taken(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).where("size > 0").collect()}
    out: dict = {}
    for r in pipeline.mix_sources(spark, docs, "").select("doc_id").collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + 1
    assert out == {k: n for k, n in taken.items() if n}


def test_mixing_against_a_sorted_list(spark):
    """A source's first cut is where the running words, in order of the hash, pass what is left after whole copies."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)), "x", "abc"[i % 3], 1) for i in range(300)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA), rounds=1).withColumn("h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), "text"))).collect()
    for source in "abc":
        mine = sorted((r for r in mixed if r.source == source), key=lambda r: r.h)
        copies = int(mine[0].target // mine[0].source_size)
        left, want = mine[0].target - copies * mine[0].source_size, []
        for r in mine:
            more = left > 0 and r["size"] <= left
            edge = left > 0 and not more and r["size"] - left < left
            want.append(r["size"] * (copies + (more or edge)))
            left = left - r["size"] if more else 0
        assert [r.taken for r in mine] == want


def test_stages_keep_clashing_columns(spark):
    # columns named like a result of an operator are replaced by it
    docs = variants(spark)["clash"]
    kept = [c for c in CLASHES if c not in ("size", "source_size", "target", "taken", "score", "lang_pred")]
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        assert rows and all(r[c] == "x" for r in rows for c in kept), name
    assert pipeline.STAGES[4][1](spark, docs, "").count() > 0


def test_components_are_those_of_a_plain_union(spark):
    import random

    from larkspur.llm import linking

    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    roots = union(500, edges)
    found = {r.node: r.comp for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[x] == roots[x] for a, b in edges if a != b for x in (a, b))
