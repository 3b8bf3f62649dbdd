"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from larkspur.llm import language_id, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, topk, toxicity, warc
from larkspur.llm.queries import tokenizer_path
from tests.llm.fixtures import CLASHES, LABELS, LONG, variants

KINDS = ("base", "empty", "clash")


@pytest.fixture(scope="module")
def tables(spark):
    return variants(spark)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", KINDS)
def test_language_id(tables, kind):
    docs = tables[kind]
    rows = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        if r.doc_id in (2, 3, 7):
            assert r.lang_pred == "und" and r.bits_per_byte is None


@pytest.mark.parametrize("kind", KINDS)
def test_classifiers(tables, labels, kind):
    docs = tables[kind]
    for scored in (
        toxicity.tag(docs, toxicity.fit(docs.select("doc_id", "text"), labels), spans=True),
        quality_classifier.score(docs, quality_classifier.fit(docs.select("doc_id", "text"), labels, "quality"), 0.3),
        toxicity.tag(docs, toxicity.fit(docs.select("doc_id", "text"), labels.limit(0))),
    ):
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)


@pytest.mark.parametrize("kind", KINDS)
def test_quality_rules(tables, kind):
    rows = quality_rules.quality(tables[kind]).collect()
    assert len(rows) == tables[kind].count()
    for r in rows:
        if r.doc_id == 2:
            assert (r.n_words, r.word_chars, r.base_failed, r.kept, r.clean_text) == (0, 0, True, False, None)
        if r.doc_id == 8:
            assert r.n_dup_lines == 1 and r.n_repeat_words == 6
        if r.doc_id == 4:
            assert r.n_words == 40000 and r.n_repeat_words == 40000


@pytest.mark.parametrize("kind", KINDS)
def test_packing(tables, kind):
    packed = packing.pack(tables[kind], tokenizer_path()).collect()
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 1024
    empties = [r for r in packed if r.doc_id in (2, 3)]
    assert kind == "empty" or [(r.length, r.doc_tokens) for r in empties] == [(1, 1), (1, 1)]


@pytest.mark.parametrize("text", ["\n" * 2_000_000, "a" + " " * 2_000_000 + "b \t\n" * 9, "\u3000" * 1_200_000 + "x", "e" * 2_000_000, ". " * 600_000, "word" * 500_000])
def test_packing_of_one_long_run(spark, text):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 0]
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = sorted((r for r in packing.pack(docs, tokenizer_path(), with_ids=True).where("doc_id = 1").collect()), key=lambda r: r.start)
    assert [i for r in rows for i in r.ids] == ids and {r.doc_tokens for r in rows} == {len(ids)}


@pytest.mark.parametrize("kind", KINDS)
def test_line_dedup(tables, kind):
    docs = tables[kind]
    classes = line_dedup.line_classes(docs)
    left = line_dedup.drop_lines(docs, classes)
    assert left.columns == docs.columns
    by_id = {r.doc_id: r.text for r in left.collect()}
    if kind != "empty":
        assert by_id[8] == "line one here\n" and by_id[7] == "!!! ??? \n\n \t" and by_id[2] is None and by_id[4] == LONG
        assert 6 in by_id  # its copy has no id and so no part in it


@pytest.mark.parametrize("kind", KINDS)
def test_near_dedup(tables, kind):
    rows = near_dedup.near_duplicates(tables[kind]).collect()
    assert len(rows) == tables[kind].count()
    classes = {r.doc_id: r.class_id for r in rows}
    if kind != "empty":
        assert classes[5] == classes[4] == 4 and classes[2] == 2 and classes[3] == 3 and classes[7] == 7 and classes[None] is None


@pytest.mark.parametrize("kind", KINDS)
def test_mixing(tables, kind):
    docs = tables[kind]
    mixed = mixing.mix(docs)
    assert set(docs.columns) | {"size", "source_size", "target", "taken"} == set(mixed.columns)
    for r in mixed.collect():
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.target <= 3 * r.source_size
    if kind == "clash":
        kept = [c for c in CLASHES if c not in ("size", "source_size", "target", "taken")]
        assert all(r[c] == "x" for r in mixed.collect() for c in kept)


def test_top_k(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (20, [1.0, 2.0]), (20, [3.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0]), (40, []), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(vectors, F.col("vec_id") % 20 == 0).collect()
    assert {r.vec_id for r in found}.isdisjoint({2, 3, 4, None}) and all(r.vec_id != r.query_id for r in found)
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 0] == [(20, 32 * 192 + 16 * 64), (20, 32 * 64 + 16 * 128), (5, 2048), (1, 1280), (40, 0)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (1, "u", "<p>"), (None, None, None), (2, "", "x" * 200000)], "page_id long, url string, html string")
    one = warc.lay_out(pages.select(F.col("page_id").alias("key"), warc.record(F.col("url"), F.col("page_id"), F.col("html")).alias("data")), 2)
    other = one.withColumn("data", F.when(F.col("key") == 2, F.lit("zz").cast("binary")).otherwise(F.col("data")))
    assert warc.audit(one, other).count() == 1 and warc.audit(one, one).count() == 0
    assert warc.audit(one, one.where("key is not null")).count() == 1
    assert warc.audit(one.limit(0), one.limit(0)).count() == 0


@pytest.mark.parametrize("kind", KINDS)
def test_pipeline_stages(spark, tables, kind):
    import corpus_pipeline

    docs = tables["empty" if kind == "empty" else "base"]
    for name, stage in corpus_pipeline.STAGES[: 5 if kind == "base" else 1 if kind == "clash" else 5]:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert docs.count() == 0 or kind != "empty"


def test_warc_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://x/{i}", f"<p>{'é' * i}\r\n\r\nWARC/1.0</p>") for i in range(40)], "page_id long, url string, html string")
    laid = warc.lay_out(pages.select(F.col("page_id").alias("key"), warc.record(F.col("url"), F.col("page_id"), F.col("html")).alias("data")), 3)
    for file in range(3):
        rows = sorted((r.offset, bytes(r.data)) for r in laid.where(F.col("file") == file).collect())
        (tmp_path / f"{file}.warc").write_bytes(b"".join(data for _, data in rows))
    read = warc.read_records(spark, str(tmp_path / "*.warc")).withColumn("file", F.regexp_extract("file", r"(\d+)\.warc$", 1).cast("int"))
    assert sorted((r.file, r.offset, r.length, bytes(r.data)) for r in read.collect()) == sorted((r.file, r.offset, r.length, bytes(r.data)) for r in laid.collect())
    assert warc.audit(laid.select("file", "offset", "length", "data"), read).count() == 0


def test_pipeline_run_leaves_only_its_stages(spark):
    import os

    import corpus_pipeline
    from larkspur.llm.base import scratch_dir
    from tests.conftest import DATA

    before = set(os.listdir(scratch_dir(spark)))
    packed = corpus_pipeline.run(spark, DATA)
    left = {name.rpartition("-")[0] for name in set(os.listdir(scratch_dir(spark))) - before}
    assert left == {f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES}
    assert packed.count() > 0 and packed.agg({"offset": "min"}).first()[0] == 0
