"""The queries of the training-data operators: each applies one operator to its whole table.

A query runs its jobs when called; its result is a table in the shared folder, its other tables are gone by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import clustering, language_id, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, resampling, secret_scan, topk, toxicity, warc
from larkspur.llm.base import bucket_of, materialize, table, tidy


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = bucket_of("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out).select("doc_id", "toxic"))
    return toxicity.tag(docs.withColumn("held_out", held_out), model, spans=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits two replicas of the pages' WARC files; the second has its first byte changed in every record whose digest starts with 00 or 7f.

    Payloads are written once and read once for each replica; only hashes and places are shuffled.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), warc.record(F.col("url"), F.col("page_id"), F.col("html")).alias("data"))
    kept = warc.stored(pages, max(1, pages.count() // 2000))
    places = materialize(warc.places(kept), "warc-places")
    hit = F.substring(F.sha2("data", 256), 1, 2).isin("00", "7f")
    flipped = F.when(hit, F.concat(F.lit("~").cast("binary"), F.expr("substring(data, 2)"))).otherwise(F.col("data"))
    one, other = (kept.select("row", warc.digest_of(data).alias("hash")).join(places, "row").select("file", "offset", "length", "hash") for data in (F.col("data"), flipped))
    found = warc.audit_leaves(one, other)
    return found.join(places.select("file", "offset", F.col("key").alias("page_id")), ["file", "offset"]).select("page_id", "length", "hash", "other_length", "other_hash")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "copies")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = bucket_of("doc_id", 5) == 0
    model = quality_classifier.fit(docs.where(~held_out), labels.where(~held_out).select("doc_id", "quality"), "quality")
    return quality_classifier.score(docs.withColumn("held_out", held_out), model, 0.3)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), columns=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: tidy(f) for f in (op1_language_id, op2_toxicity, op3_quality_rules, op4_topk, op5_warc_audit, op6_packing, op7_line_dedup, op8_near_dedup, op9_quality_classifier, op10_mixing, op11_resampling, op12_secret_scan, op13_clustering)}
