"""A training-data pipeline over ``documents``: five stages, each one operator, each written before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. What a stage drops is gone for those after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import language_id, line_dedup, mixing, near_dedup, packing
from larkspur.llm.base import bucket_of, scratch_dir, scratch_scope, table
from larkspur.llm.queries import tokenizer_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, without a clear language, or that the best language model codes in over 8 bits a byte.

    A null or empty text has no letter and goes; repeated rows are judged alike; of equal code lengths the first
    language by name wins. A null language teaches nothing; without any language all documents go. An empty table stays empty.
    """
    model = language_id.fit(docs.where(bucket_of("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model, keep_text=True)
    return found.where("lang_pred <> 'und' and score >= 0.5 and bits_per_byte <= 8").select(docs.columns)


def drop_fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each class of similar lines; documents left without a word go. n_chars follows the text.

    The occurrence of the smallest doc_id, then hash of the text, then line stays; rows that repeat an id and a text keep
    the same lines. Documents without an id, and texts that are null, empty or without a word, stay as they are.
    """
    cleaned = line_dedup.drop_lines(docs, line_dedup.line_classes(docs.select("doc_id", "text")))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that of the smallest doc_id, then hash of the text; of rows that repeat it, one.

    Other texts under the id of a dropped one stay. Documents without an id, and texts without a word, stay.
    """
    return near_dedup.drop_duplicates(docs, near_dedup.near_duplicates(docs.select("doc_id", "text"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents that it does not take go.

    A document without a word has no size and is not taken. A null source is a source of its own; rows that repeat an id
    and a text share a fate.
    """
    mixed = mixing.mix(docs).where("taken > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("taken") / F.col("size"))))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most 1024, one row per piece.

    Rows without an id and repeated rows are packed like any other; a null or empty text is one token.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_fuzzy_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages (context trees, SimHash, ProbMinHash, cutting stock); tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again, a stage's own tables go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
