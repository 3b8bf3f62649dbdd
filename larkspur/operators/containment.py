"""Which documents hold every token of a passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that are looked for as one literal array in each document's row; more of them are joined.
LITERAL_TOKENS = 4000


def tokens_of(text: Column) -> Column:
    """The distinct runs of letters a-z of a lowered text; a text without any is one empty token."""
    return F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " ")), " "))


def _among(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, bool]:
    """(row of ``docs``, tok) for the tokens of each document that are in ``wanted`` (tok), and whether the row's array stays beside them."""
    some = [r["tok"] for r in wanted.limit(LITERAL_TOKENS + 1).collect()]
    if len(some) <= LITERAL_TOKENS:
        # a plain explode would look for them three times: the optimizer infers a filter from it
        return docs.withColumn("tok", F.explode_outer(F.array_intersect("has", F.lit(some).cast("array<string>")))).where("tok is not null"), True
    return docs.select("doc_id", F.explode("has").alias("tok")).join(wanted, "tok", "left_semi"), False


def contained(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of passages (item_id, ts) and documents (doc_id, has) that hold every token of the passage, arrays of distinct tokens.

    A passage meets only the documents with its rarest token. Up to LITERAL_TOKENS tokens are looked for within a
    document's row, which keeps its array for the test of the others, so no document is shuffled; more are found by an equi-join,
    and arrays are joined back. A passage without tokens is in no document. Runs jobs when called.
    """
    asked = passages.select("item_id", F.explode("ts").alias("tok"))
    seen = _among(docs, asked.select("tok").distinct())[0].groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    # a token that no document has is the rarest, and finds none
    rarest = asked.join(seen, "tok", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok")).alias("r")).select("item_id", "r.tok")
    near, kept = _among(docs, rarest.select("tok").distinct())
    if not kept:
        near = near.join(docs, "doc_id")
    met = near.join(rarest, "tok").join(passages, "item_id")
    return met.where(F.size(F.array_except("ts", "has")) == 0).select("item_id", "doc_id")
