"""Small awkward tables shared by the tests of the training-data operators."""

LONG = " ".join(f"word{i % 5000}x" for i in range(40000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the cat sat on the mat with a hat", "en", "a", 33),
    (1, "the cat sat on the mat with a hat", "en", "a", 33),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG + " end", "en", "b", 1),
    (None, "der hund ist gross und alt", "de", None, 3),
    (None, None, None, None, None),
    (6, "der hund ist gross und alt", "de", "c", 2),
    (7, "!!! ??? \n\n \t", "de", "c", 2),
    (1, "a different text under the same id", "en", "a", 3),
    (8, "line one here\nline one here\n\nLINE one, here!", "en", "a", 3),
]
#: Columns that an operator uses inside or returns.
CLASHES = "cuts size taken target score predicted held_out k1 node key keys comp norm bin rank copies class_id line_no kept lang_pred spans h start length n_words line words y at first".split()
LABELS = [(1, 1, 0), (2, 0, 1), (4, None, 1), (None, 1, 1), (6, 0, 0), (3, 0, 0), (8, 1, 1)]


def variants(spark):
    from pyspark.sql import functions as F

    base = spark.createDataFrame(ROWS, SCHEMA)
    return {"base": base, "empty": spark.createDataFrame([], SCHEMA), "clash": base.select("*", *(F.lit("x").alias(c) for c in CLASHES))}
