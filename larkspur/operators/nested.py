"""JSON documents of any depth: their values as rows of paths, and their three-way merge.

Documents are read as variants, whose objects have their keys in order of name; equality is that of values, not of the order
of keys or of the spelling of numbers. A document that is no JSON counts as one string. Everything happens within a
document's row, so nothing is shuffled but for joining the sides of a merge.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STEP = "struct<at:int,key:string>"
#: Values that make a batch of rows, or fewer if they lie deep.
NODES = 50_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names more than once and that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def variant_of(document: Column) -> Column:
    """The document as a variant; a text that is no JSON is a string."""
    return F.coalesce(F.try_parse_json(document), document.cast("variant"))


def canonical(document: Column) -> Column:
    """The document's JSON text with keys in order of name; null stays null."""
    return F.to_json(variant_of(document))


def depth_of(docs: DataFrame, *documents: str) -> int:
    """Levels of objects and arrays in the deepest document, by one pass over brackets outside of strings."""

    def levels(document: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(document, r"\\.", ""), r'"[^"]*+"', "")
        marks = F.split(F.regexp_replace(F.translate(plain, "[]", "{}"), "[^{}]", ""), "")
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
        step = lambda s, c: let(s["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0), lambda at: F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most")))
        return F.aggregate(marks, start, step, lambda s: s["most"])

    return docs.agg(F.max(F.greatest(F.lit(0), *(levels(F.col(d)) for d in documents)))).first()[0] or 0


def nodes(docs: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, path, key, kind, text, size): every value at any depth of documents (id, document), the whole one included.

    ``path`` is an array of steps (at, key): a member's name and place in its object, or an item's place with a null key; paths compare
    in the order of the document. ``kind`` is object, array, string, number, boolean or null; ``text`` a string's own text or a
    number's or boolean's JSON, null for others; ``size`` how many members or items an object or array has. A null document
    has no row. ``depth`` limits the levels that are opened; by default all are.
    """
    spark, types = docs.sparkSession, docs.schema
    # the JSON is the variant's own: keys in order of name, numbers as a variant writes them; null documents are skipped
    # below, as a filter here would compute the documents twice
    texts = docs.select("id", canonical(F.col("document")).alias("json"))
    schema = StructType([types["id"], *spark.createDataFrame([], f"path array<{STEP}>, key string, kind string, text string, size int").schema])
    most = NODES

    class Number(str):
        """A number as its JSON has it."""

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = json.JSONDecoder(parse_int=Number, parse_float=Number).decode
        kinds = {Number: "number", bool: "boolean", type(None): "null"}
        for batch in batches:
            rows, ats, keys, ends, own, kind, text, size = found = [], [], [], [0], [], [], [], []

            def cut() -> pa.RecordBatch:
                steps = pa.StructArray.from_arrays([pa.array(ats, pa.int32()), pa.array(keys, pa.string())], ["at", "key"])
                path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
                columns = [batch["id"].take(pa.array(rows, pa.int32())), path, pa.array(own, pa.string()), pa.array(kind, pa.string()), pa.array(text, pa.string()), pa.array(size, pa.int32())]
                for column in found:
                    column.clear()
                ends.append(0)
                return pa.RecordBatch.from_arrays(columns, schema.names)

            for row, document in enumerate(batch["json"]):
                left = [((), (), None, load(document.as_py()))] if document.is_valid else []
                while left:
                    at, names, name, v = left.pop()
                    rows.append(row)
                    ats += at
                    keys += names
                    ends.append(len(ats))
                    own.append(name)
                    t = type(v)
                    if t is dict or t is list:
                        kind.append("object" if t is dict else "array")
                        text.append(None)
                        size.append(len(v))
                        if depth is None or len(at) < depth:
                            left += [((*at, i), (*names, k), k, x) for i, (k, x) in enumerate(v.items() if t is dict else ((None, x) for x in v))]
                    else:
                        kind.append("string" if t is str else kinds[t])
                        text.append(("true" if v else "false") if t is bool else v)
                        size.append(None)
                    if len(rows) >= most or len(ats) >= 8 * most:
                        yield cut()
            if rows:
                yield cut()

    return texts.mapInArrow(opened, schema)


def path_text(path: Column, root: str = "$") -> Column:
    """A path as text: ``$.name[0]["dotted.name"]``."""
    return F.concat(F.lit(root), F.array_join(F.transform(path, lambda s: F.coalesce(_member(s["key"]), F.concat(F.lit("["), s["at"].cast("string"), F.lit("]")))), ""))


def _member(key: Column) -> Column:
    """A member's step: ``.name``, quoted where the name is more than letters, digits and underscores; null for a null key."""
    return F.when(key.rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit("["), F.to_json(key.cast("variant")), F.lit("]")))


def first_strings(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """(id, text): each document's first non-empty string of at most ``depth`` steps, in the order of the document."""
    return nodes.where((F.col("kind") == "string") & (F.col("text") != "") & (F.size("path") <= depth)).groupBy("id").agg(F.min_by("text", "path").alias("text"))


def matching_keys(nodes: DataFrame, pattern: str) -> DataFrame:
    """(id, path, key, kind, text) of scalar values whose key matches ``pattern`` once it is lowered and stripped to letters and digits."""
    plain = F.lower(F.regexp_replace("key", "[^A-Za-z0-9]", ""))
    return nodes.where(~F.col("kind").isin("object", "array") & plain.rlike(pattern)).select("id", path_text(F.col("path")).alias("path"), "key", "kind", "text")


def latest_clock(nodes: DataFrame, key: str = "collected_at") -> DataFrame:
    """(id, clock, path): the latest timestamp in a string under ``key`` at any depth, as written, and where; of equal ones the first.

    Strings that are no timestamp do not count.
    """
    at = F.try_to_timestamp("text")
    seen = nodes.where((F.col("key") == key) & (F.col("kind") == "string")).withColumn("at", at).where("at is not null")
    best = seen.groupBy("id").agg(F.min_by(F.struct("text", "path"), F.struct(-F.unix_micros("at"), "path")).alias("best"))
    return best.select("id", F.col("best.text").alias("clock"), path_text(F.col("best.path")).alias("path"))


def shapes(nodes: DataFrame) -> DataFrame:
    """(path, kind, documents, found, longest): the shape of all documents, with any item of an array as ``[]``.

    ``longest`` is the length of the longest string, or the most members or items.
    """
    shape = F.concat(F.lit("$"), F.array_join(F.transform("path", lambda s: F.coalesce(_member(s["key"]), F.lit("[]"))), ""))
    per = nodes.groupBy("id", shape.alias("path"), "kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("size", F.length("text"))).alias("longest"))
    return per.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("found"), F.max("longest").alias("longest"))


def merged(current: Column, before: Column, after: Column, depth: int) -> Column:
    """struct(document, applied, already, conflicts): the change before -> after on current, canonical JSON texts of which null is absent.

    What did not change stays as current has it, and what current has already is counted. An object with a member ``value``
    is atomic: it changes as a whole if current is as before, else it is a conflict. Arrays that lose no item get the new items
    appended, each once. Objects are merged member by member down to ``depth`` levels, absence being a state like any other.
    Anything else changes if current is as before, else it is a conflict; conflicts keep current.
    """
    result = lambda text, applied, already, conflicts: F.struct(text.alias("document"), applied.cast("long").alias("applied"), already.cast("long").alias("already"), conflicts.cast("long").alias("conflicts"))
    none, one = F.lit(0), F.lit(1)
    sides = {"c": current, "b": before, "a": after}
    members = lambda t: F.when(F.startswith(t, F.lit("{")), F.transform_values(F.from_json(t, "map<string,variant>"), lambda _, v: F.to_json(v)))
    items = lambda t: F.when(F.startswith(t, F.lit("[")), F.transform(F.from_json(t, "array<variant>"), lambda v: F.to_json(v)))
    as_whole = F.when(current.eqNullSafe(before), result(after, one, none, none)).otherwise(result(current, none, none, one))

    def opened(o: Column) -> Column:
        atomic = F.lit(False)
        for n in sides:
            atomic = atomic | F.coalesce(F.map_contains_key(o[f"{n}_members"], "value"), F.lit(False))
        grown = F.concat(o["c_items"], F.array_except(F.array_except(o["a_items"], o["b_items"]), o["c_items"]))
        appended = let(F.concat(F.lit("["), F.array_join(grown, ","), F.lit("]")), lambda t: F.when(t == current, result(t, none, one, none)).otherwise(result(t, one, none, none)))
        only_grows = o["c_items"].isNotNull() & o["b_items"].isNotNull() & (F.size(F.array_except(o["b_items"], o["a_items"])) == 0)
        rule = F.when(atomic, as_whole).when(F.coalesce(only_grows, F.lit(False)), appended)
        if depth > 0:
            pairs = F.map_zip_with(o["b_members"], o["a_members"], lambda _, b, a: F.struct(b.alias("b"), a.alias("a")))
            inner = F.map_entries(F.map_zip_with(pairs, o["c_members"], lambda _, p, c: merged(c, p["b"], p["a"], depth - 1)))

            def assembled(entries: Column) -> Column:
                kept = F.filter(entries, lambda e: e["value"]["document"].isNotNull())
                texts = F.transform(kept, lambda e: F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), e["value"]["document"]))
                count = lambda name: F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + e["value"][name])
                return result(F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")), count("applied"), count("already"), count("conflicts"))

            every = o["c_members"].isNotNull() & o["b_members"].isNotNull() & o["a_members"].isNotNull()
            rule = rule.when(every, let(F.array_sort(inner, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)), assembled))
        return rule.otherwise(as_whole)

    inside = F.struct(*(members(t).alias(f"{n}_members") for n, t in sides.items()), *(items(t).alias(f"{n}_items") for n, t in sides.items()))
    return F.when(before.eqNullSafe(after), result(current, none, none, none)).when(current.eqNullSafe(after), result(current, none, one, none)).otherwise(let(inside, opened))


def merge_documents(current: DataFrame, before: DataFrame, after: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, document, applied, already, conflicts): a three-way merge of JSON documents (id, document), as ``merged`` says.

    A document that a side lacks is absent there; one that the merge removes is null in the result. Of several documents of
    one id on a side the largest text counts; rows without an id are left out. Texts come out canonical.
    """
    sides = [t.where("id is not null and document is not null").select("id", canonical(F.col("document")).alias(n)) for t, n in ((current, "c"), (before, "b"), (after, "a"))]
    stacked = sides[0].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[2], allowMissingColumns=True)
    rows = stacked.groupBy("id").agg(*(F.max(n).alias(n) for n in "cba"))
    depth = max(depth_of(t, n) for t, n in zip(sides, "cba")) if depth is None else depth
    return rows.select("id", merged(F.col("c"), F.col("b"), F.col("a"), depth).alias("m")).select("id", "m.document", "m.applied", "m.already", "m.conflicts")
