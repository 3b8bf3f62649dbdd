"""Operators on small made tables: states, merges, histories, streams."""

import datetime

from pyspark.sql import functions as F

from larkspur.functions import keys, values
from larkspur.operators import fields, history
from larkspur.streaming import upserts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_name_keys(spark):
    name = F.lit("Tata & Sons (formerly known as Old Co) Pvt. Ltd")
    assert one(spark, keys.name_key(name)) == "tata and sons formerly known as old co pvt ltd"
    assert one(spark, keys.bare_key(F.lit("Tata & Sons Pvt. Ltd"))) == "tata and sons"
    assert one(spark, keys.plain_key(F.lit("Tata & Sons Pvt. Ltd"))) == "tata sons"
    assert one(spark, keys.issuer_key(F.lit("Acme Ltd"))) == "acme"
    assert one(spark, keys.listing_key(name)) == "tata and sons pvt limited"
    assert one(spark, keys.collapse(F.lit(" a  b\n"))) == "a b"


def test_dates_and_amounts(spark):
    assert one(spark, values.strict_date(F.lit("2023-02-31"))) is None
    assert one(spark, values.lenient_date(F.lit("2023-02-31"))) == datetime.date(2023, 3, 3)
    assert one(spark, values.amount(F.lit("Rs. 1,250.5 Crore"))) == 12_505_000_000
    assert one(spark, values.amount(F.lit("to be announced"))) is None
    assert one(spark, values.url_host(F.lit("https://a.example.com:8080/x?y=1"))) == "a.example.com"


def test_status_coercion(spark):
    cases = [(None, "missing", "missing"), (None, None, "missing"), (1, "weird", "verified"), (1, "conflict", "conflict"), (1, None, "verified"), (None, "provisional", "provisional")]
    rows = spark.createDataFrame([(v, s, w) for v, s, w in cases], "v int, s string, w string")
    assert rows.where(~fields.coerced_status(F.col("v"), F.col("s")).eqNullSafe(F.col("w"))).count() == 0


def test_three_way_truth_table(spark):
    cases = [("a", "a", "a", "a", "unchanged"), ("a", "a", "b", "b", "applied"), ("b", "a", "b", "b", "already"), ("c", "a", "b", "c", "conflict"), (None, None, "b", "b", "applied"), ("a", "a", None, None, "applied"), (None, "a", "a", None, "unchanged")]
    rows = spark.createDataFrame(cases, "c string, b string, a string, merged string, outcome string")
    merged, outcome = fields.three_way(F.col("c"), F.col("b"), F.col("a"))
    assert rows.where(~merged.eqNullSafe(F.col("merged")) | (outcome != F.col("outcome"))).count() == 0


def test_feeds_later_wins_and_clashes(spark):
    a, b = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, n string, v int"), spark.createDataFrame([(1, None, 9), (3, "z", 3)], "k int, n string, v int")
    found = {r.k: (r.n, r.v, r.feeds, r.conflicts) for r in fields.merge_feeds([a, b], "k", ["n", "v"]).collect()}
    assert found == {1: ("x", 9, 2, 1), 2: ("y", 2, 1, 0), 3: ("z", 3, 1, 0)}


def test_islands_and_balanced_selection(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabba")] + [(2, 0, None), (2, 1, None)], "k int, t int, s string")
    assert sorted((r.k, r.island, r.state, r.length) for r in history.islands(rows, ["k"], "s", ["t"]).collect()) == [(1, 1, "a", 2), (1, 2, "b", 2), (1, 3, "a", 1), (2, 1, None, 2)]
    many = spark.createDataFrame([(y, i) for y in (1, 2, 3) for i in range(4 if y < 3 else 1)], "y int, i int")
    picked = [(r.y, r.i) for r in history.balanced_top(many, "y", [F.col("i")], 6, [F.desc("y")]).collect()]
    assert sorted(picked) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0)]


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, 10 * i + k) for k in range(3)], "k int, t int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = upserts.latest_table(stream, ["k"], ["t"], str(tmp_path / "out"))
    assert sorted((r.k, r.t) for r in got.collect()) == [(0, 20), (1, 21), (2, 22)]


def test_manifests(spark, tmp_path):
    import json

    import pytest

    from larkspur.sources import manifests

    records = spark.createDataFrame([("a", 2020), ("b", 2021)], "id string, year int")
    manifests.write(records, str(tmp_path / "out"))
    manifests.write(spark.createDataFrame([("c", 2021)], "id string, year int"), str(tmp_path / "out"))
    assert sorted((r.id, r.year) for r in manifests.read(spark, str(tmp_path / "out"), "id string, year int").collect()) == [("a", 2020), ("c", 2021)]
    (tmp_path / "in" / "2020").mkdir(parents=True)
    (tmp_path / "in" / "2020" / "m.json").write_text(json.dumps({"records": [{"id": "x"}, {"id": "y"}]}, indent=1))
    found = manifests.read_documents(spark, str(tmp_path / "in"), "records array<struct<id: string>>").collect()
    assert [(r.row_index, r.id) for r in found] == [(0, "x"), (1, "y")]
    (tmp_path / "in" / "2020" / "bad.json").write_text("{")
    with pytest.raises(Exception):
        manifests.read_documents(spark, str(tmp_path / "in"), "records array<struct<id: string>>").collect()


def test_evidence_arrays(spark):
    from larkspur.operators import published

    item = lambda u: F.struct(F.lit(u).alias("url"))
    items = F.array(item("a"), item("b"))
    assert [x.url for x in one(spark, published.add_once(items, item("a"), ["url"]))] == ["a", "b"]
    assert [x.url for x in one(spark, published.add_once(items, item("c"), ["url"]))] == ["a", "b", "c"]
    assert [x.url for x in one(spark, published.replace_by(items, item("a"), "url"))] == ["b", "a"]
    assert one(spark, published.without(F.array(F.lit(1), F.lit(1), F.lit(2)), F.array(F.lit(2)))) == [1, 1]


def test_merge_by_path_knows_absent_from_null(spark):
    from larkspur.operators import published

    table = lambda rows: spark.createDataFrame([(1, p, v) for p, v in rows], "id int, path string, value string")
    before, after, current = table([("a", "x"), ("b", "x"), ("c", None)]), table([("a", "y"), ("c", "z"), ("d", "n")]), table([("a", "x"), ("b", "q"), ("c", None)])
    got = {r.path: (r.value, r.outcome) for r in published.three_way_paths(current, before, after).collect()}
    assert got == {"a": ("y", "applied"), "b": ("q", "conflict"), "c": ("z", "applied"), "d": ("n", "applied")}
