"""Work that takes long for its size: on all cores, and each text looked at once instead of once for each mention of it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.operators import fields, folds, nested
from larkspur.plans import registry
from larkspur.sources.scratch import materialize
from tests.conftest import DATA

#: Most regular expressions in the optimized plan of a query.
MOST = {"stated_periods": 120, "notice_facts": 150, "notice_checks": 150, "page_tables": 60, "table_records": 60, "field_policies": 130, "mention_places": 200}


@pytest.mark.parametrize("name", MOST)
def test_looked_at_once(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    at = max(i for i, line in enumerate(lines) if "Repartition" in line)
    # below the dealing out nothing is computed that takes long
    assert not any("lambda" in line for line in lines[at:])
    assert sum(plan.count(f) for f in ("regexp", "RLIKE", "split(")) <= MOST[name]


def test_layouts_at_any_key(spark, tmp_path):
    """Orders whose key has six digits or whose code has more, as larger tables have them: the query and its SQL read the same rows."""
    keys = [7, 8, 9, 100002, 100003, 100009, 399998, 399999, 400001, 400002, 999999, 1000006]
    spark.read.parquet(f"{DATA}/orders.parquet").limit(1).crossJoin(spark.createDataFrame([(k,) for k in keys], "k long")).withColumn("o_orderkey", F.col("k")).drop("k").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{DATA}/customer.parquet").limit(3).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["id", "code", "layout", "company", "isin", "sector"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['table_layouts']})").fetchall()
    got = registry.QUERIES["table_layouts"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ("services", "total") in {(r.layout, r.company) for r in got} and len(got) < len(keys)


def test_matches_counted_without_pairs(spark):
    """Counts by key are those of the pairs, with null keys, hubs and rows that agree on both keys; no join makes a row for each pair."""
    left = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, None, 2), (4, None, None), (5, 9, 9), (6, 2, 2)], "l int, a int, b int")
    right = spark.createDataFrame([(i, i % 4 if i % 5 else None, i % 3 if i % 7 else None) for i in range(1, 60)] + [(100, 9, 9), (100, 9, 9)], "r int, c int, d int")
    keys = [("a", "c", "one"), ("b", "d", "two")]
    counted = fields.match_counts(left, right, "l", "r", keys)
    want = fields.match_class(left, fields.any_key_matches(left, right, "l", "r", keys), "l")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    plan = registry.QUERIES["match_class"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("Join LeftOuter") == 3


@pytest.mark.parametrize("name", ["json_first_string", "json_strings", "json_paths", "nested_clock", "json_matching_keys"])
def test_documents_opened_once(spark, name):
    """A document is made once and parsed once, whatever its depth, by as many tasks as rows are dealt out to."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f) for f in ("MapInArrow", "parseJson", "Map(ignoreNullFields", "Repartition", "strategy=merge")] == [1, 1, 1, 1, 1]
    assert "variantGet" not in plan


def test_nodes_of_awkward_documents(spark):
    """Numbers are spelled as a variant spells them, repeated keys are no JSON, rows of any number stay with their document, depth limits what is opened."""
    docs = {1: '[1.50, 1e5, -0, 12345678901234567890123]', 2: '{"a":1,"a":2}', 3: '["\\ud800", "\\u0000"]', 4: "[" * 900 + "true" + "]" * 900, 5: "", 6: '{"b": [ ], "a": {"c": null}}', 7: str(list(range(60_000)))}
    frame = spark.createDataFrame([*docs.items(), (None, "[1]"), (9, None)], "id long, document string")
    found = nested.nodes(frame)
    got = {}
    for r in found.where("id <> 7 and id <> 4").collect():
        got.setdefault(r.id, []).append((r.kind, r.text, r["size"]))
    assert sorted(got[1], key=str) == sorted([("array", None, 4), ("number", "1.5", None), ("number", "100000.0", None), ("number", "0", None), ("number", "12345678901234567890123", None)], key=str)
    assert (got[2], got[5], 9 in got) == ([("string", docs[2], None)], [("string", "", None)], False)
    assert sorted(t for k, t, _ in got[3] if k == "string") == ["\x00", "?"]
    assert sorted(got[6], key=str) == sorted([("object", None, 2), ("array", None, 0), ("object", None, 1), ("null", None, None)], key=str)
    assert found.where("id = 4").agg(F.count("*"), F.max(F.size("path"))).first()[:] == (901, 900)
    assert found.where("id = 7 and kind = 'number' and text = path[0].at").count() == 60_000
    assert sorted(r.key for r in nested.nodes(frame.where("id = 6"), 1).where("key is not null").collect()) == ["a", "b"] and found.where("id is null").count() == 2


@pytest.mark.parametrize("name", ["schema_violations", "schema_turns"])
def test_values_written_once(spark, name):
    """A value under a schema is written as JSON once, not once for each thing that is asked of it, and by more tasks than one."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.count("StructsToJsonEvaluator") <= 10


def test_fold_carries_numbers(spark, monkeypatch):
    """What a fold writes for each key of a row is the row's number and the key, not the row's order with its batch and id."""
    written = {}
    keep = lambda rows, name: (written.setdefault(name, rows.columns), materialize(rows, name))[1]
    monkeypatch.setattr(folds, "materialize", keep)
    registry = spark.createDataFrame([("a", 1, 1, 0)], "id string, partition int, code int, lot int")
    batches = spark.createDataFrame([(1, 5, "b", 1, 2, 0), (1, 4, None, 1, 2, 0), (0, 9, "c", 1, 1, 0), (0, 9, None, 1, None, 3)], "batch int, seq int, id string, partition int, code int, lot int")
    got = sorted((r.batch, r.seq, r.id or "", r.outcome, r.hit) for r in folds.batch_fold(registry, batches, ["code"], [], ["lot"]).collect())
    assert got == [(0, 9, "", "added", None), (0, 9, "c", "present", "a"), (1, 4, "", "added", None), (1, 5, "b", "present", None)]
    assert written["fold-open"] == ["row", "key"] and not any({"order", "keys"} & set(columns) for columns in written.values())
