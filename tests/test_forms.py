"""Schemas, tables, labels, columns, observations, attempts and changed partitions on awkward literals and against plain versions."""

import datetime
import itertools
import json
import os
import random
import re
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from larkspur.functions import arrays, labels, layout, tables, values
from larkspur.operators import schemas
from larkspur.sources import adapters, manifests
from larkspur.streaming import attempts

DAY = datetime.date
AT = datetime.datetime


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_running_sums(spark):
    rnd = random.Random(1)
    lists = [[rnd.randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 16, 17, 250, 3000)]
    rows = spark.createDataFrame([(x,) for x in [*lists, None]], "a array<int>").select("a", arrays.running_sums(F.col("a")).alias("s")).collect()
    assert all(r.s == (None if r.a is None else [0, *itertools.accumulate(r.a)][:-1] if r.a else []) for r in rows)


def test_occurrences(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aXé \n") for _ in range(n)) for n in (0, 1, 5, 40, 400)] + ["XX", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", arrays.occurrences(F.col("t"), "X+a?", 3, 4).alias("o")).collect()
    for r in rows:
        want = r.t if r.t is None else [(m.start(), m.group(), r.t[max(0, m.start() - 3) : m.start()], r.t[m.end() : m.end() + 4]) for m in re.finditer("X+a?", r.t)]
        assert (r.o if r.o is None else [tuple(o) for o in r.o]) == want


SCHEMA = {
    "$defs": {"day": {"type": ["string", "null"], "format": "date"}},
    "type": "object",
    "required": ["id", "a.b"],
    "additionalProperties": False,
    "properties": {"id": {"type": "integer", "exclusiveMinimum": 0, "maximum": 9}, "a.b": {"$ref": "#/$defs/day", "minLength": 3}, "list": {"type": "array", "minItems": 1, "items": {"anyOf": [{"const": 1}, {"type": "string", "pattern": "^x"}, {"type": "array", "items": {"type": "number"}}]}}, "e": {"enum": ["é", 2, None, {"k": [1]}]}, "t": {"format": "date-time"}},
}


def broken(v, s, path="$"):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    out = broken(v, SCHEMA["$defs"]["day"], path) if "$ref" in s else []
    kinds = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    if kinds and not (kind in kinds or "integer" in kinds and kind == "number" and v == int(v)):
        return [*out, (path, f"type {' or '.join(kinds)}")]
    text = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    if "const" in s and text(v) != text(s["const"]):
        out.append((path, f"must equal {text(s['const'])}"))
    if "enum" in s and text(v) not in map(text, s["enum"]):
        out.append((path, f"must be one of {text(s['enum'])}"))
    if "anyOf" in s and all(broken(v, o) for o in s["anyOf"]):
        out.append((path, "does not match an allowed form"))
    if kind == "number":
        out += [(path, f"exclusiveMinimum {s['exclusiveMinimum']}")] if "exclusiveMinimum" in s and v <= s["exclusiveMinimum"] else []
        out += [(path, f"maximum {s['maximum']}")] if "maximum" in s and v > s["maximum"] else []
    if kind == "string":
        out += [(path, f"minLength {s['minLength']}")] if len(v) < s.get("minLength", 0) else []
        out += [(path, f"pattern {s['pattern']}")] if not re.search(s.get("pattern", ""), v) else []
        try:
            good = s.get("format") is None or len(v) == 10 and bool(DAY.fromisoformat(v))
        except ValueError:
            good = False
        out += [] if good else [(path, f"format {s['format']}")]
    if kind == "object":
        out += [(f"{path}.{n}", "required") for n in s.get("required", []) if n not in v]
        for n, x in v.items():
            out += broken(x, s["properties"][n], f"{path}.{n}") if n in s.get("properties", {}) else [(f"{path}.{n}", "not allowed")] if s.get("additionalProperties") is False else []
    if kind == "array":
        out += [(path, f"minItems {s['minItems']}")] if len(v) < s.get("minItems", 0) else []
        out += [e for i, x in enumerate(v) if "items" in s for e in broken(x, s["items"], f"{path}[{i}]")]
    return out


def test_schema_violations(spark):
    rnd = random.Random(3)
    scalar = lambda: rnd.choice([0, 1, 3, 9, 10, 2.5, "x", "é", "", "2024-02-29", "2023-02-29", None, True, [], {}, [1, "y"], {"k": [1]}])
    docs = [{n: scalar() for n in ("id", "a.b", "e", "zz") if rnd.random() < 0.7} | ({"list": [scalar() for _ in range(rnd.randrange(4))]} if rnd.random() < 0.7 else {}) for _ in range(200)] + [[], "x", 3]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "{"), (901, None)], "id long, document string")
    got = sorted(tuple(r) for r in schemas.violations(frame, SCHEMA).collect())
    assert [g for g in got if g[0] < 900] == sorted((i, *e) for i, d in enumerate(docs) for e in broken(d, SCHEMA))
    assert [g for g in got if g[0] >= 900] == [(900, "$", "type object"), (901, "$", "type object")]
    for wrong in ({"uniqueItems": True}, {"properties": {"a": {"type": "text"}}}, {"format": "email"}, {"items": {"additionalProperties": {}}}):
        with pytest.raises(ValueError):
            schemas.violations(frame, wrong)
    for circular in ({"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}, {"$ref": "#/$defs/none"}):
        with pytest.raises(ValueError):
            schemas.violations(frame, circular)


@pytest.mark.parametrize("text, want", [("2024-02-29T23:59:59Z", True), ("2024-02-30T00:00:00Z", False), ("2024-01-01t00:00:00.123+05:30", True), ("2024-01-01T24:00:00Z", False), ("2024-01-01T00:00:00", False), ("2024-01-01T00:00:00+24:00", False), ("2024-01-01T00:60:00Z", False), ("x", False), (None, False)])
def test_timestamps(spark, text, want):
    assert one(spark, values.rfc3339, text) is want


PAGE = """<p><TABLE class=a><TR><th>A<th colspan=2>B &amp; C</th></tr><tr><td rowspan='3'>x</td><td rowspan=2><a href="/u?a=1&amp;b=2">go</a> <A class=q HREF='/v'>v</A></td><td>1</td></tr>
<!-- <tr><td>no --><tr><td>y</tr><tr></tr><tr><td colspan="2">z<script>"<td>"</script></td></tr></table> tail <table><tr><td>q</table><table></table>"""


def test_grids(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, "none"), (4, "")], "id int, html string")
    got = {(r.id, r.table_no, r.row_no): [c.text for c in r.cells] for r in tables.table_rows(rows).collect()}
    assert got == {(1, 0, 0): ["A", "B & C", "B & C"], (1, 0, 1): ["x", "go v", "1"], (1, 0, 2): ["x", "go v", "y"], (1, 0, 3): ["x"], (1, 0, 4): ["z", "z"], (1, 1, 0): ["q"]}
    cells = tables.records(rows).collect()
    assert [(r.name, r.text, r.link) for r in cells if r.row_no == 1] == [("A", "x", None), ("B & C", "go v", "/u?a=1&b=2"), ("B & C", "1", None)] and {r.table_no for r in cells} == {0}
    laid = tables.by_layout(tables.table_rows(rows), [("one", {0: "^x$", 2: "."}, {"k": 0, "v": 2}), ("two", {0: "^[qz]$"}, {"k": 0})], "k").collect()
    assert sorted((r.k, r.layout, r.v, r.table_no, r.row_no) for r in laid) == [("q", "two", None, 1, 0), ("x", "one", "y", 0, 1), ("z", "two", None, 0, 4)]


MENTIONS = [
    ("The Bid/Issue  opening date: Monday, March 4, 2024 then", [DAY(2024, 3, 4)]),
    ("Issue opens on except in relation to any bids received from the anchor investors, i.e. Tuesday 5 Mar 2024", [DAY(2024, 3, 5)]),
    ("Anchor investor bid / issue opening date March 3, 2024", []),
    ("Offer opened on 4th March 2024. Bids by anchor investors were submitted", []),
    ("Offer Opening Date. F&S has March 3, 2024", []),
    ("Bid opening date March 32, 2024 or 5 May 2024", []),
    ("offer opening date offer opening date - March 3, 2024", [DAY(2024, 3, 3)]),
    ("offer opening date " + "," * 200 + " March 3, 2024", []),
    ("reoffer opening date March 3, 2024", []),
    ("", []),
    (None, None),
]


@pytest.mark.parametrize("text, want", MENTIONS)
def test_date_mentions(spark, text, want):
    found = one(spark, lambda x: labels.date_mentions(x, labels.LABELS["open"]), text)
    assert (found if found is None else [m.day for m in found]) == want
    plain = text and re.sub(r"\s+", " ", text).strip()
    assert all(re.fullmatch(r"(?i)(bid|issue|offer).*20\d\d", plain[m.start : m.start + m.length]) for m in found or [])


@pytest.mark.parametrize("text, first, earliest", [("Opens 3 May 2024 and closes May 9, 2024", DAY(2024, 5, 9), DAY(2024, 5, 3)), ("Sept. 3, 2024", DAY(2024, 9, 3), None), ("Feb 31, 2024; 3 May 2024", None, DAY(2024, 5, 3)), ("in 2024", None, None)])
def test_first_form_and_first_place_are_two_operators(spark, text, first, earliest):
    assert one(spark, labels.explicit_date, text) == first
    found = one(spark, labels.first_date, text)
    assert (found and found.day) == earliest


def test_offer_dates_without_listing(spark):
    rows = [(1, 1, "issue opening date May 5, 2024"), (1, 2, "issue closing date May 4, 2024"), (2, 1, "nothing"), (3, 1, None), (4, 1, "issue closing date May 4, 2024"), (4, 9, "issue closing date May 5, 2024")]
    got = {r.id: tuple(r)[1:] for r in labels.offer_dates(spark.createDataFrame(rows, "id int, page int, text string")).collect()}
    none = (None,) * 4
    assert got == {1: (*none, "invalid_offer_chronology"), 2: (*none, "explicit_dates_absent"), 3: (*none, "explicit_dates_absent"), 4: (*none, "official_date_conflict")}


def test_columns_below_headers(spark):
    column = lambda x: layout.column_below(x, r"TOTAL\s+(?:OFFER|ISSUE)", "ELIGIBILITY", r"GENERAL\s+RISK")
    page = "x\n   FRESH   TOTAL ISSUE SIZE      ELIGIBILITY\n  a 1       ₹ 1,234.5          b\n\t      million zz\nGeneral Risk ₹ 9 million"
    found = one(spark, column, page)
    assert tuple(found) == (1, 11, 33, "₹ 1,234.5 b million zz") and one(spark, layout.million_amount, "x ₹ 1,234.5 million") == 1_234_500_000
    assert one(spark, column, "nothing here") is None and one(spark, column, None) is None and one(spark, column, "total offer")[3] == ""
    assert one(spark, column, "\n" * 80 + "TOTAL ISSUE") is None
    assert one(spark, layout.million_amount, "0 million") is None and one(spark, layout.million_amount, None) is None


def test_observations_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, name string")
    kept, excluded, gaps = adapters.observe([(adapters.Adapter("a", F.col("k"), {"issuer_name": F.col("name")}), empty)])
    assert kept.count() == excluded.count() == 0 and [tuple(r) for r in gaps.collect()] == [("a", "no_rows")]
    rows = spark.createDataFrame([(1, "A"), (1, "A"), (None, None), (2, "--")], "k long, name string")
    kept, excluded, gaps = adapters.observe([(adapters.Adapter("a", F.col("k"), {"issuer_name": F.col("name"), "outcome": F.col("k")}), rows)])
    assert kept.count() == 2 and sorted(str(r.row) for r in excluded.collect()) == ["2", "None"] and gaps.count() == 0
    assert [(r.key, r.observations, r.outcome) for r in adapters.roll_up(kept, F.col("issuer_name")).collect()] == [("A", 2, "1")]


Attempt = namedtuple("Attempt", "place at version status result")
T = lambda hours: AT(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_attempt_rules():
    rules = attempts.Rules()
    go = lambda *rows: [s := None] and [s := attempts.advanced(s, Attempt(i, *r), rules) for i, r in enumerate(rows)][-1]
    assert go((T(0), 1, "failed", "a"), (T(2), 1, "verified", "b")) == (1, 1, 1, T(0), "failed", "a", None)  # still cooling down
    assert go((T(0), 1, "failed", "a"), (T(25), 1, "verified", "b")) == (1, 2, 0, T(25), "verified", "b", T(25))
    best = ((T(0), 1, "verified", "a"), (T(50), 1, "failed", "b"))
    assert go(*best) == (1, 1, 1, T(0), "verified", "a", T(0))
    assert go(*best, (T(60), 2, "failed", "c")) == (2, 1, 1, T(60), "verified", "a", T(0))  # a newer version does not lower it
    assert go(*best, (T(60), 2, "verified", "c")) == (2, 1, 1, T(60), "verified", "c", T(60))
    assert go((T(50), 2, "failed", "a"), (T(90), 1, "verified", "b"), (T(40), 2, "verified", "c")) == (2, 1, 2, T(50), "failed", "a", None)


def test_attempts_over_micro_batches_and_a_restart(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, i, T(rnd.randrange(400)), rnd.choice((1, 1, 1, 2)), rnd.choice(("failed", "rejected", "failed", "verified")), f"r{i}") for i, k in enumerate(rnd.choice("abcd") for _ in range(120))] + [("a", 500, None, 1, "failed", None), ("e", 1, T(0), None, "failed", None)]
    schema = "k string, " + attempts.ATTEMPT
    want = {}
    for r in rows[:120]:
        want[r[0]] = attempts.advanced(want.get(r[0]), Attempt(*r[1:]), attempts.Rules())
    # files are taken in the order of their times
    for n in range(4):
        part = rows[n * 30 : n * 30 + 30] if n < 3 else rows[90:]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))

    def run(upto):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        for n in upto:
            for name in os.listdir(tmp_path / f"part{n}"):
                if name.endswith(".parquet"):
                    os.rename(tmp_path / f"part{n}" / name, tmp_path / "in" / f"{n}-{name}")
                    os.utime(tmp_path / "in" / f"{n}-{name}", (1000 + n, 1000 + n))
        states = attempts.attempt_states(source, ["k"])
        keep = lambda batch, i: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch{i}"))
        states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    os.makedirs(tmp_path / "in")
    run([0, 1])
    run([2, 3])
    seen = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()
    got = {}
    for r in sorted(seen, key=lambda r: (r.version, r.attempts + r.skipped)):
        got[r.k] = tuple(r)[1:]
    assert got == want


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "years")
    rows = [(i, "s", 2020 + i % 3) for i in range(60)] + [(7, None, 2020), (7, None, 2020)]
    frame = lambda r: spark.createDataFrame(r, "k long, s string, year int")
    files = lambda: {y: sorted(os.listdir(f"{path}/year={y}")) for y in (2020, 2021, 2022) if os.path.isdir(f"{path}/year={y}")}
    assert {r.change for r in manifests.write_changed(frame(rows), path).collect()} == {"added"}
    before = files()
    shuffled = rows[::-1]
    assert {r.change for r in manifests.write_changed(frame(shuffled).repartition(5), path).collect()} == {"same"} and files() == before
    edited = [(k, "e" if k == 4 else s, y) for k, s, y in rows if y != 2022][:-1]
    assert {(r.partition, r.change) for r in manifests.changes(frame(edited), path).collect()} == {("2020", "changed"), ("2021", "changed"), ("2022", "removed")} and files() == before
    found = {r.partition: (r.change, r.rows_before, r.rows_after) for r in manifests.write_changed(frame(edited), path).collect()}
    assert found == {"2020": ("changed", 22, 21), "2021": ("changed", 20, 20), "2022": ("removed", 20, None)} and sorted(files()) == [2020, 2021]
    assert sorted(map(tuple, manifests.read(spark, path, "k long, s string, year int").collect()), key=repr) == sorted(edited, key=repr)
    with pytest.raises(ValueError):
        manifests.write_changed(frame([(1, "x", None)]), path)
    assert manifests.changes(frame([]), path).where("change = 'removed'").count() == 2
