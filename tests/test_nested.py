"""Nested documents, folds, components and proposals against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import components, folds, nested, proposals

ABSENT = object()
text = lambda v: "absent" if v is ABSENT else json.dumps(v, sort_keys=True)


def merge(c, b, a, n):
    """The merge as its docstring says; n counts applied, already, conflicts."""
    if text(b) == text(a):
        return c
    if text(c) == text(a):
        n[1] += 1
        return c
    if not any(isinstance(v, dict) and "value" in v for v in (c, b, a)):
        if all(isinstance(v, list) for v in (c, b, a)) and {text(x) for x in b} <= {text(x) for x in a}:
            out = list(c)
            for x in a:
                if text(x) not in {text(y) for y in [*b, *out]}:
                    out.append(x)
            n[len(out) == len(c)] += 1
            return out
        if all(isinstance(v, dict) for v in (c, b, a)):
            inner = {k: merge(c.get(k, ABSENT), b.get(k, ABSENT), a.get(k, ABSENT), n) for k in {*c, *b, *a}}
            return {k: v for k, v in inner.items() if v is not ABSENT}
    if text(c) == text(b):
        n[0] += 1
        return a
    n[2] += 1
    return c


def made(rnd, depth):
    k = rnd.random()
    if not depth or k < 0.3:
        return rnd.choice([1, 2, "x", 'y"z', None, True, "é", {}, []])
    if k < 0.5:
        return [made(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["a", "b", "a.b", "value", "c", ""]): made(rnd, depth - 1) for _ in range(rnd.randint(0, 4))}


def edited(rnd, v):
    if rnd.random() < 0.15:
        return made(rnd, 2)
    if isinstance(v, dict):
        return {k: edited(rnd, x) if rnd.random() < 0.5 else x for k, x in v.items() if rnd.random() > 0.1} | ({rnd.choice("abcde"): made(rnd, 1)} if rnd.random() < 0.3 else {})
    return [x for x in v if rnd.random() > 0.15] + ([made(rnd, 1)] if rnd.random() < 0.4 else []) if isinstance(v, list) else v


def test_merge_of_documents(spark):
    rnd, rows = random.Random(11), [(0, [1, 2], [1, 2], [1]), (1, [1, 2], [1], []), (2, {"a.b": 1, "a": {"b": 2}}, {"a.b": 1, "a": {"b": 2}}, {"a.b": 3, "a": {"b": 2}})]
    for i in range(3, 400):
        before = made(rnd, 4)
        after = edited(rnd, before)
        sides = [edited(rnd, before) if rnd.random() < 0.7 else rnd.choice((before, after)), before, after]
        rows.append((i, *(ABSENT if rnd.random() < 0.05 else s for s in sides)))
    frame = lambda j: spark.createDataFrame([(r[0], json.dumps(r[j])) for r in rows if r[j] is not ABSENT], "id long, document string")
    got = {r.id: r for r in nested.merge_documents(frame(1), frame(2), frame(3)).collect()}
    for i, c, b, a in rows:
        n = [0, 0, 0]
        want = merge(c, b, a, n)
        if not c is b is a is ABSENT:
            r = got[i]
            assert (text(ABSENT if r.document is None else json.loads(r.document)), [r.applied, r.already, r.conflicts]) == (text(want), n), (i, c, b, a)
    assert (got[0].document, got[0].applied, got[1].conflicts) == ("[1]", 1, 1) and got[2].document == '{"a":{"b":2},"a.b":3}'


def walk(v, path=()):
    yield path, v
    for key, x in sorted(v.items()) if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from walk(x, (*path, key))


def test_nodes_at_any_depth(spark):
    rnd = random.Random(5)
    docs = [(i, made(rnd, 5)) for i in range(120)] + [(200, [[[[[[["deep"]]]]]]]), (201, {"k": "[{"})]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs] + [(300, "no json {"), (301, None)], "id long, document string")
    found = nested.nodes(frame)
    got = sorted((r.id, tuple(s["at"] if s["key"] is None else s["key"] for s in r.path), r.kind, r.text, r["size"]) for r in found.collect() if r.id < 300)
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    size = lambda v: len(v) if isinstance(v, (dict, list)) else None
    shown = lambda v: v if isinstance(v, str) else json.dumps(v) if isinstance(v, (bool, int)) else None
    want = sorted(((i, p, kind.get(type(x), "number"), shown(x), size(x)) for i, v in docs for p, x in walk(v)), key=repr)
    assert sorted(got, key=repr) == want
    assert [(r.kind, r.text) for r in found.where("id = 300").collect()] == [("string", "no json {")] and found.where("id = 301").count() == 0
    firsts = {i: next((x for p, x in walk(v) if isinstance(x, str) and x and len(p) <= 3), None) for i, v in docs}
    assert {r.id: r.text for r in nested.first_strings(found.where("id < 300")).collect()} == {i: x for i, x in firsts.items() if x is not None}
    assert nested.nodes(frame.limit(0)).count() == 0


def test_latest_clock_by_time_not_by_text(spark):
    document = {"collected_at": "2024-05-01T00:30:00+05:30", "x": [{"collected_at": "2024-04-30T20:00:00Z"}, {"collected_at": "2024-05-01T01:30:00+05:30"}, {"collected_at": "later"}], "y.z": {"collected_at": 9}}
    frame = spark.createDataFrame([(1, json.dumps(document)), (2, "{}")], "id long, document string")
    assert [tuple(r) for r in nested.latest_clock(nested.nodes(frame)).collect()] == [(1, "2024-04-30T20:00:00Z", "$.x[0].collected_at")]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rnd.randrange(80), 1000 + rnd.randrange(80)) for _ in range(50)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7777, 7777)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fold(registry, batches):
    keyed = lambda r: {(k, r[k]) for k in ("id", "name", "code") if r[k] is not None}
    state, out = list(registry), []
    for e in sorted(batches, key=lambda e: (e["batch"], e["seq"], e["id"] is not None, e["id"] or "")):
        hits = [r for r in state if keyed(r) & keyed(e)]
        if not hits:
            state.append(e)
            outcome, hit = "added", None
        else:
            one = hits[0] if len(hits) == 1 else None
            agrees = one and one["partition"] == e["partition"] and one["name"] in (None, e["name"])
            outcome, hit = ("present" if one["lot"] == e["lot"] else "held_existing") if agrees else "held_conflict", one and one["id"]
        out.append((e["batch"], e["seq"], e["id"], outcome, hit))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_fold_in_order(spark, seed):
    rnd = random.Random(seed)
    row = lambda i: {"id": rnd.choice([None, f"i{rnd.randrange(40)}", f"j{i}"]), "name": rnd.choice([None, f"n{rnd.randrange(60)}"]), "code": rnd.choice([None, 0, rnd.randrange(50)]), "partition": rnd.randrange(2), "lot": rnd.choice([None, 1, 2])}
    registry = [row(i) | {"id": f"r{i}"} for i in range(25)]
    # a long chain: each shares a key with the one before
    batches = [row(i) | {"batch": rnd.randrange(3), "seq": i} for i in range(150)] + [{"id": f"c{i}", "name": f"c{i // 2}", "code": 1000 + (i + 1) // 2, "partition": 0, "lot": 1, "batch": 1, "seq": 500 + i} for i in range(15)]
    schema = "id string, name string, code long, partition int, lot int"
    frame = lambda rows, s: spark.createDataFrame([tuple(r[c.split()[0]] for c in s.split(", ")) for r in rows], s)
    got = folds.batch_fold(frame(registry, schema), frame(batches, schema + ", batch int, seq long"), ["name", "code"], ["name"], ["lot"])
    assert sorted(map(tuple, got.collect()), key=repr) == fold(registry, batches)
    assert folds.batch_fold(frame(registry, schema), frame(batches, schema + ", batch int, seq long").limit(0), ["name"], [], ["lot"]).count() == 0


def test_proposals_hold_together(spark):
    doc = lambda x: json.dumps({"f": {"value": x}, "n": 1})
    records = [("2023", i, doc(1)) for i in "abcdefg"] + [("2022", "z", doc(1)), ("2023", "z", doc(1))]
    asked = [
        ("2023", "a", "remove", doc(1), None, None), ("2024", "a", "add", None, doc(2), None),  # a move
        ("2023", "b", "remove", doc(9), None, None), ("2024", "b", "add", None, doc(2), None),  # its removal is stale: rolled back
        ("2023", "c", "change", doc(1), doc(3), "x"), ("2023", "d", "change", doc(9), doc(3), "x"),  # one of the bundle is refused
        ("2023", "e", "change", doc(1), doc(4), "y"), ("2024", "c", "add", None, doc(5), "y"),  # tied to the bundle through c
        ("2023", "f", "change", doc(1), doc(6), None), ("2023", "g", "change", doc(1), doc(7), None), ("2023", "g", "remove", doc(1), None, None),
        ("2025", "h", "add", None, doc(8), "w"), ("2022", "z", "change", doc(1), doc(2), None), ("2023", "q", "remove", doc(1), None, None),
    ]
    outcomes, after = proposals.apply_proposals(spark.createDataFrame(records, "partition string, id string, document string"), spark.createDataFrame(asked, "partition string, id string, kind string, before string, after string, bundle string"))
    got = {(r.partition, r.id): r.outcome for r in outcomes.collect()}
    assert got == {
        ("2023", "a"): "applied", ("2024", "a"): "applied", ("2023", "b"): "conflict", ("2024", "b"): "rolled_back", ("2023", "c"): "rolled_back", ("2023", "d"): "conflict",
        ("2023", "e"): "rolled_back", ("2024", "c"): "rolled_back", ("2023", "f"): "applied", ("2023", "g"): "repeated", ("2025", "h"): "applied", ("2022", "z"): "rolled_back", ("2023", "q"): "already",
    }
    left = {(r.partition, r.id): json.loads(r.document)["f"]["value"] for r in after.collect()}
    assert left == {("2024", "a"): 2, **{("2023", i): 1 for i in "bcdeg"}, ("2023", "f"): 6, ("2025", "h"): 8, ("2022", "z"): 1, ("2023", "z"): 1}


def test_proposals_over_nothing(spark):
    records, asked = "partition string, id string, document string", "partition string, id string, kind string, before string, after string, bundle string"
    outcomes, after = proposals.apply_proposals(spark.createDataFrame([], records), spark.createDataFrame([], asked))
    assert outcomes.count() == 0 and after.count() == 0
    assert nested.merge_documents(*(spark.createDataFrame([], "id long, document string"),) * 3).count() == 0
    assert nested.shapes(nested.nodes(spark.createDataFrame([(1, '{"a": [1, {"b": "x"}, 2]}')], "id long, document string"))).where(F.col("path") == "$.a[].b").count() == 1
