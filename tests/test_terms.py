"""Terms, formats, readers and links on nothing: null, empty and blank texts, empty lists, tables without rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import formats, links, pieces, terms, values
from larkspur.functions.labels import explicit_date, first_date, still_extracts
from larkspur.operators import containment, release
from larkspur.sources import reports

OF_TEXT = {
    "scalar_price": (terms.scalar_price, None), "rupee_band": (terms.rupee_band, None), "equity_quantity": (terms.equity_quantity, None), "minimum_quantity": (terms.minimum_quantity, None), "whole_amount": (terms.whole_amount, None),
    "explicit_date": (explicit_date, None), "first_date": (first_date, None), "flexible_date": (values.flexible_date, None), "recent_date": (values.recent_date, None), "last_code": (links.last_code, None), "inner_document": (links.inner_document, None),
    "filing_year": (links.filing_year, None), "still_extracts": (lambda t: still_extracts(t, "open", F.current_date()), False), "admitted": (lambda t: links.admitted(t, "h", "/p", {"a": "."}), False), "parameters": (links.parameters, []),
    "kind": (lambda t: pieces.content_kind(t.cast("binary"), t, t), None),
}


@pytest.mark.parametrize("name", OF_TEXT)
def test_no_text(spark, name):
    make, want = OF_TEXT[name]
    rows = spark.createDataFrame([(None,), ("",), (" \n",)], "t string")
    assert [r.v for r in rows.select(make(F.col("t")).alias("v")).collect()] == [want] * 3


def test_no_items(spark):
    items = "array<struct<title:string,value:string,source:string>>"
    rows = spark.createDataFrame([([],), (None,), ([(None, None, None)],), ([("Price Band", None, None), ("Issue Price", None, None), ("Bid Lot", None, None), ("Issue Size", None, None)],)], f"i {items}")
    i = F.col("i")
    made = rows.select(terms.price_band(i).alias("b"), terms.issue_price(i, ("issue price",), "x").alias("p"), terms.minimum_bid(i).alias("m"), terms.issue_size(i, ("issue size",)).alias("s"), terms.stated_period(i).alias("d"), terms.revised_band(i).alias("r")).collect()
    for r in made[:3]:
        assert {x and x.reason for x in (r.b, r.p, r.m, r.s)} <= {"term_absent", None} and all(x is None or x.value is None for x in (r.b, r.p, r.m, r.s, r.r))
    assert (made[3].b.reason, made[3].p.reason, made[3].m.reason, made[3].s.reason) == (*["placeholder_or_unparseable"] * 3, "no_safe_overall_inr_total")


def test_no_values_are_shown_as_none(spark):
    rows = spark.createDataFrame([(None, None, None)], "v double, d date, e date")
    shown = rows.select(formats.rupees(F.col("v")), formats.crores(F.col("v")), formats.shares(F.col("v")), formats.day_text(F.col("d")), formats.price_or_band(F.col("v"), F.col("v"), F.col("v")), formats.offer_period(F.col("d"), F.col("e"))).first()
    assert list(shown)[:5] == ["—"] * 5 and tuple(shown[5]) == ("—", "Dates unavailable")


def test_more_tokens_than_a_literal_holds(spark, monkeypatch):
    passages = spark.createDataFrame([(i, [f"t{i}", "common"]) for i in range(30)] + [(99, [])], "item_id long, ts array<string>")
    docs = spark.createDataFrame([(i, ["common", *(f"t{j}" for j in range(i, 30, 7))]) for i in range(40)] + [(50, None)], "doc_id long, has array<string>")
    by_literal = sorted(map(tuple, containment.contained(passages, docs).collect()))
    monkeypatch.setattr(containment, "LITERAL_TOKENS", 3)
    by_join = sorted(map(tuple, containment.contained(passages, docs).collect()))
    assert by_literal == by_join == sorted((j, i) for i in range(40) for j in range(i, 30, 7))


def test_a_large_group_is_no_report(spark):
    rows = spark.range(30).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"))
    made = reports.markdown_by(rows, "g", "o", reports.markdown_row(F.col("o")), most=15).collect()
    assert [r.report.count("\n") for r in made] == [14, 14]
    with pytest.raises(Exception, match="too large"):
        reports.markdown_by(rows, "g", "o", reports.markdown_row(F.col("o")), most=14).collect()
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "g int, o int")
    assert [r.report for r in reports.markdown_by(nulls, "g", "o", reports.markdown_row(F.col("o"))).collect()] == ["| 1 |\n| 2 |"]


def test_releases_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert release.batch_summary(empty("g int, status string"), ["g"]).count() == 0
    assert release.by_route(empty("k int, route int, status string, result string"), "k").count() == 0
    assert release.ledger(empty("code int, name_key string"), empty("code int, disposition string, stable_id string, approval string"), empty("stable_id string, name_key string, code int, hash string")).count() == 0
    assert release.selection(empty("release int, name string, content string")).count() == 0
    history = "array<struct<field:string,before:string,after:string,at:string>>"
    assert release.moved(empty(f"id int, partition int, v string, history {history}"), empty("id int, expected int, target int, v string, at string"), ["v"]).count() == 0


def test_routes(spark):
    rows = [("a", 1, "failed", "x"), ("a", 2, "verified", "y"), ("a", 3, "failed", "z"), ("b", 1, "failed", "x"), ("b", 2, "rejected", "y"), ("c", 1, None, None), ("d", None, "verified", "q"), ("a", 2, "failed", "a")]
    got = {r.k: tuple(r)[1:] for r in release.by_route(spark.createDataFrame(rows, "k string, route int, status string, result string"), "k").collect()}
    assert got == {"a": (2, "verified", "y", 2), "b": (2, "rejected", "y", 2), "c": (1, None, None, 1)}
