"""Values, keys and notices from awkward literal texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import keys, notices, values
from larkspur.operators import documents, fields, reviewed

DAY = datetime.date
CASES = [
    (values.prose_date, "Opens 3 May 2024 and closes May 9, 2024", DAY(2024, 5, 3)),
    (values.prose_date, "Opens May 9, 2024 and closes 3 May 2025", DAY(2024, 5, 9)),
    (values.prose_date, "Dated February 31, 2024; opens March 4, 2024", None),
    (values.prose_date, "Dated February 31, 2024; opens 4th Sept, 2024", DAY(2024, 9, 4)),
    (values.prose_date, "on 1st Mayor 2024 or June 5 1999", None),
    (values.amount, "Rs 500 per share, in all ₹ 12.5 crores", 125_000_000),
    (values.amount, "Lakhani Ltd raises Rs 5", None),
    (values.amount, "12 shares", None),
    (values.amount, "INR 1,234.5 lacs and Rs. 2 million", 123_450_000),
    (values.amount, "Rs 0 crore, then Rs 3 crore", None),
    (values.amounts, "Rs 0 crore, Rs. 3 crore; INR 2.5 LAKHS", [30_000_000, 250_000]),
    (values.price_kind, "Rs. 100 – Rs. 105", "band"),
    (values.price_kind, "₹100 to ₹105", "band"),
    (values.price_kind, "100—105", "band"),
    (values.price_kind, "Rs. 1,050.50 per share", "fixed"),
    (values.price_kind, "at par", "missing"),
    (values.price_high, "₹100 to ₹1,105", 1105.0),
    (values.price_low, "Rs 99.5", 99.5),
    (values.month_number, "SEPT", 9),
    (values.month_number, "Mayor", None),
    (keys.decode_entities, "&#8377; 5 &AMP; &lt;b&gt; &#x2F; &apos;&#999999;&#55296; &#;", "₹ 5 & <b> / '&#999999;&#55296; &#;"),
    (keys.search_token, "The Global Systems Ltd", "the"),
    (keys.search_token, "A B Infra Zenith Pvt. Ltd.", "zenith"),
    (keys.search_token, "X Y", "x"),
    (notices.written_date, "Feb 30, 2024", None),
    (notices.written_date, "Monday 3, 2024", None),
    (notices.written_date, "Mar 3, 2024", None),
    (notices.written_date, "mARCH 3, 1899", None),
    (notices.written_date, "March 3 , 2024", DAY(2024, 3, 3)),
]


@pytest.mark.parametrize("make, text, want", CASES)
def test_value(spark, make, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(make(F.col("t"))).first()[0] == want


def test_exact_then_prefix(spark):
    known = spark.createDataFrame([("abc foods private limited",), ("abcdef minerals ltd",), ("abcdef minerals",), ("zenith steel works",), ("zenith steel works",), ("short co",), ("zenith steel worked",)], "k string")
    asked = ["abc foods private", "abc foods private limi", "zenith steel works", "short c", "abcdef mineral", None, "abc foods private and others", "zenith steel work"]
    got = {r.a: (r["class"], r.match) for r in fields.exact_then_prefix(spark.createDataFrame([(a,) for a in asked], "a string"), known, "a", "k").collect()}
    assert got == {
        "abc foods private": ("prefix", "abc foods private limited"), "abc foods private limi": ("prefix", "abc foods private limited"),
        "zenith steel works": ("ambiguous_exact", None), "short c": ("none", None), "abcdef mineral": ("prefix", "abcdef minerals"), None: ("none", None),
        "abc foods private and others": ("none", None), "zenith steel work": ("ambiguous_prefix", None),
    }


LISTED = " are listed on the SME platform of BSE effective Monday, March 4, 2024. Effective at the open of March 6, 2024, these stocks will be added to the below index. "
NOTICES = {
    "one": ("Preamble. With reference to Notice No. 20240301-12, Alpha Foods Ltd ( Exchange ticker - 543210 ) is listed on BSE SME platform effective March 4, 2024.", [("20240301-12", "Alpha Foods Ltd", "543210")]),
    "two": ("With reference to Notice No. 20240301-12, Alpha Ltd (Exchange ticker – 543210) and Notice No. 20240301-13, Beta Ltd (Exchange ticker – 543211)" + LISTED, [("20240301-12", "Alpha Ltd", "543210"), ("20240301-13", "Beta Ltd", "543211")]),
    "shared": ("With reference to Notice No: 20240301-12 and 20240301-13, Alpha Ltd (Exchange ticker - 543210) and Beta Ltd (Exchange ticker - 543211) respectively" + LISTED, [("20240301-12", "Alpha Ltd", "543210"), ("20240301-13", "Beta Ltd", "543211")]),
    "uneven": ("With reference to Notice No: 20240301-12, 20240301-13 and 20240301-14, Alpha Ltd (Exchange ticker - 543210) and Beta Ltd (Exchange ticker - 543211)" + LISTED, []),
    "prose": ("With reference to Notice No. 20240301-12, Alpha Ltd (Exchange ticker - 543210) and some other thing" + LISTED, []),
    "compact": ("With reference to Notice No. 20240301-12,13 and 15 below stocks" + LISTED + "INDEX ADD Exchange Ticker Stock Name EFFECTIVE DATE S&P BSE SME IPO 543210 Alpha Ltd March 6, 2024 543211 Beta Ltd 543212 Gamma Ltd For more information call", [("20240301-12", "Alpha Ltd", "543210"), ("20240301-13", "Beta Ltd", "543211"), ("20240301-15", "Gamma Ltd", "543212")]),
    "names": ("With reference to Notice No. 20240301-12 , A.B. & Sons, Stores and Co (India) Ltd (Exchange ticker — 543210), and Notice No 20240301 - 9 Beta 123456 Ltd (exchange ticker-543211)" + LISTED, [("20240301-12", "A.B. & Sons, Stores and Co (India) Ltd", "543210"), ("20240301-9", "Beta 123456 Ltd", "543211")]),
    "twice": ("With reference to Notice No: 20240301-12, 20240301-12, Alpha Ltd (Exchange ticker - 543210), Beta Ltd (Exchange ticker - 543211)" + LISTED, []),
    "table date": ("With reference to Notice No. 20240301-12,13 below stocks" + LISTED + "INDEX ADD Exchange Ticker Stock Name EFFECTIVE DATE S&P BSE SME IPO 543210 Alpha Ltd March 7, 2024 543211 Beta Ltd", []),
    "null": (None, None),
    "undated": ("With reference to Notice No. 20240301-12, Alpha Ltd (Exchange ticker - 543210) is listed on BSE effective March 40, 2024.", []),
}


def test_listing_facts(spark):
    rows = spark.createDataFrame([(k, text) for k, (text, _) in NOTICES.items()], "k string, t string")
    got = {r.k: r.facts if r.facts is None else [(f.notice, f.issuer, f.code) for f in r.facts] for r in rows.select("k", notices.listing_facts(F.col("t")).alias("facts")).collect()}
    assert got == {k: want for k, (_, want) in NOTICES.items()}


GOOD = "Notice No. 20240301-12 Notice Date 01 Mar 2024 Category Company related Segment SME the Equity Shares of Alpha Foods Ltd shall be listed effective from Monday, March 4, 2024 Scrip Code 543210 Market Lot 1,200 Issue Price for the current Public issue Rs. 99.50 end"
CHECKS = [
    (GOOD, "verified", [], 1200.0, 99.5),
    (GOOD.replace("effective", "e ective").replace("Alpha Foods Ltd", "Alpha Foods Ltd (Formerly Known as Beta)"), "verified", [], 1200.0, 99.5),
    (GOOD.replace("SME", "Equity"), "rejected", ["sme_segment_not_confirmed"], None, None),
    (GOOD + " Scrip Code 999999", "rejected", ["scrip_code_mismatch_or_missing"], None, None),
    (GOOD + " Market Lot 1,000", "rejected", ["market_lot_conflict_or_invalid"], None, None),
    (GOOD.replace("1,200", "1,200.5"), "rejected", ["market_lot_conflict_or_invalid"], None, None),
    (GOOD.replace("99.50", "95 to 99"), "rejected", ["issue_price_conflict_or_invalid"], None, None),
    (GOOD.replace("March 4, 2024", "Mar 4, 2024"), "rejected", ["listing_date_mismatch_or_missing"], None, None),
    (GOOD.replace("shall be listed", "shall be sold"), "rejected", ["issuer_mismatch_or_missing", "equity_listing_statement_missing"], None, None),
    ("nothing", "unavailable", ["notice_content_missing"], None, None),
    (None, "unavailable", ["notice_content_missing"], None, None),
]


def test_checked_notice(spark):
    candidate = {"issuer": F.lit("Alpha Foods Limited"), "notice": F.lit("20240301-12"), "code": F.lit("543210"), "listing_date": F.lit(DAY(2024, 3, 4))}
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CHECKS)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", notices.checked_notice(F.col("t"), candidate, F.lit(DAY(2024, 5, 1))).alias("x")).collect()}
    assert [(got[i].status, got[i].reasons, got[i].market_lot, got[i].issue_price) for i in range(len(CHECKS))] == [c[1:] for c in CHECKS]
    late = rows.where("i = 0").select(notices.checked_notice(F.col("t"), candidate, F.lit(DAY(2024, 3, 1))).alias("x")).first().x
    assert late.reasons == ["listing_date_in_future"]
    pages = spark.createDataFrame([(["a", "Scrip  Code 5", "Scrip Code 5"],)], "p array<string>")
    assert pages.select(notices.page_of(F.col("p"), F.lit("Scrip Code 5")), notices.page_of(F.col("p"), F.lit("x"))).first()[:] == (2, None)


def test_contradictions_are_dropped(spark):
    one = "With reference to Notice No. 20240301-12, {} (Exchange ticker - 543210)" + LISTED
    bodies = [(1, one.format("Alpha Ltd") + one.format("Alpha Ltd")), (2, one.format("Alpha Ltd") + one.format("Beta Ltd")), (3, one.format("Alpha Ltd") + one.format("Alpha Ltd").replace("Monday, March 4", "March 5")), (4, None)]
    got = {r.id: (r.issuer, r.stated) for r in notices.agreed_listings(spark.createDataFrame(bodies, "id int, body string")).collect()}
    assert got == {1: ("Alpha Ltd", 2)}


def test_reviewed_import(spark):
    columns = "id string, partition string, code string, name string, lot int, price int"
    registry = spark.createDataFrame([("a", "2023", "1", "alpha", 10, 5), ("b", "2023", "2", "beta", None, 7), ("c", "2022", "3", "gamma", 1, 1), ("d", "2023", "4", "delta", 2, 2)], columns)
    batch = spark.createDataFrame([("a", "2023", "1", "alpha", 10, 5), ("b", "2023", "2", "beta", 9, 7), ("c2", "2023", "3", "g2", 1, 1), ("d", "2023", "4", "delta", 3, 2), ("e", "2023", "9", "eps", 1, 1), ("f", "2023", None, "alpha", 1, 1), ("g", "2023", "1", "beta", 1, 1), ("h", "2023", "77", "h", 1, 1), ("i", "2023", "77", "i", 1, 1)], columns)
    found = reviewed.reviewed_import(registry, batch, ["id", "code", "name"], ["lot", "price"])
    got = {r.id: r.outcome for r in found.collect()}
    assert got == {"a": "repeated", "b": "repeated", "c2": "held", "d": "conflict", "e": "added", "f": "repeated", "g": "repeated", "h": "repeated", "i": "repeated"}
    alone = batch.where("id in ('a', 'b', 'e')")
    found = reviewed.reviewed_import(registry, alone, ["id", "code", "name"], ["lot", "price"])
    assert {r.id: r.outcome for r in found.collect()} == {"a": "present", "b": "enriched", "e": "added"}
    after = {r.id: r.lot for r in reviewed.imported(registry, alone, found, ["lot", "price"]).collect()}
    assert after == {"a": 10, "b": 9, "c": 1, "d": 2, "e": 1}
    approvals = batch.where("id = 'e'").select(reviewed.content_hash(batch, batch.columns).alias("hash"))
    assert [r.id for r in reviewed.approved(batch, approvals, batch.columns).collect()] == ["e"]


def test_reconciled(spark):
    registry = spark.createDataFrame([("a", "2022", "x"), ("b", "2022", "y"), ("c", "2023", "z"), ("d", "2023", "w")], "id string, partition string, value string")
    actions = spark.createDataFrame([("a", "move", "2022", "2023"), ("b", "correct", "q", "r"), ("c", "correct", "z", "z"), ("e", "move", "1", "2")], "id string, kind string, expected string, target string")
    got = {r.id: (r.partition, r.value, r.outcome) for r in reviewed.reconciled(registry, actions).collect()}
    assert got == {"a": ("2023", "x", "applied"), "b": ("2022", "y", "refused"), "c": ("2023", "z", "already"), "d": ("2023", "w", "untouched"), "e": (None, None, "unknown")}


def test_mentions_and_fill(spark):
    docs = spark.createDataFrame([(1, "The issue price is Rs 10.\fAgain issue price Rs 10 and cap price Rs 12\f "), (2, "no price"), (3, None)], "id long, text string")
    paged = documents.pages(docs)
    assert sorted((r.id, r.page) for r in paged.collect()) == [(1, 1), (1, 2), (2, 1)]
    found = documents.mentions(paged, {"issue": r"issue price(?: is)?", "cap": "cap price"}, before=4, after=6)
    rows = sorted((r.id, r.page, r.label, r.nth, r.start, r.found, r.context) for r in found.collect())
    assert rows == [(1, 1, "issue", 1, 4, "issue price is", "The issue price is Rs 10"), (1, 2, "cap", 1, 28, "cap price", "and cap price Rs 12"), (1, 2, "issue", 1, 6, "issue price", "ain issue price Rs 10")]
    seen = found.where("label = 'issue'").select("id", F.regexp_extract("context", "Rs ([0-9]+)", 1).cast("int").alias("value"))
    records = spark.createDataFrame([(1, None), (2, 3)], "id long, price int")
    filled, counters = documents.fill_field(records, seen, "price")
    assert sorted(map(tuple, filled.collect())) == [(1, 10, "agreed", "filled"), (2, 3, "absent", "unchanged")]
    assert counters.first().asDict() == {"candidates": 1, "filled": 1, "corroborated": 0, "conflicts": 0, "ambiguous": 0, "absent": 1, "remaining": 0}
