"""Queries over notices, reconciliations of two sides, documents and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import keys, notices, values
from larkspur.plans.common import Tables, spread
from larkspur.sources import reports

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query("""WITH t AS (SELECT o_orderkey, o_custkey FROM orders), p AS (SELECT o_custkey % 700 AS code, 'company ' || (CASE WHEN o_orderkey % 50 = 0 THEN o_custkey % 700 + 1 ELSE o_custkey % 700 END) AS issuer FROM t UNION ALL SELECT (o_custkey + 7) % 700, 'company ' || ((o_custkey + 7) % 700) FROM t WHERE o_orderkey % 2 = 0)
SELECT code, min(issuer) AS issuer, count(*) AS mentions FROM p GROUP BY code HAVING count(DISTINCT issuer) = 1""")
def notice_grammar(spark, sf_dir):
    """Notices that list several companies, 'code - name; code - name': clauses become rows, a code with two names is dropped."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda n: F.concat(F.lit("company "), n.cast("string"))
    one = F.concat((c % 700).cast("string"), F.lit(" - "), F.when(k % 50 == 0, name(c % 700 + 1)).otherwise(name(c % 700)))
    two = F.concat(((c + 7) % 700).cast("string"), F.lit(" - "), name((c + 7) % 700))
    text = F.concat(F.lit("Listing of: "), F.when(k % 2 == 0, F.concat(one, F.lit("; "), two)).otherwise(one), F.lit("."))
    clauses = Tables(spark, sf_dir).orders.select(F.explode(F.regexp_extract_all(text, F.lit("([0-9]+ - [A-Za-z0-9 ]+)"), F.lit(1))).alias("clause"))
    facts = clauses.select(F.split_part("clause", F.lit(" - "), F.lit(1)).cast("long").alias("code"), F.split_part("clause", F.lit(" - "), F.lit(2)).alias("issuer"))
    per = facts.groupBy("code").agg(F.min("issuer").alias("issuer"), F.max("issuer").alias("last"), F.count(F.lit(1)).alias("mentions"))
    return per.where("issuer = last").drop("last")


@query("""WITH r AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT CASE WHEN r.n IS NULL AND p.n IS NULL THEN 'neither' WHEN r.n IS NULL THEN 'published_only' WHEN p.n IS NULL THEN 'retained_only' WHEN r.n = p.n THEN 'agreed' ELSE 'conflict' END AS class, count(*) AS n FROM customer LEFT JOIN r ON r.k = c_custkey LEFT JOIN p ON p.k = c_custkey GROUP BY 1""")
def two_sided_reconcile(spark, sf_dir):
    """Both sides come from one pass over the orders: their counts are two conditional aggregates of one shuffle."""
    t = Tables(spark, sf_dir)
    status = F.col("o_orderstatus")
    sides = t.orders.groupBy("o_custkey").agg(F.count_if(status == "F").alias("r"), F.count_if(status == "O").alias("p"))
    r, p = F.coalesce("r", F.lit(0)), F.coalesce("p", F.lit(0))
    group = F.when((r == 0) & (p == 0), "neither").when(r == 0, "published_only").when(p == 0, "retained_only").when(r == p, "agreed").otherwise("conflict")
    return t.customer.join(sides, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(group.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_type, min(event_id) AS place, max_by(value, event_id) AS value FROM events GROUP BY ALL""")
def last_wins_first_place(spark, sf_dir):
    """A keyed list in which the last value wins but keeps the first one's place."""
    return Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("place"), F.max_by("value", "event_id").alias("value"))


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS admitted FROM part""")
def parameter_set(spark, sf_dir):
    """A URL is admitted if its parameters are exactly the two allowed ones, in any order."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://x.example.com/doc?"), F.when(k % 3 == 0, F.concat(F.lit("id="), k.cast("string"), F.lit("&kind=pdf"))).when(k % 3 == 1, "id=1&kind=pdf&extra=2").otherwise("kind=pdf"))
    names = F.array_sort(F.map_keys(F.str_to_map(F.split_part(url, F.lit("?"), F.lit(2)), F.lit("&"), F.lit("="))))
    return Tables(spark, sf_dir).part.select("p_partkey", (names == F.array(F.lit("id"), F.lit("kind"))).alias("admitted"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END AS rank FROM lineitem)
SELECT l_orderkey, min_by(l_linenumber, (rank, l_shipdate, l_linenumber)) AS chosen, min(rank)::INTEGER AS rank FROM l GROUP BY 1""")
def candidate_document(spark, sf_dir):
    """The document to read first: by class, then date, then place: an arg-min per record."""
    rank = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", rank.alias("rank"))
    return rows.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("rank", "l_shipdate", "l_linenumber")).alias("chosen"), F.min("rank").alias("rank"))


@query("""SELECT s_suppkey, 'https://docs.example.com/f/' || s_suppkey || '.pdf' AS target FROM supplier""")
def nested_url(spark, sf_dir):
    """The document behind a viewer link: the decoded parameter that is itself a PDF's address."""
    k = F.col("s_suppkey").cast("string")
    direct = F.concat(F.lit("https://docs.example.com/f/"), k, F.lit(".pdf"))
    viewer = F.concat(F.lit("https://x.example.com/viewer?ref=a&file="), F.url_encode(direct))
    url = F.when(F.col("s_suppkey") % 2 == 0, viewer).otherwise(direct)
    inner = F.try_url_decode(values.url_param(url, "file"))
    return Tables(spark, sf_dir).supplier.select("s_suppkey", F.coalesce(F.when(inner.rlike(r"(?i)^https://[^?]*\.pdf$"), inner), F.when(url.rlike(r"(?i)\.pdf$"), url)).alias("target"))


@query("""WITH c AS (SELECT n_regionkey AS region, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) SELECT region, string_agg('| ' || n_name || ' | ' || n || ' |', chr(10) ORDER BY n_name) AS report FROM c GROUP BY 1""")
def markdown_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    counted = t.nation.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_regionkey").alias("region"), "n_name", F.coalesce("n", F.lit(0)).alias("n"))
    return reports.markdown_by(counted, "region", "n_name", reports.markdown_row(F.col("n_name"), F.col("n")))


@query("""WITH s AS (SELECT DISTINCT p_name FROM part), t AS (SELECT count(*) AS n FROM s), pg AS (SELECT least(99, greatest(1, ceil(n / 10)))::BIGINT AS number FROM t) SELECT p_name, number AS page FROM (SELECT p_name, number, row_number() OVER (ORDER BY p_name) AS r FROM s, pg) WHERE r > (number - 1) * 10 AND r <= number * 10""")
def clamped_page(spark, sf_dir):
    """A page number beyond the end becomes the last page; the count that clamps it is one number."""
    from larkspur.operators import history

    names = Tables(spark, sf_dir).part.select("p_name").distinct()
    last = max(1, -(-names.count() // 10))
    number = min(99, last)
    return history.page(names, [F.col("p_name")], 10, number).select("p_name", F.lit(number).cast("long").alias("page"))


@query("""WITH a AS (SELECT DISTINCT lower(c_mktsegment) AS k FROM customer), b AS (SELECT trim(regexp_replace(lower(p_type || CASE WHEN p_partkey % 5 = 0 THEN ' Ltd' ELSE '' END), '[^a-z0-9]+', ' ', 'g')) AS k, p_partkey FROM part) SELECT k, min(p_partkey) AS first_part FROM b WHERE k NOT IN (SELECT k FROM a) GROUP BY k""")
def growing_anti_join(spark, sf_dir):
    """New names only: an anti-join against what is known, then the first of each name on the new side."""
    t = Tables(spark, sf_dir)
    known = t.customer.select(F.lower("c_mktsegment").alias("k"))
    fresh = t.part.select(keys.name_key(F.concat("p_type", F.when(F.col("p_partkey") % 5 == 0, " Ltd").otherwise(""))).alias("k"), "p_partkey")
    return fresh.join(known, "k", "left_anti").groupBy("k").agg(F.min("p_partkey").alias("first_part"))


@query("""WITH m AS (SELECT conv_id, role, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY ALL) SELECT conv_id, coalesce(max(turns) FILTER (role = 'user'), 0) AS user_turns, coalesce(max(turns) FILTER (role = 'assistant'), 0) AS assistant_turns, max(last_turn) AS last_turn FROM m GROUP BY 1""")
def conversation_roles(spark, sf_dir):
    rows = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.max("turn").alias("last_turn"))
    return rows


_LISTED = " are listed on the SME platform of BSE effective Monday, March 4, 2024. Effective at the open of March 6, 2024, these stocks will be added to the below index. "
_HEAD = "INDEX ADD Exchange Ticker Stock Name EFFECTIVE DATE S&P BSE SME IPO"
#: Notices by form, with @1 and @2 for names and @c for the last digits of codes, and what each says beyond doubt: (notice, name, code).
NOTICE_FORMS = [
    ("Preamble. With reference to Notice No. 20240301-12, @1 ( Exchange ticker - 54@c ) is listed on BSE SME platform effective March 4, 2024.", [("20240301-12", "@1", "54@c")]),
    ("With reference to Notice No. 20240301-12, @1 (Exchange ticker \u2013 54@c) and Notice No. 20240301 - 13, @2 (Exchange ticker \u2014 55@c)" + _LISTED, [("20240301-12", "@1", "54@c"), ("20240301-13", "@2", "55@c")]),
    ("WITH REFERENCE TO NOTICE NO: 20240301-12 and 20240301-13, @1 (Exchange ticker - 54@c) & @2 (Exchange ticker - 55@c) respectively," + _LISTED, [("20240301-12", "@1", "54@c"), ("20240301-13", "@2", "55@c")]),
    ("With reference to Notice No: 20240301-12, 20240301-13 and 20240301-14, @1 (Exchange ticker - 54@c) and @2 (Exchange ticker - 55@c)" + _LISTED, []),
    ("With reference to Notice No. 20240301-12, @1 (Exchange ticker - 54@c) and some other thing" + _LISTED, []),
    ("With reference to Notice No. 20240301-12,13 below stocks" + _LISTED + _HEAD + " 54@c @1 March 6, 2024 55@c @2 For more information call 123456", [("20240301-12", "@1", "54@c"), ("20240301-13", "@2", "55@c")]),
    ("With reference to Notice No. 20240301-12,13 and 15 below stocks" + _LISTED + _HEAD + " 54@c @1 March 6, 2024 55@c @2", []),
    ("With reference to Notice No. 20240301-12,13 below stocks" + _LISTED + _HEAD + " 54@c @1 March 7, 2024 55@c @2", []),
    ("With reference to Notice No. 20240301-12, @1 (Exchange ticker - 54@c) is listed on BSE effective Mar 4, 2024.", []),
    ("With reference to Notice No. 20240301-12, @1 (Exchange ticker - 54@c)" + _LISTED + "With reference to Notice No. 20240301-12, @2 (Exchange ticker - 54@c)" + _LISTED, []),
    ("With reference to Notice No. 20240301-12, @1 (Exchange ticker - 54@c)" + _LISTED + "With reference to Notice No. 20240301-13, @2 (Exchange ticker - 55@c)" + _LISTED + "With reference to Notice No. 20240301-12, @1 (Exchange ticker - 54@c)" + _LISTED, [("20240301-12", "@1", "54@c"), ("20240301-13", "@2", "55@c")]),
    ("No notice of that kind: @1 (Exchange ticker - 54@c)" + _LISTED, []),
]
_FORM_ROWS = ", ".join(f"({i}, '{n}', '{name}', '{code}')" for i, (_, facts) in enumerate(NOTICE_FORMS) for n, name, code in facts)


@query(f"""WITH c AS (SELECT c_custkey AS id, c_name AS one, c_mktsegment || ' & Sons, Stores (India) Ltd' AS two, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS digits FROM customer)
SELECT id, notice, replace(code, '@c', digits) AS code, CASE issuer WHEN '@1' THEN one ELSE two END AS issuer, DATE '2024-03-04' AS listing_date, CASE WHEN id % {len(NOTICE_FORMS)} = 10 AND issuer = '@1' THEN 2 ELSE 1 END AS stated
FROM c JOIN (VALUES {_FORM_ROWS}) AS f(form, notice, issuer, code) ON id % {len(NOTICE_FORMS)} = form""")
def notice_facts(spark, sf_dir):
    """What notices of many forms say beyond doubt: own entries, lists in order, tables; contradictions and loose ends give nothing."""
    k = F.col("c_custkey")
    body = F.get(F.array(*(F.lit(form) for form, _ in NOTICE_FORMS)), (k % len(NOTICE_FORMS)).cast("int"))
    for mark, value in (("@1", F.col("c_name")), ("@2", F.concat("c_mktsegment", F.lit(" & Sons, Stores (India) Ltd"))), ("@c", F.lpad((k % 10000).cast("string"), 4, "0"))):
        body = F.replace(body, F.lit(mark), value)
    return notices.agreed_listings(spread(Tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_mktsegment")).select(k.alias("id"), body.alias("body")))


_STATED = "Notice No. 20240301-@n Notice Date 01 Mar 2024 Category Company related Segment SME the Equity Shares of @1 shall be listed effective from Monday, March 4, 2024 Scrip Code 54@c Market Lot 1,200 Issue Price for the current Public issue Rs. 99.50 end"
#: An issuer's notice by form: what is replaced in it, by what, and the reasons that then stand against it.
NOTICE_CHECKS = [
    ("end", "end", []),
    ("effective from", "e ective  from", []),
    ("Segment SME", "Segment Equity", ["sme_segment_not_confirmed"]),
    ("end", "Scrip Code 999999", ["scrip_code_mismatch_or_missing"]),
    ("end", "Market Lot 1,000 end", ["market_lot_conflict_or_invalid"]),
    ("99.50", "95 to 99", ["issue_price_conflict_or_invalid"]),
    ("March 4, 2024", "March 5, 2024", ["listing_date_mismatch_or_missing"]),
    ("March 4, 2024", "Mar 4, 2024", ["listing_date_mismatch_or_missing"]),
    ("shall be listed", "shall be sold", ["issuer_mismatch_or_missing", "equity_listing_statement_missing"]),
    ("20240301-@n", "20240301-0", ["notice_number_mismatch_or_missing"]),
    ("@1 shall", "@1 (formerly known as Old Co) shall", []),
]


@query(f"""WITH f AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{'+'.join(reasons)}')" for i, (_, _, reasons) in enumerate(NOTICE_CHECKS))}) AS f(form, reasons)),
c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 12 = 11 THEN 'notice_content_missing' ELSE reasons END AS reasons, CASE WHEN s_suppkey % 12 = 11 THEN 'unavailable' WHEN reasons = '' THEN 'verified' ELSE 'rejected' END AS status FROM supplier LEFT JOIN f ON s_suppkey % 12 = form)
SELECT id, status, reasons, CASE WHEN status = 'verified' THEN DATE '2024-03-04' END AS listing_date, CASE WHEN status = 'verified' THEN 1200::DOUBLE END AS market_lot, CASE WHEN status = 'verified' THEN 99.5::DOUBLE END AS issue_price FROM c""")
def notice_checks(spark, sf_dir):
    """Whether a notice confirms its candidate, with the reasons against it and the lot and price that it states."""
    k = F.col("s_suppkey")
    body = F.when(k % 12 == 11, "moved away")
    for i, (old, new, _) in enumerate(NOTICE_CHECKS):
        body = body.when(k % 12 == i, _STATED.replace(old, new))
    for mark, value in (("@1", F.col("s_name")), ("@n", (k + 1).cast("string")), ("@c", F.lpad((k % 10000).cast("string"), 4, "0"))):
        body = F.replace(body, F.lit(mark), value)
    candidate = {"issuer": F.col("s_name"), "notice": F.concat(F.lit("20240301-"), (k + 1).cast("string")), "code": F.concat(F.lit("54"), F.lpad((k % 10000).cast("string"), 4, "0")), "listing_date": F.lit("2024-03-04").cast("date")}
    checked = spread(Tables(spark, sf_dir).supplier.select("s_suppkey", "s_name")).select(k.alias("id"), notices.checked_notice(body, candidate, F.lit("2024-12-31").cast("date")).alias("c"))
    return checked.select("id", "c.status", F.array_join("c.reasons", "+").alias("reasons"), "c.listing_date", "c.market_lot", "c.issue_price")
