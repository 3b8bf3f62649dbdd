"""Queries over terms, formats and small readers: awkward texts crossed with a table, with SQL from the rules.

In a text @ stands for the row's key. Each row takes the text of its key modulo the number of texts; the SQL names what the rule
makes of each text, in terms of the key k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from larkspur.functions import formats, links, pieces, terms, values
from larkspur.functions.labels import explicit_date
from larkspur.plans.common import Tables, spread

QUERIES, ORACLES = {}, {}


def crossed(name: str, made: dict[str, Callable[[Column], Column]], cases: list[tuple], about: str) -> None:
    """Registers a query that makes columns of the texts of ``cases`` crossed with the customers; a case is a text and the SQL of each column."""

    def run(spark, sf_dir):
        k = F.col("c_custkey")
        text = F.replace(F.get(F.array(*(F.lit(c[0]) for c in cases)), (k % len(cases)).cast("int")), F.lit("@"), k.cast("string"))
        rows = Tables(spark, sf_dir).customer.select(k.alias("id"), text.alias("text"))
        return rows.select("id", *(make(F.col("text")).alias(n) for n, make in made.items()))

    run.__name__, run.__doc__ = name, about
    choose = lambda i: "CASE k % {} {} END".format(len(cases), " ".join(f"WHEN {n} THEN {c[i]}" for n, c in enumerate(cases)))
    QUERIES[name] = run
    ORACLES[name] = "WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS id, " + ", ".join(f'{choose(i + 1)} AS "{n}"' for i, n in enumerate(made)) + " FROM c"


def part(make: Callable[[Column], Column], *names: str) -> dict[str, Callable[[Column], Column]]:
    """The named fields of what ``make`` gives."""
    return {n: (lambda t, n=n: make(t)[n]) for n in names}


D = "DATE '2024-{:02d}-{:02d}'".format
NULL = "NULL::DOUBLE"

crossed(
    "scalar_prices",
    {"value": terms.scalar_price},
    [("Rs. 1@.50/- per Equity Share", "('1' || k || '.50')::DOUBLE"), ('"₹ 7,@"', "('7' || k)::DOUBLE"), ("INR7@", "('7' || k)::DOUBLE"), ("Rs 5 to Rs @", NULL), ("12-May-2024", NULL), ("[●]", NULL), ("NA", NULL), ("0", NULL), ("@.555", NULL), ("5 per share and @", NULL), ("1@ /- per share", "('1' || k)::DOUBLE"), ("", NULL), ("per share", NULL)],
    "Texts that are one price and nothing more.",
)
_BAND = lambda low, high: (f"{low}::DOUBLE", f"{high}::DOUBLE")
crossed(
    "rupee_bands",
    part(terms.rupee_band, "min", "max"),
    [
        ("Rs. 100 to Rs. 1@000 per Equity Share (face value 10)", *_BAND("100", "('1' || k || '000')")),
        ("₹9/- – 1,@99/- per share", *_BAND("9", "('1' || k || '99')")),
        ("Rs. 50/- per equity share to Rs. 5@3/- equity share", *_BAND("50", "('5' || k || '3')")),
        ("Rs 105 to Rs 100 per share", NULL, NULL), ("Rs 100 to Rs 105", NULL, NULL), ("100 to 105 per share", NULL, NULL), ("About Rs 100 to Rs 105 per share", NULL, NULL),
        ("12-May-2024", NULL, NULL), ("INR 10.50 - 10.50 per Equity Shares", *_BAND("10.5", "10.5")), ("Rs 0 to Rs 5 per share", NULL, NULL), ("Rs 5 per share to 9 per share", NULL, NULL), ("Rs 5 per share to Rs 9 per share each", NULL, NULL),
    ],
    "Bands of prices a share, with the unit once or twice; ends in the wrong order, without unit or mark are none.",
)
crossed(
    "equity_quantities",
    {"quantity": terms.equity_quantity, "minimum": terms.minimum_quantity},
    [("1,2@ Equity Shares and more", "('12' || k)::BIGINT", "('12' || k)::BIGINT"), ("Minimum 3@ Equity Shares and in multiples thereof", "NULL::BIGINT", "('3' || k)::BIGINT"), ("Minimum 3@ Equity Shares or so", "NULL::BIGINT", "NULL::BIGINT"), ("of 5 Equity Shares", "NULL::BIGINT", "NULL::BIGINT"), ("0 equity shares", "NULL::BIGINT", "NULL::BIGINT"), ("8 equity sharesx", "NULL::BIGINT", "NULL::BIGINT"), ('"7 EQUITY  SHARES"', "7", "7")],
    "Whole numbers of shares at the beginning of a text, and with the word minimum.",
)
L = "NULL::BIGINT"
crossed(
    "whole_amounts",
    {"first": values.amount, "whole": terms.whole_amount, "found": lambda t: F.size(values.amounts(t)).cast("long")},
    [
        ("Rs 1@ crores in all", "('1' || k)::BIGINT * 10000000", "('1' || k)::BIGINT * 10000000", "1"),
        ("₹ 1.25 million, then INR 3 lakhs", "1250000", L, "2"),
        ("Fresh Issue of Rs. 2.5 crore (with Rs 9 lacs (of INR 1 lac) apart)", "25000000", "25000000", "3"),
        ("Fresh Issue of Rs 5 crore and Offer for Sale of Rs 7@ crore", "50000000", L, "2"),
        ("(Rs 1 crore) OFS of Rs 3 million", "10000000", "3000000", "2"),
        ("Rs 500 per share", L, L, "0"), ("12 crores", L, L, "0"), ("Rs 0 crore", L, L, "0"), ("Lakhani raises Rs 5 lakhani", L, L, "0"), ("Rs. 1,00,000.50 LAKHS", "10000050000", "10000050000", "1"),
    ],
    "Amounts with currency mark and unit: the first, that of a whole offer, and how many there are.",
)
V = "NULL::DATE"
crossed(
    "written_days",
    {"first_form": explicit_date, "earliest": values.prose_date, "flexible": values.flexible_date, "recent": values.recent_date},
    [
        ("Opens 3 May 2024 and closes May 9, 2024", D(5, 9), D(5, 3), V, V), ("May 9, 2024", D(5, 9), D(5, 9), V, D(5, 9)), ("9 Sept 2024 (@)", D(9, 9), D(9, 9), V, V), ("February 30, 2024", V, V, V, V), ("2024-02-29", V, V, D(2, 29), D(2, 29)),
        ("2023-02-29", V, V, V, V), ("2024-03-01Tnoon", V, V, D(3, 1), V), ("1/3/2024", V, V, D(3, 1), V), ("31-02-2024", V, V, V, V), ("Mar. 4, 2024", D(3, 4), V, V, V), ("2019-12-31", V, V, "DATE '2019-12-31'", V), ("4th March, 2024 @", D(3, 4), D(3, 4), V, V), ("march 4 , 2024", D(3, 4), D(3, 4), V, D(3, 4)),
    ],
    "Days in prose by form and by place, and days of three strict forms.",
)
crossed(
    "outer_texts",
    {"value": values.without_parentheses},
    [("a(b(c)d)e@", "'ae' || k"), (")a) b (c", "'a b '"), ("((((@))))", "''"), ("no", "'no'"), ("a)(b)c(", "'ac'"), ("(a)(b(c", "''"), ("x(y)z(w)@(", "'xz' || k"), ("", "''")],
    "Texts outside of parentheses, closed or not.",
)
crossed(
    "page_ranges",
    part(pieces.page_range, "start", "end", "total", "reason"),
    [("<p>1 to 25 of 1,0@ records</p>", "CASE WHEN ('10' || k)::INT <= 10000 THEN 1 END", "CASE WHEN ('10' || k)::INT <= 10000 THEN 25 END", "CASE WHEN ('10' || k)::INT <= 10000 THEN ('10' || k)::INT END", "CASE WHEN ('10' || k)::INT > 10000 THEN 'invalid' END"), ("26 to 25 of 30 records", "NULL::INT", "NULL::INT", "NULL::INT", "'invalid'"), ("0 to 5 of 9 RECORDS", "NULL::INT", "NULL::INT", "NULL::INT", "'invalid'"), ("none @", "NULL::INT", "NULL::INT", "NULL::INT", "'missing'"), ("1&nbsp;to <b>9</b> of 9 records", "1", "9", "9", "NULL")],
    "Ranges of a listing's pages, with what does not hold together.",
)
crossed(
    "listing_pages",
    part(pieces.listing_statistics, "total_records", "page", "total_pages") | {"fragment": pieces.fragment},
    [("of 1,2@ records<input name='nextValue' value='4'><input name=\"totalpage\" value=9>#@#x", "('12' || k)::INT", "4", "9", "'of 1,2' || k || ' records<input name=''nextValue'' value=''4''><input name=\"totalpage\" value=9>#' || k || '#x'"), (" a#" + "@" + "#b ", "NULL::INT", "1", "NULL::INT", "'a#' || k || '#b'"), ("", "NULL::INT", "1", "NULL::INT", "''")],
    "Totals and page numbers of a listing, and the part before its mark.",
)
crossed(
    "listing_days",
    part(terms.listing_day, "value", "reason"),
    [("2024-03-04", D(3, 4), "NULL"), ('"2024-03-04"', D(3, 4), "NULL"), ("2024-02-30", V, "'unparseable_listing_date'"), (" ", V, "'term_absent'"), ("@ March", V, "'unparseable_listing_date'")],
    "A listing day or the reason why there is none.",
)
crossed(
    "excerpts",
    {"excerpt": lambda t: pieces.excerpt(t, ("with reference", "TICKER"), 4, 9), "hints": lambda t: F.array_join(pieces.quoted_hints(t, "api|index", 2), "|")},
    [("abc  defgh Ticker @ with reference", "'fgh Ticke'", "''"), ("\"/api/@\" '/Index' `/api/x` \"/api/@\"", "left('\"/api/' || k || '\" ''/Index'' `/api/x` \"/api/' || k || '\"', 9)", "'/api/' || k || '|/Index'"), ("no 'word' @", "left('no ''word'' ' || k, 9)", "''"), ("'12345 index'", "'''12345 in'", "'12345 index'")],
    "What stands around the earliest marker, and quoted hints, each once.",
)
crossed(
    "bid_labels",
    part(pieces.bid_terms, "bid_lot", "minimum_order_quantity") | {"contexts": lambda t: F.array_join(pieces.bid_terms(t)["contexts"], "|")},
    [("<td>Bid Lot</td><td>1,2@ Equity Shares</td>", "('12' || k)::INT", "NULL::INT", "'Bid Lot 1,2' || k || ' Equity Shares'"), ("x Minimum  Order Quantity: 5@ equity shares", "NULL::INT", "('5' || k)::INT", "'x Minimum Order Quantity: 5' || k || ' equity shares'"), ("bid lots 5 equity shares", "NULL::INT", "NULL::INT", "''")],
    "Bid terms behind their labels, with what stands around these.",
)
crossed(
    "attachment_links",
    {"links": lambda t: F.array_join(pieces.attachments(t, "https://x.example.com/Get?", r"id=\d+$", 2), " ")},
    [("<a href=\"https://x.example.com/get?a=1&amp;id=@\">", "'https://x.example.com/get?a=1&id=' || k"), ("<a href=https://x.example.com/Get?id=1><a HREF='https://x.example.com/Get?id=1'><a href='https://x.example.com/Get?id=2'><a href='https://x.example.com/Get?id=3'>", "'https://x.example.com/Get?id=1 https://x.example.com/Get?id=2'"), ("<a href='https://y.example.com/Get?id=1'><a href='https://x.example.com/Get?id=z'>", "''")],
    "The first different attachments of a page.",
)
crossed(
    "content_kinds",
    {
        "bytes": lambda t: pieces.content_kind(t.cast("binary"), F.lit(None).cast("string"), F.lit("https://x/y")),
        "by_url": lambda t: pieces.content_kind(F.lit("x").cast("binary"), F.lit("text/plain"), t),
        "by_type": lambda t: pieces.content_kind(F.lit("x").cast("binary"), t, F.lit(None).cast("string")),
    },
    [("%PDF-1.7 @", "'pdf'", "NULL", "NULL"), (" \n<!DOCTYPE HTML><p>", "'html'", "NULL", "NULL"), ("https://h/p.HTM?x=@", "NULL", "'html'", "NULL"), ("Text/HTML; charset=x", "NULL", "NULL", "'html'"), ("<htm", "NULL", "NULL", "NULL")],
    "Kinds of content by first bytes, by URL and by declared type.",
)


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), b AS (SELECT *, k % 6 AS f FROM c)
SELECT k AS id, CASE f WHEN 1 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 90::DOUBLE END AS band_min, CASE f WHEN 0 THEN NULL WHEN 1 THEN 'term_absent' WHEN 4 THEN 'official_term_conflict' WHEN 5 THEN 'placeholder_or_unparseable' END AS band_reason,
CASE f WHEN 0 THEN (1000 + k)::DOUBLE WHEN 3 THEN (1000 + k)::DOUBLE END AS price, CASE f WHEN 1 THEN 'term_absent' WHEN 2 THEN 'placeholder_or_unparseable' WHEN 4 THEN 'official_term_conflict' WHEN 5 THEN 'term_absent' END AS price_reason, CASE f WHEN 0 THEN 'Rs ' || (1000 + k) WHEN 3 THEN (1000 + k)::VARCHAR END AS price_source,
CASE f WHEN 0 THEN 120::BIGINT WHEN 3 THEN 120 WHEN 4 THEN 120 END AS bid, CASE f WHEN 1 THEN 'term_absent' WHEN 2 THEN 'official_term_conflict' WHEN 5 THEN 'placeholder_or_unparseable' END AS bid_reason, CASE f WHEN 0 THEN 'Minimum Order Quantity' WHEN 3 THEN 'Bid Lot' WHEN 4 THEN 'Minimum order quantity:' END AS bid_title,
CASE f WHEN 0 THEN (k + 1)::BIGINT * 10000000 WHEN 3 THEN 50000000 END AS size, CASE f WHEN 1 THEN 'term_absent' WHEN 2 THEN 'no_safe_overall_inr_total' WHEN 4 THEN 'official_term_conflict' WHEN 5 THEN 'no_safe_overall_inr_total' END AS size_reason,
CASE f WHEN 1 THEN 'missing' WHEN 4 THEN 'duplicate' END AS only_reason FROM b""")
def field_policies(spark, sf_dir):
    """Bands, prices, sizes and minimum bids from items of title and value: one agreed value or the reason, with its source."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    item = lambda title, value, source="list": F.struct(F.lit(title).alias("title"), (value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(source).alias("source"))
    none = F.expr("cast(array() as array<struct<title: string, value: string, source: string>>)")
    forms = [
        F.array(item("Price  Range:", "Rs 90 to Rs 100 per share"), item("Price Band", "₹90/- - 100/- per Equity Share"), item("Issue Price", text(1000 + k), "meta"), item("Issue price", text("Rs ", 1000 + k)), item("Bid Lot", "120 Equity Shares"), item("Minimum Order Quantity", "Minimum 120 Equity Shares"), item("Issue Size", text("Rs ", k + 1, " crore"))),
        none,
        F.array(item("Price Band", "Rs 90 to Rs 100 per share"), item("Issue Price", "Rs 90 to 100"), item("Bid Lot", "100 Equity Shares"), item("Bid lot", "120 Equity Shares"), item("Issue Size", "Fresh Issue Rs 1 crore, Offer for Sale Rs 2 crore")),
        F.array(item("Price Band", "Rs 90 to Rs 100 per share"), item("Issue Price", text(1000 + k), "meta"), item("Bid Lot", "120 Equity Shares"), item("Bid Lot", "not yet"), item("Issue Size", "Fresh issue of Rs 5 crore (of INR 7 crore)")),
        F.array(item("Price Band", "Rs 90 to Rs 100 per share"), item("Price Band", "Rs 91 to Rs 100 per share"), item("Issue Price", "10"), item("Issue Price", "11"), item("Minimum order quantity:", "120 equity shares"), item("Issue Size", "Rs 1 crore"), item("issue size *", "Rs 2 crore")),
        F.array(item("Price Band", "[●]"), item("Cap price", "10"), item("Bid Lot", "as advised"), item("Issue Size", "5000 shares")),
    ]
    items = F.when(F.lit(False), none)
    for i, form in enumerate(forms):
        items = items.when(k % len(forms) == i, form)
    rows = spread(Tables(spark, sf_dir).customer.select("c_custkey")).select(k.alias("id"), items.alias("items"))
    i = F.col("items")
    made = rows.select("id", terms.price_band(i).alias("b"), terms.issue_price(i, ("issue price",), "list").alias("p"), terms.minimum_bid(i).alias("m"), terms.issue_size(i, ("issue size",)).alias("s"), terms.only_item(i, "price band").alias("o"))
    # 'Price Range' stands beside the only band of the first form
    return made.select("id", F.col("b.value.min").alias("band_min"), F.col("b.reason").alias("band_reason"), F.col("p.value").alias("price"), F.col("p.reason").alias("price_reason"), F.col("p.source_value").alias("price_source"), F.col("m.value").alias("bid"), F.col("m.reason").alias("bid_reason"), F.col("m.source_title").alias("bid_title"), F.col("s.value").alias("size"), F.col("s.reason").alias("size_reason"), F.col("o.reason").alias("only_reason"))


@query("""WITH c AS (SELECT o_orderkey AS id, (o_totalprice * 100)::BIGINT AS n, o_orderdate::DATE AS d FROM orders),
g AS (SELECT *, CASE WHEN n < 1000 THEN n::VARCHAR ELSE ltrim(reverse(regexp_replace(reverse((n // 1000)::VARCHAR), '(..)', '\\1,', 'g')), ',') || ',' || right(n::VARCHAR, 3) END AS t, n // 10000000 AS cr, round((n % 10000000) / 10000000.0, 2) AS rest FROM c)
SELECT id, '₹' || t AS money, t || CASE WHEN n = 1 THEN ' filing' ELSE ' filings' END AS filings, strftime(d, '%d %b %Y') AS day, strftime(d, '%d %b') || ' – ' || strftime(d + 20, '%d %b') AS days,
CASE WHEN year(d) = year(d + 20) THEN year(d)::VARCHAR ELSE year(d) || '–' || year(d + 20) END AS note, CASE WHEN id % 3 = 0 THEN '—' WHEN id % 3 = 1 THEN '₹1.5–₹2' ELSE '₹' || t END AS band FROM g""")
def shown_values(spark, sf_dir):
    """Money in Indian digit groups, counts, days and periods as they are shown."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    n = F.round(F.col("o_totalprice") * 100).cast("long")
    period = formats.offer_period(day, F.date_add(day, 20))
    half = lambda v: F.when(k % 3 == 1, F.lit(v))
    band = formats.price_or_band(half(1.5), half(2.0), F.when(k % 3 == 2, n))
    return Tables(spark, sf_dir).orders.select(k.alias("id"), formats.rupees(n).alias("money"), formats.counted(n, "filing", "filings").alias("filings"), formats.day_text(day).alias("day"), period["days"].alias("days"), period["note"].alias("note"), band.alias("band"))


crossed(
    "number_formats",
    {"crores": lambda t: formats.crores(t.try_cast("decimal(30,2)")), "shares": lambda t: formats.shares(t.try_cast("decimal(30,4)")), "one_digit": lambda t: formats.rounded(t.try_cast("double")), "two_digits": lambda t: formats.rounded(t.try_cast("double"), 2)},
    [("12345678.9", "'₹1.23 Cr'", "'1,23,45,678.9'", "12345678.9::DOUBLE", "12345678.9::DOUBLE"), ("-1500000000", "'₹-150 Cr'", "'-1,50,00,00,000'", "-1500000000::DOUBLE", "-1500000000::DOUBLE"), ("999.125", "'₹0 Cr'", "'999.13'", "999.1::DOUBLE", "999.13::DOUBLE"), ("-0.25", "'₹0 Cr'", "'-0.25'", "-0.2::DOUBLE", "-0.25::DOUBLE"), ("none", "'—'", "'—'", NULL, NULL), ("100000", "'₹0.01 Cr'", "'1,00,000'", "100000::DOUBLE", "100000::DOUBLE"), ("1000", "'₹0 Cr'", "'1,000'", "1000::DOUBLE", "1000::DOUBLE"), ("120.50", "'₹0 Cr'", "'120.5'", "120.5::DOUBLE", "120.5::DOUBLE")],
    "Numbers in groups, in crores and rounded half up.",
)


@query("""WITH n AS (SELECT c_custkey AS id, c_nationkey AS nation, ['émile', 'Emil', 'Zoë', 'zoe', '_x', 'Ärzte', 'arzt', 'b'][c_custkey % 8 + 1] || ' ' || c_custkey // 40 AS name FROM customer)
SELECT id, row_number() OVER (PARTITION BY nation ORDER BY strip_accents(lower(name)), name, id)::INTEGER AS place, count(*) OVER (PARTITION BY strip_accents(lower(name))) AS alike FROM n""")
def name_order(spark, sf_dir):
    """Names in an order that overlooks case and accents, and how many names are alike in it; ties by code point."""
    k = F.col("c_custkey")
    name = F.concat(F.get(F.array(*(F.lit(x) for x in ("émile", "Emil", "Zoë", "zoe", "_x", "Ärzte", "arzt", "b"))), (k % 8).cast("int")), F.lit(" "), F.floor(k / 40).cast("string"))
    rows = Tables(spark, sf_dir).customer.select(k.alias("id"), "c_nationkey", name.alias("name"), F.collate(name, "UNICODE_CI_AI").alias("folded"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("folded", "name", "id"))
    alike = rows.groupBy("folded").agg(F.count(F.lit(1)).alias("alike"))
    return rows.withColumn("place", place).join(alike, "folded").select("id", "place", "alike")


_ADMITTED = {"id": r"\d{8}-\d+", "attachedId": "[a-f0-9-]{4}"}
crossed(
    "admitted_links",
    {"admitted": lambda t: links.admitted(t, "x.example.com", "/get.aspx", _ADMITTED)},
    [("https://x.example.com/get.aspx?id=20240301-@&attachedId=ab-1", "true"), ("https://x.example.com/get.aspx?attachedId=ab-1&id=20240301%2D@", "true"), ("https://x.example.com/get.aspx?id=20240301-@&attachedId=ab-1&x=1", "false"), ("https://x.example.com/get.aspx?id=20240301-@&id=20240301-@", "false"), ("https://x.example.com/get.aspx?id=20240301-@&attachedId=ab-1&id=20240301-1", "false"), ("http://x.example.com/get.aspx?id=20240301-@&attachedId=ab-1", "false"), ("https://u:p@x.example.com/get.aspx?id=20240301-1&attachedId=ab-1", "false"), ("https://x.example.com.evil.org/get.aspx?id=20240301-@&attachedId=ab-1", "false"), ("https://x.example.com/get.aspx", "false"), ("not a url @", "false"), ("https://x.example.com/get.aspx?id=20240301-@&attachedId=AB-1", "false")],
    "Links admitted by host, path and exactly two parameters in any order.",
)
crossed(
    "linked_documents",
    {"document": links.inner_document, "code": links.last_code},
    [
        ("https://d.example.com/f/@.PDF", "'https://d.example.com/f/' || k || '.PDF'", "NULL"),
        ("https://x.example.com/v?ref=a&file=https%3A%2F%2Fd.example.com%2F@.pdf", "'https://d.example.com/' || k || '.pdf'", "NULL"),
        ("https://x.example.com/v?file=https%253A%252F%252Fd.example.com%252F@.pdf", "'https://d.example.com/' || k || '.pdf'", "NULL"),
        ("https://x.example.com/v?u=https%3A%2F%2Fy.example.com%2Fw%3Ffile%3Dhttps%253A%252F%252Fd.example.com%252F@.pdf", "'https://d.example.com/' || k || '.pdf'", "NULL"),
        ("https://x.example.com/v?file=http%3A%2F%2Fd.example.com%2F@.pdf", "NULL", "NULL"),
        ("https://x.example.com/v?file=@.pdf", "NULL", "NULL"),
        ("https://x.example.com/543210/a/123456/?q=654321", "NULL", "'123456'"),
        ("https://x.example.com/5432101/12345/@x", "NULL", "NULL"),
        ("", "NULL", "NULL"),
    ],
    "Documents behind viewers, however encoded, and the last code in a path.",
)
crossed(
    "appended_links",
    {"url": lambda t: links.appended(t, "t", F.lit("a b&c")), "escaped": links.escaped},
    [("https://x/@", "'https://x/' || k || '?t=a+b%26c'", "'https://x/' || k"), ("https://x/?q=@", "'https://x/?q=' || k || '&t=a+b%26c'", "'https://x/?q=' || k"), ("https://x/?", "'https://x/?t=a+b%26c'", "'https://x/?'"), ("https://x/?a=1&b='2'#<top>", "'https://x/?a=1&b=''2''&t=a+b%26c#<top>'", "'https://x/?a=1&amp;b=&#039;2&#039;#&lt;top&gt;'"), ("\"&amp;\"@", "'\"&amp;\"' || k || '?t=a+b%26c'", "'&quot;&amp;amp;&quot;' || k")],
    "Links with one more parameter, and texts escaped for HTML.",
)
crossed(
    "filing_years",
    {"year": links.filing_year},
    [("A Ltd - DRHP (2024)", "2024"), ("A Ltd UDRHP-II ( 2023 ) ", "2023"), ("Updated Draft Red Herring Prospectus 1 (2022)", "2022"), ("draft  red herring prospectus (2021)", "2021"), ("A Ltd (2024)", "NULL::INT"), ("DRHP (2024) final", "NULL::INT"), ("DRHP (1999)", "NULL::INT"), ("DRHP of @ (2024)", "NULL::INT"), ("XDRHP (2024)", "NULL::INT")],
    "Years behind the name of a filing.",
)
