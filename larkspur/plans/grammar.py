"""Queries over dates in prose, amounts, titles, marked-up text and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import values
from larkspur.plans.common import Tables

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


_NAMES = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_PARTS = "WITH t AS (SELECT o_orderkey, 2000 + o_orderkey % 7 AS y, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 31 AS d FROM orders)"
_STRICT = "CASE WHEN d <= day(last_day(make_date(y, m, 1))) THEN make_date(y, m, 1) + d::INTEGER - 1 END"


def _date_parts(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, "January February March April May June July August September October November December".split())), (1 + k % 12).cast("int"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", (2000 + k % 7).cast("string").alias("y"), name.alias("month"), (1 + k % 31).cast("string").alias("d"))


@query(f"{_PARTS} SELECT o_orderkey, y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS unchecked, {_STRICT} AS checked FROM t")
def short_dates(spark, sf_dir):
    text = values.short_date_text(F.concat_ws("-", "d", F.left("month", F.lit(3)), "y"))
    return _date_parts(spark, sf_dir).select("o_orderkey", text.alias("unchecked"), values.strict_date(text).alias("checked"))


@query(f"{_PARTS} SELECT o_orderkey, {_STRICT} AS day FROM t")
def prose_dates(spark, sf_dir):
    american = F.concat(F.lit("The issue opens on "), "month", F.lit(" "), "d", F.lit(", "), "y", F.lit(" at ten."))
    european = F.concat(F.lit("Closing: "), "d", F.lit("th "), "month", F.lit(" "), "y")
    text = F.when(F.col("o_orderkey") % 2 == 0, american).otherwise(european)
    return _date_parts(spark, sf_dir).select("o_orderkey", values.prose_date(text).alias("day"))


@query("""SELECT CASE WHEN y BETWEEN 2000 AND 2100 THEN y::VARCHAR ELSE 'outside' END AS bucket, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1""")
def label_year(spark, sf_dir):
    year = F.regexp_extract(F.concat(F.lit("Prospectus for the year "), F.date_format("o_orderdate", "yyyy"), F.lit(" (final)")), "year ([0-9]{4})", 1).try_cast("int")
    return Tables(spark, sf_dir).orders.groupBy(F.when(year.between(2000, 2100), year.cast("string")).otherwise("outside").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_type, CASE WHEN regexp_matches(p_type, '(?i)^(economy|promo)') THEN 'draft' WHEN regexp_matches(p_type, '(?i)steel|brass') THEN 'red_herring' WHEN contains(lower(p_type), 'standard') THEN 'final' ELSE 'none' END AS class, count(*) AS n FROM part GROUP BY ALL""")
def title_class(spark, sf_dir):
    kind = F.col("p_type")
    group = F.when(kind.rlike("(?i)^(economy|promo)"), "draft").when(kind.rlike("(?i)steel|brass"), "red_herring").when(F.contains(F.lower(kind), F.lit("standard")), "final").otherwise("none")
    return Tables(spark, sf_dir).part.groupBy("p_type", group.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN lpad((p_partkey % 1000000)::VARCHAR, 6, '0') END AS code FROM part""")
def last_code_segment(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.lpad((k % 1_000_000).cast("string"), 6, "0")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://x.example.com/stock/123456/"), code, F.lit("/"))).when(k % 3 == 1, F.concat(F.lit("https://x.example.com/a/"), code, F.lit("?q=1"))).otherwise("https://x.example.com/about/")
    found = F.try_element_at(F.filter(F.split(values.url_path(url), "/"), lambda s: s.rlike("^[0-9]{6}$")), F.lit(-1))
    return Tables(spark, sf_dir).part.select("p_partkey", found.alias("code"))


@query("""SELECT s_suppkey, sha1(('blob ' || strlen(s_name))::BLOB || '\\x00'::BLOB || s_name::BLOB) AS hash FROM supplier""")
def blob_hash(spark, sf_dir):
    return Tables(spark, sf_dir).supplier.select("s_suppkey", values.blob_sha1(F.col("s_name")).alias("hash"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 1000 + p_partkey % 1000 END AS shares FROM part""")
def share_quantities(spark, sf_dir):
    number = F.format_number(F.col("p_size") * 1000 + F.col("p_partkey") % 1000, 0)
    text = F.when(F.col("p_partkey") % 4 == 0, "up to [o] Equity Shares").otherwise(F.concat(F.lit("Issue of "), number, F.lit(" Equity Shares of face value 10")))
    return Tables(spark, sf_dir).part.select("p_partkey", values.share_quantity(text).alias("shares"))


@query("""WITH a AS (SELECT CASE WHEN o_orderkey % 3 >= 1 THEN (o_orderkey % 97) * 10000000 ELSE 0 END AS one, CASE WHEN o_orderkey % 3 = 2 THEN (o_orderkey % 89) * 100000 ELSE 0 END AS two FROM orders)
SELECT (one > 0)::BIGINT + (two > 0)::BIGINT AS legs, count(*) AS n, sum(one + two)::BIGINT AS total FROM a GROUP BY 1""")
def all_amounts(spark, sf_dir):
    """Every amount above zero with mark and unit in a text, summed per text without exploding it."""
    k = F.col("o_orderkey")
    one, two = F.concat(F.lit("fresh issue of Rs "), (k % 97).cast("string"), F.lit(" crore")), F.concat(F.lit(" and offer for sale of Rs "), (k % 89).cast("string"), F.lit(" lakh"))
    text = F.when(k % 3 == 0, "to be announced").when(k % 3 == 1, one).otherwise(F.concat(one, two))
    found = values.amounts(text)
    rows = Tables(spark, sf_dir).orders.select((k % 3).alias("kind"), F.size(found).cast("long").alias("legs"), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x).alias("value"))
    return rows.groupBy("legs").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '  Ltd' ELSE c_name || ' ' END AS bare FROM customer""")
def nested_parentheses(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" (formerly (old) Co (x)) Ltd"))).otherwise(F.concat("c_name", F.lit(" (India)")))
    return Tables(spark, sf_dir).customer.select("c_custkey", values.without_parentheses(text).alias("bare"))


@query("""SELECT p_partkey, replace(replace(replace(replace('<b a="1">' || p_name || ' & co</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM part""")
def escaped_html(spark, sf_dir):
    html = F.concat(F.lit('<b a="1">'), "p_name", F.lit(" & co</b>"))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        html = F.replace(html, F.lit(mark), F.lit(entity))
    return Tables(spark, sf_dir).part.select("p_partkey", html.alias("html"))


@query("""WITH m AS (SELECT array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'lot' END, CASE WHEN l_discount = 0 THEN 'band' END, CASE WHEN l_tax = 0 THEN 'size' END], lambda x: x IS NOT NULL), '+') AS missing FROM lineitem) SELECT missing, count(*) AS n FROM m GROUP BY 1""")
def missing_fields(spark, sf_dir):
    gaps = F.array_compact(F.array(F.when(F.col("l_quantity") > 45, "lot"), F.when(F.col("l_discount") == 0, "band"), F.when(F.col("l_tax") == 0, "size")))
    return Tables(spark, sf_dir).lineitem.groupBy(F.array_join(gaps, "+").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, n::BIGINT AS mentions, list_extract(cuts, 1) AS first_context FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'licen[cs]e')) AS n, regexp_extract_all(lower(text), '([^\n]{0,30}licen[cs]e[^\n]{0,20})', 1) AS cuts FROM documents) WHERE n > 0""")
def mention_windows(spark, sf_dir):
    lowered = F.lower("text")
    n = F.size(F.regexp_extract_all(lowered, F.lit("(licen[cs]e)"), F.lit(1))).cast("long")
    cuts = F.regexp_extract_all(lowered, F.lit(r"([^\n]{0,30}licen[cs]e[^\n]{0,20})"), F.lit(1))
    return Tables(spark, sf_dir).documents.select("doc_id", n.alias("mentions"), F.get(cuts, F.lit(0)).alias("first_context")).where("mentions > 0")


@query("""SELECT key, count(*) AS n, count(DISTINCT event_type) AS kinds FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1""")
def json_shape(spark, sf_dir):
    found = Tables(spark, sf_dir).events.select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("""SELECT event_type, max(greatest(0, epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts))) / 3600.0) AS oldest_h, count(*) FILTER (ts > TIMESTAMP '2024-01-20' + INTERVAL 5 MINUTE) AS future FROM events GROUP BY 1""")
def clock_ages(spark, sf_dir):
    """Ages are never below zero, so clocks ahead are counted on their own."""
    now = F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    age = F.greatest(F.lit(0), F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "ts"))) / 3600.0
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.max(age).alias("oldest_h"), F.count_if(F.col("ts") > now + F.expr("INTERVAL 5 MINUTES")).alias("future"))
