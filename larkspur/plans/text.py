"""Queries over names, texts, pages and typed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import keys, values
from larkspur.plans.common import Tables, named, named_sql

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


_NAME = named_sql("c_custkey", "c_name")
_A = f"trim(regexp_replace(replace(lower({_NAME}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_LONG = f"trim(replace(' ' || {_A} || ' ', ' ltd ', ' limited '))"
_DROP = "trim(regexp_replace(regexp_replace(' ' || replace({}, ' ', '  ') || ' ', ' (private|pvt|limited|ltd) ', ' ', 'g'), ' +', ' ', 'g'))"
_PLAIN = f"trim(regexp_replace(lower({_NAME}), '[^a-z0-9]+', ' ', 'g'))"
_FORMER = f"regexp_replace({_NAME}, '\\(formerly known as [^)]*\\)', ' ', 'gi')"
_LISTING = f"trim(replace(' ' || trim(regexp_replace(replace(lower({_FORMER}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ltd ', ' limited '))"
_KEYS = {
    "name_key_a": (keys.name_key, _A),
    "name_key_b": (keys.issuer_key, f"trim(regexp_replace({_LONG}, '( |^)limited$', ''))"),
    "name_key_c": (keys.bare_key, _DROP.format(_A)),
    "name_key_d": (keys.long_key, _LONG),
    "name_key_e": (keys.listing_key, _LISTING),
    "name_key_f": (keys.plain_key, _DROP.format(_PLAIN)),
    "name_key_compact": (keys.compact_key, f"regexp_replace(lower({_NAME}), '[^a-z0-9]+', '', 'g')"),
}


def _key_query(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Tables(spark, sf_dir).customer.select("c_custkey", make(named("c_custkey", "c_name")).alias("name_key"))

    return run


for _name, (_make, _sql) in _KEYS.items():
    QUERIES[_name], ORACLES[_name] = _key_query(_make), f"SELECT c_custkey, {_sql} AS name_key FROM customer"


@query("""SELECT s, count(*) AS parts, min(p_partkey) AS first_part FROM (SELECT p_partkey, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS s FROM part) GROUP BY s""")
def slug_ids(spark, sf_dir):
    return Tables(spark, sf_dir).part.groupBy(keys.slug(F.col("p_name")).alias("s")).agg(F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("first_part"))


_STOPS = ", ".join(f"'{w}'" for w in keys.SEARCH_SKIPS)


@query(f"""WITH n AS (SELECT doc_id, trim(replace(' ' || trim(regexp_replace(replace(lower(string_split(text, chr(10))[1]), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ltd ', ' limited ')) AS name FROM documents),
w AS (SELECT doc_id, string_split(trim(regexp_replace(name, '( |^)limited$', '')), ' ') AS ws FROM n)
SELECT doc_id, coalesce(list_filter(ws, lambda w: length(w) >= 3 AND w NOT IN ({_STOPS}))[1], list_filter(ws, lambda w: length(w) >= 3)[1], ws[1]) AS token FROM w""")
def search_token(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", keys.search_token(F.get(F.split("text", "\n"), F.lit(0))).alias("token"))


@query("""SELECT lang, count(*) AS docs, sum(length(trim(regexp_replace(text, '[\\s\\x{A0}\\x{FEFF}]+', ' ', 'g'))))::BIGINT AS chars FROM documents GROUP BY lang""")
def collapse_ws(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length(keys.collapse(F.col("text")))).alias("chars"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{A0}\x{FEFF}]+', ' ', 'g'))"


@query(f"SELECT page_id, length({_STRIP})::BIGINT AS text_chars, sha256({_STRIP}) AS text_hash FROM pages")
def strip_tags_text(spark, sf_dir):
    text = keys.strip_tags(F.col("html"))
    return Tables(spark, sf_dir).pages.select("page_id", F.length(text).cast("long").alias("text_chars"), F.sha2(text, 256).alias("text_hash"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def page_title(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' &amp; &lt;more&gt;', '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title FROM pages""")
def decode_entities(spark, sf_dir):
    title = F.concat(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit(" &amp; &lt;more&gt;"))
    return Tables(spark, sf_dir).pages.select("page_id", keys.decode_entities(title).alias("title"))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


@query(r"""SELECT tag, count(*) AS uses, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""")
def page_fingerprint(spark, sf_dir):
    tags = Tables(spark, sf_dir).pages.select("page_id", F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    # counts per page first: no hot tag carries its pages' ids through the shuffle more than once a page
    each = tags.groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("tag").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("pages"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)(:[0-9]+)?([/?#]|$)', 1))"


@query(f"""SELECT page_id, {_HOST} AS host, CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) <> 'https' THEN 'not_https' WHEN NOT ({_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') OR ends_with({_HOST}, '.example.org')) THEN 'other_host'
WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN 'no_path' ELSE 'official' END AS reason FROM pages""")
def official_hosts(spark, sf_dir):
    url = F.col("url")
    host = values.url_host(url)
    listed = (host == "example.com") | F.endswith(host, F.lit(".example.com")) | F.endswith(host, F.lit(".example.org"))
    reason = F.when(values.url_scheme(url) != "https", "not_https").when(~listed, "other_host").when(values.url_path(url) == "", "no_path").otherwise("official")
    return Tables(spark, sf_dir).pages.select("page_id", host.alias("host"), reason.alias("reason"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def url_params(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", values.url_param(F.col("url"), "page").alias("page"), values.url_param(F.col("url"), "ref").alias("ref"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&][A-Za-z_]+=[^&#]+') THEN {_HOST} || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) || '?' || regexp_extract(url, '[?&]([A-Za-z_]+=[^&#]+)', 1) END AS source_key FROM pages""")
def source_key(spark, sf_dir):
    url = F.col("url")
    key = F.when(url.rlike("[?&][A-Za-z_]+=[^&#]+"), F.concat(values.url_host(url), values.url_path(url), F.lit("?"), F.regexp_extract(url, "[?&]([A-Za-z_]+=[^&#]+)", 1)))
    return Tables(spark, sf_dir).pages.select("page_id", key.alias("source_key"))


@query(r"""SELECT hash, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x{A0}\x{FEFF}]+', ' ', 'g'))) AS hash FROM documents) GROUP BY hash""")
def content_hash(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy(F.sha2(keys.collapse(F.col("text")), 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN nullif(round((o_orderkey % 977) * 10000000.0)::BIGINT, 0) WHEN 1 THEN nullif(round((o_orderkey % 977) * 1000000.0)::BIGINT, 0) WHEN 2 THEN nullif(round((o_orderkey % 977) * 100000.0)::BIGINT, 0) ELSE NULL END AS value FROM orders""")
def money_units(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 3, "to be announced").otherwise(F.concat(F.lit("Rs. "), (k % 977).cast("string"), F.when(k % 4 == 0, " Crore").when(k % 4 == 1, " million").otherwise(" lakh")))
    return Tables(spark, sf_dir).orders.select("o_orderkey", values.amount(text).alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'band' WHEN 1 THEN 'fixed' ELSE 'missing' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN p_size::DOUBLE END AS low, CASE WHEN p_partkey % 3 = 0 THEN (p_size + 1200)::DOUBLE END AS high FROM part""")
def price_text(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Rs. "), size.cast("string"), F.lit(" to Rs. "), F.format_number(size + 1200, 0))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Rs. "), size.cast("string"), F.lit(" per share"))).otherwise("-")
    return Tables(spark, sf_dir).part.select("p_partkey", values.price_kind(text).alias("kind"), values.price_low(text).alias("low"), values.price_high(text).alias("high"))


@query(r"""SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]{1,9})', 1), '') AS DOUBLE) AS first_number, regexp_matches(text, '[0-9]') AS has_digit FROM documents""")
def numeric_tolerant(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", values.tolerant_number(F.nullif(F.regexp_extract("text", "([0-9]{1,9})", 1), F.lit(""))).alias("first_number"), F.col("text").rlike("[0-9]").alias("has_digit"))


@query("SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) * 10000000)::DECIMAL(38,2)::BIGINT AS units FROM orders")
def exact_decimal(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", (F.col("o_totalprice").cast("decimal(18,2)") * F.lit(10_000_000).cast("decimal(10,0)")).cast("long").alias("units"))


@query("""WITH t AS (SELECT o_orderkey, 1995 + o_orderkey % 7 AS y, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 31 AS d FROM orders)
SELECT o_orderkey, CASE WHEN d <= day(last_day(make_date(y, m, 1))) THEN make_date(y, m, 1) + d::INTEGER - 1 END AS strict_day, make_date(y, m, 1) + d::INTEGER - 1 AS lenient_day FROM t""")
def dates_strict_vs_lenient(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat_ws("-", (1995 + k % 7).cast("string"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lpad((1 + k % 31).cast("string"), 2, "0"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", values.strict_date(text).alias("strict_day"), values.lenient_date(text).alias("lenient_day"))


@query("SELECT (ts + INTERVAL 330 MINUTE)::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def market_day(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy(values.market_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT s_suppkey, upper(array_to_string(list_transform(list_slice(regexp_split_to_array(trim(s_name), '[^A-Za-z0-9]+'), 1, 2), lambda w: left(w, 1)), '')) AS initials,
(list_sum(list_transform(string_split(s_name, ''), lambda c: ascii(c))) % 4)::INTEGER AS tone FROM supplier""")
def initials_tone(spark, sf_dir):
    spaced = F.regexp_replace("s_name", "[^A-Za-z0-9]+", " ")
    return Tables(spark, sf_dir).supplier.select("s_suppkey", keys.initials(spaced).alias("initials"), keys.tone(F.col("s_name")).cast("int").alias("tone"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)licen[cs]ed? under') AS has_licence, nullif(regexp_extract(text, '(?i)version ([0-9.]*[0-9])', 1), '') AS version FROM documents""")
def label_value(spark, sf_dir):
    text = F.col("text")
    return Tables(spark, sf_dir).documents.select("doc_id", text.rlike("(?i)licen[cs]ed? under").alias("has_licence"), F.nullif(F.regexp_extract(text, "(?i)version ([0-9.]*[0-9])", 1), F.lit("")).alias("version"))


@query(r"""SELECT doc_id, strpos(lower(text), 'license')::BIGINT AS place, substr(text, greatest(1, strpos(lower(text), 'license') - 20), 60) AS context FROM documents WHERE strpos(lower(text), 'license') > 0""")
def mentions_context(spark, sf_dir):
    place = F.instr(F.lower("text"), "license")
    return Tables(spark, sf_dir).documents.where(place > 0).select("doc_id", place.cast("long").alias("place"), F.substr("text", F.greatest(F.lit(1), place - 20), F.lit(60)).alias("context"))


@query(r"""SELECT doc_id, min(v) AS epoch, count(*) AS found FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{10})', 1))::BIGINT AS v FROM documents) WHERE v BETWEEN 946684800 AND 4102444800 GROUP BY doc_id""")
def epoch_in_text(spark, sf_dir):
    found = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{10})"), F.lit(1))).alias("v")).select("doc_id", F.col("v").cast("long").alias("v"))
    return found.where(F.col("v").between(946_684_800, 4_102_444_800)).groupBy("doc_id").agg(F.min("v").alias("epoch"), F.count(F.lit(1)).alias("found"))


@query("""SELECT event_type, k, count(*) AS n FROM (SELECT event_type, (props ->> '$.k')::BIGINT AS k FROM events) GROUP BY ALL""")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return Tables(spark, sf_dir).events.select("event_type", k.alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
