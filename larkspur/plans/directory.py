"""Directory queries: filter, sort, page, facets, statuses, coverage, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import values
from larkspur.operators import fields, history
from larkspur.plans.common import Tables

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query("""SELECT o_orderkey, c_name, o_orderdate, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING' AND contains(lower(c_name), '0000') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25""")
def directory_page(spark, sf_dir):
    """Filtered newest-first page 2 of 25: the filters reach both scans, the page is the engine's top-k."""
    t = Tables(spark, sf_dir)
    people = t.customer.where((F.col("c_mktsegment") == "BUILDING") & F.contains(F.lower("c_name"), F.lit("0000"))).select("c_custkey", "c_name")
    found = t.orders.where("o_orderstatus = 'O'").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return history.page(found, [F.desc("o_orderdate"), F.col("o_orderkey")], 25, 2).select("o_orderkey", "c_name", "o_orderdate", F.round("o_totalprice", 2).alias("total"))


@query("""WITH j AS (SELECT o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM j WHERE c_mktsegment = 'BUILDING' GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM j WHERE o_orderstatus = 'O' GROUP BY 2""")
def directory_facets(spark, sf_dir):
    """Each facet counts over the other filters; one aggregate of the pair of dimensions serves both."""
    t = Tables(spark, sf_dir)
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderstatus", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    status = pairs.where("c_mktsegment = 'BUILDING'").select(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value"), "n")
    segment = pairs.where("o_orderstatus = 'O'").select(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("value"), "n")
    return status.unionByName(segment).groupBy("facet", "value").agg(F.sum("n").alias("n"))


@query("""SELECT o_orderstatus AS reported, CASE WHEN o_orderstatus = 'O' AND o_orderdate::DATE + 10 < DATE '1998-06-01' THEN 'closed' WHEN o_orderstatus = 'O' AND o_orderdate::DATE > DATE '1998-06-01' THEN 'upcoming'
WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'listed' ELSE 'unknown' END AS displayed, count(*) AS n FROM orders GROUP BY ALL""")
def display_status(spark, sf_dir):
    opened, today = F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")
    status = F.col("o_orderstatus")
    shown = F.when((status == "O") & (F.date_add(opened, 10) < today), "closed").when((status == "O") & (opened > today), "upcoming").when(status == "O", "open").when(status == "F", "listed").otherwise("unknown")
    return Tables(spark, sf_dir).orders.groupBy(status.alias("reported"), shown.alias("displayed")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'undated' ELSE year(o_orderdate)::VARCHAR END AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def record_year_bucket(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return Tables(spark, sf_dir).orders.groupBy(F.coalesce(F.left(F.nullif(text, F.lit("")), F.lit(4)), F.lit("undated")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN lower(c_mktsegment) ELSE 'unknown' END AS board, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def board_bucket(spark, sf_dir):
    lowered = F.lower("c_mktsegment")
    board = F.when(lowered.isin("building", "machinery"), lowered).otherwise("unknown")
    return Tables(spark, sf_dir).customer.groupBy(board.alias("board")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'N' THEN l_quantity END, CASE WHEN l_linestatus = 'O' THEN p_size::DOUBLE END) AS lot,
CASE WHEN l_returnflag = 'N' THEN 'market_lot' WHEN l_linestatus = 'O' THEN 'minimum_bid' ELSE 'missing' END AS basis FROM lineitem JOIN part ON l_partkey = p_partkey""")
def preferred_lot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    market, bid = F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"
    basis = F.when(market, "market_lot").when(bid, "minimum_bid").otherwise("missing")
    lot = F.coalesce(F.when(market, F.col("l_quantity")), F.when(bid, F.col("p_size").cast("double")))
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", lot.alias("lot"), basis.alias("basis"))


@query("""WITH b AS (SELECT l_partkey, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high FROM lineitem GROUP BY 1)
SELECT p_partkey, low, high, p_retailprice < low OR p_retailprice > high AS outside FROM part JOIN b ON p_partkey = l_partkey""")
def price_conflict(spark, sf_dir):
    t = Tables(spark, sf_dir)
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    band = t.lineitem.groupBy("l_partkey").agg(F.min(unit).alias("low"), F.max(unit).alias("high"))
    outside = (F.col("p_retailprice") < F.col("low")) | (F.col("p_retailprice") > F.col("high"))
    return t.part.join(band, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "low", "high", outside.alias("outside"))


_STATUS = "CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'conflict' WHEN l_linestatus = 'O' THEN 'provisional' WHEN l_returnflag = 'A' THEN 'missing' ELSE 'verified' END"


@query(f"""WITH s AS (SELECT l_orderkey, {_STATUS} AS st FROM lineitem), r AS (SELECT l_orderkey, CASE WHEN bool_or(st = 'conflict') THEN 'conflict' WHEN bool_or(st = 'provisional') THEN 'provisional' WHEN bool_and(st = 'verified') THEN 'verified' ELSE 'missing' END AS status FROM s GROUP BY 1)
SELECT status, count(*) AS records FROM r GROUP BY 1""")
def record_status_rollup(spark, sf_dir):
    status = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "conflict").when(F.col("l_linestatus") == "O", "provisional").when(F.col("l_returnflag") == "A", "missing").otherwise("verified")
    records = Tables(spark, sf_dir).lineitem.select("l_orderkey", status.alias("st")).groupBy("l_orderkey").agg(fields.roll_up(F.col("st")).alias("status"))
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("records"))


_REASON = "CASE WHEN user_id IS NULL THEN 'no_identity' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'other_series' WHEN (props ->> '$.k')::INTEGER % 10 NOT IN (0) AND value < 10 THEN 'flagged' END"


def _reason():
    k = F.get_json_object("props", "$.k").try_cast("int")
    flag = values.flagged(F.when(k % 10 == 0, "No").otherwise("yes")) & (F.col("value") < 10)
    return F.when(F.col("user_id").isNull(), "no_identity").when(~F.col("event_type").isin("view", "click", "purchase"), "other_series").when(flag, "flagged")


@query(f"SELECT coalesce({_REASON}, 'admitted') AS reason, count(*) AS n FROM events GROUP BY 1")
def admission_reasons(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy(F.coalesce(_reason(), F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_type, count(*) FILTER ({_REASON} IS NULL) AS kept, count(*) FILTER ({_REASON} IS NOT NULL) AS excluded FROM events GROUP BY 1")
def admitted_split(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count_if(_reason().isNull()).alias("kept"), F.count_if(_reason().isNotNull()).alias("excluded"))


@query("""SELECT year(o_orderdate) AS year, count(*) AS lines, count(*) FILTER (l_returnflag = 'N') AS verified, count(*) FILTER (l_returnflag = 'A') AS missing, count(*) FILTER (l_returnflag = 'R') AS held,
max(l_shipdate) AS latest FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def coverage_fields(spark, sf_dir):
    t = Tables(spark, sf_dir)
    flag = F.col("l_returnflag")
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(flag == "N").alias("verified"), F.count_if(flag == "A").alias("missing"), F.count_if(flag == "R").alias("held"), F.max("l_shipdate").alias("latest")
    )


@query("""SELECT y AS year, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM range(1990, 2005) r(y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY 1""")
def year_spine(spark, sf_dir):
    """Every year has a row; the orders are counted before they meet the spine of fifteen years."""
    t = Tables(spark, sf_dir)
    counted = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return spark.range(1990, 2005).toDF("year").join(counted, F.col("year") == F.col("y"), "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def histogram(spark, sf_dir):
    return Tables(spark, sf_dir).events.where("event_type is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, CASE WHEN count(o_orderkey) = 0 THEN 'absent' WHEN bool_or(o_orderstatus = 'P') THEN 'pending' WHEN bool_or(o_orderstatus = 'O') THEN 'open' ELSE 'settled' END AS class
FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def issuer_rollup(spark, sf_dir):
    """Orders are summed per customer before the nation's few keys, so no nation's orders meet in one task."""
    t = Tables(spark, sf_dir)
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    joined = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = F.coalesce(F.sum("n"), F.lit(0))
    group = F.when(orders == 0, "absent").when(F.bool_or("p"), "pending").when(F.bool_or("o"), "open").otherwise("settled")
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), orders.alias("orders"), group.alias("class"))


@query("""SELECT o_custkey, count(*) AS orders, max_by(o_orderkey, (o_orderdate, -o_orderkey)) AS latest_order, max(o_orderdate) AS latest FROM orders GROUP BY 1""")
def latest_per_company(spark, sf_dir):
    """An arg-max aggregate with a total tie-break: no window, so partial sums go through the shuffle."""
    return Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("latest_order"), F.max("o_orderdate").alias("latest"))


@query("""WITH t AS (SELECT event_type, ts, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y/%m/%d %H:%M:%S') END AS txt FROM events) SELECT event_type, max(txt) AS lexical, max_by(txt, (ts, txt)) AS parsed FROM t GROUP BY 1""")
def max_clock_lex_vs_parsed(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    rows = Tables(spark, sf_dir).events.select("event_type", text.alias("txt"), F.col("ts"))
    return rows.groupBy("event_type").agg(F.max("txt").alias("lexical"), F.max_by("txt", F.struct("ts", "txt")).alias("parsed"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS lines FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN lines ELSE o_totalprice::DECIMAL(18,2) END AS declared, lines FROM orders JOIN s ON o_orderkey = l_orderkey)
SELECT declared = lines AS agrees, count(*) AS orders, sum(lines)::DOUBLE AS total FROM d GROUP BY 1""")
def total_check(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sums = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("lines"))
    declared = F.when(F.col("o_orderkey") % 3 == 0, F.col("lines")).otherwise(F.col("o_totalprice").cast("decimal(18,2)"))
    joined = t.orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy((declared == F.col("lines")).alias("agrees")).agg(F.count(F.lit(1)).alias("orders"), F.sum("lines").cast("double").alias("total"))


@query("""SELECT event_type, count(*) AS runs, max(ts) AS latest, max(gap)::BIGINT AS max_gap_s, CASE WHEN max(gap) > 7200 THEN 'critical' WHEN max(gap) > 3600 THEN 'warning' ELSE 'healthy' END AS state
FROM (SELECT event_type, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS gap FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events)) GROUP BY 1""")
def schedule_gaps(spark, sf_dir):
    found = history.gaps(Tables(spark, sf_dir).events.select("event_type", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts")), "event_type", "ts")
    gap = F.col("max_gap_s")
    return found.withColumn("state", F.when(gap > 7200, "critical").when(gap > 3600, "warning").otherwise("healthy"))


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT user_id, island::BIGINT AS island, min(event_type) AS state, count(*) AS length, min(ts) AS first, max(ts) AS last FROM i GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY island DESC) <= 48""")
def health_islands(spark, sf_dir):
    runs = history.islands(Tables(spark, sf_dir).events, ["user_id"], "event_type", ["ts", "event_id"])
    return history.newest(runs, ["user_id"], [F.desc("island")], 48).select("user_id", "island", "state", "length", "first", "last")


@query("""WITH r AS (SELECT o_orderkey, year(o_orderdate) AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey) AS turn FROM orders) SELECT o_orderkey, year, turn FROM r ORDER BY turn, year DESC LIMIT 48""")
def balanced_top_n(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate", F.year("o_orderdate").cast("long").alias("year"))
    return history.balanced_top(orders, "year", [F.desc("o_orderdate"), F.col("o_orderkey")], 48, [F.desc("year")]).select("o_orderkey", "year", F.col("turn").cast("long").alias("turn"))


@query("""SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_success FROM events""")
def carry_last_success(spark, sf_dir):
    success = F.when(F.col("event_type") == "purchase", F.col("ts"))
    return history.carry_last(Tables(spark, sf_dir).events, ["user_id"], ["ts", "event_id"], success, "last_success").select("event_id", "last_success")


@query("""WITH s AS (SELECT user_id, count(*) AS attempts, max(ts) AS attempted, bool_or(event_type = 'purchase' AND value > 95) AS done FROM events GROUP BY 1), t AS (SELECT *, CASE WHEN attempts > 70 THEN 2 ELSE 1 END AS tier FROM s WHERE NOT done)
SELECT user_id, tier, attempts, attempted FROM t ORDER BY tier, attempted, user_id LIMIT 20""")
def retry_order(spark, sf_dir):
    state = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("attempted"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 95)).alias("done"))
    tiered = state.where("not done").withColumn("tier", F.when(F.col("attempts") > 70, 2).otherwise(1))
    return history.page(tiered, [F.col("tier"), F.col("attempted"), F.col("user_id")], 20, 1).select("user_id", "tier", "attempts", "attempted")


@query("""WITH a AS (SELECT event_type, max(ts) AS latest, (epoch(TIMESTAMP '2024-02-01') - epoch(max(date_trunc('second', ts))))::BIGINT AS age_s FROM events GROUP BY 1), h AS (SELECT event_type, latest, greatest(0, age_s) AS age_s, CASE WHEN age_s IS NULL THEN 'unknown' WHEN age_s > 172800 THEN 'stale' ELSE 'healthy' END AS state FROM a)
SELECT h.*, CASE state WHEN 'stale' THEN 'run the collector' WHEN 'unknown' THEN 'check the clock' ELSE 'none' END AS guidance FROM h""")
def freshness_health(spark, sf_dir):
    latest = Tables(spark, sf_dir).events.groupBy("event_type").agg(F.max("ts").alias("latest"), F.max(F.date_trunc("second", "ts")).alias("second"))
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp(F.col("second").cast("timestamp"))
    state = F.when(F.col("age").isNull(), "unknown").when(F.col("age") > 172_800, "stale").otherwise("healthy")
    found = latest.withColumn("age", age).withColumn("state", state)
    guidance = F.coalesce(F.try_element_at(F.create_map(F.lit("stale"), F.lit("run the collector"), F.lit("unknown"), F.lit("check the clock")), "state"), F.lit("none"))
    return found.select("event_type", "latest", F.greatest(F.lit(0).cast("long"), "age").alias("age_s"), "state", guidance.alias("guidance"))


@query("""SELECT quality IS NOT NULL AS labelled, count(*) AS docs, count(DISTINCT source) AS sources FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS quality FROM labels) USING (doc_id) GROUP BY 1""")
def semi_anti(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs, known = t.documents.select("doc_id", "source"), t.labels.select("doc_id")
    both = docs.join(known, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(docs.join(known, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))
    return both.groupBy("labelled").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"))


@query("""SELECT count(*) FILTER (quality = 1) AS parsed, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS unseen, min(doc_id) FILTER (quality IS NULL) AS next_unseen FROM documents LEFT JOIN labels USING (doc_id)""")
def progress_counters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    q = F.col("quality")
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.agg(F.count_if(q == 1).alias("parsed"), F.count_if(q == 0).alias("failed"), F.count_if(q.isNull()).alias("unseen"), F.min(F.when(q.isNull(), F.col("doc_id"))).alias("next_unseen"))


@query(r"""SELECT doc_id, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(text, '[\s\x{A0}\x{FEFF}]+', ' ', 'g'))) ORDER BY doc_id) > 1 AS is_repeat FROM documents""")
def duplicates(spark, sf_dir):
    """A repeat is any but the smallest id of its text: a grouped minimum joined back, so a huge group of copies is no one task."""
    from larkspur.functions import keys

    docs = Tables(spark, sf_dir).documents.select("doc_id", F.sha2(keys.collapse(F.col("text")), 256).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "hash").select("doc_id", (F.col("doc_id") != F.col("first")).alias("is_repeat"))


@query("""SELECT conv_id, min(turn) FILTER (contains(lower(text), 'th')) AS first_turn, min_by(role, turn) FILTER (contains(lower(text), 'th')) AS role FROM conversations GROUP BY 1 HAVING count(*) FILTER (contains(lower(text), 'th')) > 0""")
def first_by_position(spark, sf_dir):
    hit = Tables(spark, sf_dir).conversations.where(F.contains(F.lower("text"), F.lit("th")))
    return hit.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("role"))


