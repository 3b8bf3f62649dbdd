"""Queries over nested records, open merges, page structure, scans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import fields, published
from larkspur.functions.arrays import occurrences
from larkspur.plans.common import Tables
from larkspur.sources import manifests
from larkspur.sources.scratch import new_path, tidy
from larkspur.streaming import upserts

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query(r"""WITH p AS (SELECT page_id, html, string_split(html, '<a ') AS ps FROM pages), u AS (SELECT page_id, html, unnest(ps) AS part, unnest(range(1, len(ps) + 1)) AS i, len(ps) AS n FROM p),
o AS (SELECT page_id, html, i, n, sum(length(part) + 3) OVER (PARTITION BY page_id ORDER BY i)::BIGINT - 3 AS before FROM u)
SELECT page_id, i::INTEGER AS link, list_extract(regexp_extract_all(substr(html, greatest(1, before - 1399), least(before, 1400)), '<h[1-6][^>]*>([^<]*)</h', 1), -1) AS heading FROM o WHERE i < n""")
def nearest_before(spark, sf_dir):
    """The last heading within 1,400 characters before each link."""
    heading = lambda o: F.try_element_at(F.regexp_extract_all(o["lead"], F.lit("<h[1-6][^>]*>([^<]*)</h"), F.lit(1)), F.lit(-1))
    links = Tables(spark, sf_dir).pages.select("page_id", F.posexplode(F.transform(occurrences(F.col("html"), "<a ", before=1400), heading)).alias("pos", "heading"))
    return links.select("page_id", (F.col("pos") + 1).alias("link"), "heading")


@query("""SELECT doc_id, unnest(range(1, len(ls) + 1))::INTEGER AS line, trim(substr(unnest(ls), 11, 10)) AS cell FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def fixed_width_cell(spark, sf_dir):
    lines = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line"), F.trim(F.substring("line", 11, 10)).alias("cell"))


@query("""WITH b AS (SELECT o_orderkey AS id, unnest(['status', 'priority']) AS path, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders),
a AS (SELECT id, path, CASE WHEN id % 6 = 0 AND path = 'status' THEN 'X' WHEN id % 10 = 0 THEN NULL ELSE value END AS value FROM b WHERE NOT (id % 14 = 0 AND path = 'priority')),
c AS (SELECT id, path, CASE WHEN id % 4 = 0 AND path = 'status' THEN 'Y' ELSE value END AS value FROM b WHERE NOT (id % 22 = 0 AND path = 'priority')),
m AS (SELECT id, path, b.id IS NOT NULL AS hb, a.id IS NOT NULL AS ha, c.id IS NOT NULL AS hc, b.value AS b, a.value AS a, c.value AS c FROM b FULL JOIN a USING (id, path) FULL JOIN c USING (id, path)),
o AS (SELECT *, CASE WHEN hb = ha AND b IS NOT DISTINCT FROM a THEN 'unchanged' WHEN hc = ha AND c IS NOT DISTINCT FROM a THEN 'already' WHEN hc = hb AND c IS NOT DISTINCT FROM b THEN 'applied' ELSE 'conflict' END AS outcome FROM m)
SELECT path, outcome, value, count(*) AS n FROM (SELECT path, outcome, CASE WHEN outcome = 'applied' THEN a ELSE c END AS value, CASE WHEN outcome = 'applied' THEN ha ELSE hc END AS there FROM o) WHERE there GROUP BY ALL""")
def three_way_paths(spark, sf_dir):
    pairs = F.explode(F.array(F.struct(F.lit("status").alias("path"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("path"), F.col("o_orderpriority").alias("value"))))
    before = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), pairs.alias("p")).select("id", "p.path", "p.value")
    k, path, value = F.col("id"), F.col("path"), F.col("value")
    after = before.where(~((k % 14 == 0) & (path == "priority"))).withColumn("value", F.when((k % 6 == 0) & (path == "status"), "X").when(k % 10 == 0, F.lit(None)).otherwise(value))
    current = before.where(~((k % 22 == 0) & (path == "priority"))).withColumn("value", F.when((k % 4 == 0) & (path == "status"), "Y").otherwise(value))
    return published.three_way_paths(current, before, after).groupBy("path", "outcome", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS value, CASE l_returnflag WHEN 'A' THEN 'conflict' WHEN 'N' THEN 'odd' ELSE NULL END AS st, [l_shipdate, l_shipdate, l_shipdate + INTERVAL 1 DAY] AS ev FROM lineitem)
SELECT CASE WHEN value IS NULL THEN coalesce(st, 'missing') WHEN st = 'conflict' THEN st ELSE 'verified' END AS status, CASE WHEN value IS NULL THEN 0 ELSE 2 END AS evidence, count(*) AS n, sum(value) AS total FROM f GROUP BY ALL""")
def published_fields(spark, sf_dir):
    evidence = F.array("l_shipdate", "l_shipdate", F.col("l_shipdate") + F.expr("INTERVAL 1 DAY"))
    status = F.when(F.col("l_returnflag") == "A", "conflict").when(F.col("l_returnflag") == "N", "odd")
    made = published.field(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")), status, evidence)
    rows = Tables(spark, sf_dir).lineitem.select(made.alias("f"))
    return rows.groupBy("f.status", F.size("f.evidence").alias("evidence")).agg(F.count(F.lit(1)).alias("n"), F.sum("f.value").alias("total"))


@query("""WITH e AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS items FROM orders GROUP BY 1) SELECT o_custkey, (len(items) + CASE WHEN list_contains(items, 'P') THEN 0 ELSE 1 END)::INTEGER AS added, (len(list_filter(items, lambda x: x <> 'F')) + 1)::INTEGER AS replaced, len(list_filter(items, lambda x: x NOT IN ('F', 'O')))::INTEGER AS remaining FROM e""")
def evidence_once(spark, sf_dir):
    item = lambda v: F.struct(F.lit(v).alias("url"))
    sets = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.collect_set(F.struct(F.col("o_orderstatus").alias("url"))).alias("items"))
    return sets.select("o_custkey", F.size(published.add_once(F.col("items"), item("P"), ["url"])).alias("added"), F.size(published.replace_by(F.col("items"), item("F"), "url")).alias("replaced"), F.size(published.without(F.col("items"), F.array(item("F"), item("O")))).alias("remaining"))


@query("""SELECT year(o_orderdate) AS year, count(*) AS n, max(o_orderkey) AS last_key, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1""")
@tidy
def manifest_scan(spark, sf_dir):
    """Orders written as year folders of JSON and scanned back; the filter on the year prunes folders. Runs jobs when called."""
    path = new_path(spark, "manifests")
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    manifests.write(orders, path)
    found = manifests.read(spark, path, "o_orderkey long, o_totalprice double, year int").where("year >= 1998")
    return found.groupBy(F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey // 100 AS batch, count(*) AS candidates, count(*) = count(DISTINCT c_custkey) AND count(*) = count(DISTINCT c_name) AS is_unique, sha256(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey)) AS approval FROM customer GROUP BY 1""")
def approval_gate(spark, sf_dir):
    """A batch is approved by its content's hash; its keys and names must each be unique. A hundred consecutive keys are a batch."""
    batch = Tables(spark, sf_dir).customer.groupBy(F.floor(F.col("c_custkey") / 100).alias("batch"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    n = F.count(F.lit(1))
    return batch.agg(n.alias("candidates"), ((n == F.count_distinct("c_custkey")) & (n == F.count_distinct("c_name"))).alias("is_unique"), F.sha2(ids, 256).alias("approval"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
@tidy
def stream_window(spark, sf_dir):
    """Counts by day of a watermarked stream (an extension): every file that is there is one run's input. Runs the stream when called."""
    path = new_path(spark, "windows")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = upserts.windowed_counts(events, "ts", "event_type", "1 day", "40 days")
    # every batch writes the counts that changed; the last batch's count of a window holds
    keep = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/rows/run={i}")
    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("""SELECT o_orderstatus, count(*) AS n, max(greatest(o_orderdate, o_orderdate + INTERVAL 2 DAY)) AS clock FROM orders GROUP BY 1""")
def record_clock(spark, sf_dir):
    nested = F.array("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS"))
    rows = Tables(spark, sf_dir).orders.select("o_orderstatus", published.record_clock(F.col("o_orderdate"), nested).alias("clock"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("clock").alias("clock"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k <= 5""")
def history_tail(spark, sf_dir):
    from larkspur.operators import history

    return history.newest(Tables(spark, sf_dir).events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def newest_per_key(spark, sf_dir):
    return fields.latest_by(Tables(spark, sf_dir).orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
