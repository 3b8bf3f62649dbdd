"""Queries over nested documents, proposals that hold together and ordered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import folds, nested, proposals
from larkspur.plans.common import Tables, spread
from larkspur.sources.scratch import tidy

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def json(*columns) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def order_documents(t: Tables) -> DataFrame:
    """(id, document): an order with its lines as one JSON document; clocks in two spellings, a name with a dot, nulls."""
    ship = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+05:30'")).when(F.col("l_linenumber") % 5 == 0, "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    field = F.struct(ship.alias("collected_at"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("value"))
    # an order has a few lines; its document takes long to open for its size, so partitions are not merged by size, and the
    # orders are dealt out with their lines: a broadcast would leave them to the few tasks that read them
    lines = spread(t.lineitem, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), field.alias("ship")))).alias("lines"))
    k = F.col("o_orderkey")
    note = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "").otherwise(F.concat(F.lit('see "'), "o_orderpriority", F.lit('"')))
    document = json(k.alias("id"), "lines", note.alias("note"), F.struct(F.col("o_orderstatus").alias("order.status"), (k % 2 == 0).alias("open")).alias("state"))
    return t.orders.join(lines.hint("merge"), k == F.col("l_orderkey"), "left").select(k.alias("id"), document.alias("document"))


_ORDER_DOCUMENTS = """lines AS (SELECT l_orderkey, list({'n': l_linenumber, 'part': l_partkey, 'ship': {'collected_at': CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S+05:30')
  WHEN l_linenumber % 5 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END, 'value': strftime(l_shipdate, '%Y-%m-%d')}} ORDER BY l_linenumber, l_partkey, l_shipdate) AS lines FROM lineitem GROUP BY 1),
docs AS (SELECT o_orderkey AS id, to_json({'id': o_orderkey, 'lines': lines, 'note': CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'see "' || o_orderpriority || '"' END,
  'state': {'order.status': o_orderstatus, 'open': o_orderkey % 2 = 0}}) AS document FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
tree AS (SELECT docs.id, j.key, j.value, j.type, regexp_replace(j.fullkey, '[.]"([^"]*)"', '["\\1"]', 'g') AS path FROM docs, json_tree(document) AS j)"""


@query(f"WITH {_ORDER_DOCUMENTS} SELECT id, path, value ->> '$' AS text FROM tree WHERE type = 'VARCHAR'")
def json_strings(spark, sf_dir):
    """Every string anywhere in the orders' documents."""
    found = nested.nodes(order_documents(Tables(spark, sf_dir)))
    return found.where("kind = 'string'").select("id", nested.path_text(F.col("path")).alias("path"), "text")


@query(f"""WITH {_ORDER_DOCUMENTS}, r AS (SELECT id, regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE type WHEN 'OBJECT' THEN len(json_keys(value)) WHEN 'ARRAY' THEN json_array_length(value) WHEN 'NULL' THEN NULL ELSE length(value ->> '$') END AS size FROM tree)
SELECT path, kind, count(DISTINCT id) AS documents, count(*) AS found, max(size)::INTEGER AS longest FROM r GROUP BY ALL""")
def json_paths(spark, sf_dir):
    """The shape of the orders' documents: each path, with any item of an array as one, and the kinds of values found there."""
    return nested.shapes(nested.nodes(order_documents(Tables(spark, sf_dir))))


@query(f"WITH {_ORDER_DOCUMENTS} SELECT id, path, key, CASE WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, value ->> '$' AS text FROM tree WHERE key IN ('order.status', 'part')")
def json_matching_keys(spark, sf_dir):
    """Scalar values under keys that name a part or a status, whatever the key's spelling."""
    return nested.matching_keys(nested.nodes(order_documents(Tables(spark, sf_dir))), "^part$|status$")


@query(f"""WITH {_ORDER_DOCUMENTS}, s AS (SELECT id, value ->> '$' AS text, path FROM tree WHERE type = 'VARCHAR' AND value ->> '$' <> '' AND len(regexp_extract_all(path, '[.\\[]')) <= 3 AND path <> '$["order.status"]'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path LIKE '$.state%', path LIKE '$.note%') AS place FROM s WHERE path IN ('$.note', '$.state["order.status"]') OR path LIKE '$.lines[%].ship')
SELECT id, text FROM r WHERE place = 1""")
def json_first_string(spark, sf_dir):
    """Each document's first non-empty string of at most three steps: the note if it has one, else the status."""
    return nested.first_strings(nested.nodes(order_documents(Tables(spark, sf_dir))))


@query(f"""WITH {_ORDER_DOCUMENTS}, c AS (SELECT id, value ->> '$' AS clock, path, TRY_CAST(value ->> '$' AS TIMESTAMPTZ) AS seen, regexp_extract(path, '\\[([0-9]+)\\]', 1)::INTEGER AS place FROM tree WHERE key = 'collected_at')
SELECT id, clock, path FROM c WHERE seen IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen DESC, place) = 1""")
def nested_clock(spark, sf_dir):
    """The latest clock at any depth of each document, as written, and where; texts that are no clock do not count."""
    return nested.latest_clock(nested.nodes(order_documents(Tables(spark, sf_dir))))


def _sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, before, after) documents of the customers: fields that are atomic, arrays that grow or lose items, names with dots, nested members."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    acct = lambda value, status: text('"acct":{"value":', value.cast("string"), ',"status":"', status, '"}')
    dotted = lambda value: text('"a.b":"', value, '"')
    nation = text('"a":{"b":', F.col("c_nationkey").cast("string"), "}")
    first = text('"n', (k % 3).cast("string"), '"')
    notes = lambda *items: text('"notes":[', F.concat_ws(",", *items), "]")
    terms = lambda lot, most: text('"terms":{"lot":', lot.cast("string"), ',"band":{"min":', (k % 5).cast("string"), ',"max":', most.cast("string"), "}}")
    x, new, cur = F.lit('"x"'), F.lit('"new"'), F.lit('"cur"')
    document = lambda *members: text("{", F.concat_ws(",", *members), "}").alias("document")
    seg, lot = F.col("c_mktsegment"), k % 10
    before = document(acct(k % 1000, F.lit("verified")), dotted(seg), nation, notes(first, x), terms(lot, F.lit(9)))
    after = document(
        acct(k % 1000, F.when(k % 2 == 0, "provisional").otherwise("verified")),
        F.when(k % 5 != 0, dotted(seg)),
        nation,
        F.when(k % 3 == 0, notes(first, x, new)).when(k % 3 == 1, notes(x)).otherwise(notes(first, x)),
        terms(lot + F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 6 == 0, 10).otherwise(9)),
    )
    current = document(
        acct(k % 1000 + F.when(k % 4 == 0, 1).otherwise(0), F.lit("verified")),
        F.when(k % 15 == 0, F.lit(None)).when(k % 10 == 0, dotted(F.lit("X"))).otherwise(dotted(seg)),
        nation,
        F.when(k % 9 == 0, notes(first, x, new)).when(k % 9 == 1, notes(first, x, cur)).otherwise(notes(first, x)),
        terms(lot + F.when(k % 14 == 0, 1).otherwise(0), F.when(k % 12 == 0, 11).when(k % 18 == 0, 10).otherwise(9)),
    )
    return tuple(t.customer.select(k.alias("id"), side) for side in (current, before, after))


@query("""WITH k AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation FROM customer),
f AS (SELECT *, '{"status":"verified","value":' || (k % 1000 + (k % 4 = 0)::INT) || '}' AS c_acct, '{"status":"provisional","value":' || k % 1000 || '}' AS a_acct,
  CASE WHEN k % 2 = 1 THEN 'same' WHEN k % 4 = 0 THEN 'conflict' ELSE 'applied' END AS acct,
  CASE WHEN k % 5 <> 0 THEN 'same' WHEN k % 15 = 0 THEN 'already' WHEN k % 10 = 0 THEN 'conflict' ELSE 'applied' END AS dotted, CASE WHEN k % 15 = 0 THEN NULL WHEN k % 10 = 0 THEN 'X' ELSE seg END AS c_dotted,
  CASE WHEN k % 3 = 2 THEN 'same' WHEN k % 9 = 0 THEN 'already' WHEN k % 9 = 1 THEN 'conflict' ELSE 'applied' END AS notes,
  '["n' || k % 3 || '","x"' || CASE WHEN k % 9 = 0 THEN ',"new"' WHEN k % 9 = 1 THEN ',"cur"' ELSE '' END || ']' AS c_notes, CASE WHEN k % 3 = 0 THEN '["n0","x","new"]' ELSE '["x"]' END AS a_notes,
  k % 10 AS lot, (k % 7 = 0)::INT AS a_more, (k % 14 = 0)::INT AS c_more, CASE WHEN k % 6 = 0 THEN 10 ELSE 9 END AS a_most, CASE WHEN k % 12 = 0 THEN 11 WHEN k % 18 = 0 THEN 10 ELSE 9 END AS c_most FROM k),
o AS (SELECT *, CASE WHEN a_more = 0 THEN 'same' WHEN c_more = 1 THEN 'already' ELSE 'applied' END AS lots, CASE WHEN a_most = 9 THEN 'same' WHEN c_most = 10 THEN 'already' WHEN c_most = 11 THEN 'conflict' ELSE 'applied' END AS mosts FROM f),
p AS (SELECT *, CASE WHEN lots = 'same' AND mosts = 'same' THEN [] WHEN a_more = c_more AND a_most = c_most THEN ['already'] ELSE [lots, mosts] END AS terms FROM o),
q AS (SELECT *, CASE WHEN acct = 'same' AND k % 4 <> 0 AND dotted IN ('same', 'already') AND (dotted = 'already' OR (k % 10 <> 0 AND k % 15 <> 0)) AND (notes = 'already' OR (notes = 'same' AND k % 9 NOT IN (0, 1))) AND a_more = c_more AND a_most = c_most
  THEN (acct <> 'same' OR dotted <> 'same' OR notes <> 'same' OR len(terms) > 0) END AS whole FROM p)
SELECT k AS id, '{' || concat_ws(',', '"a":{"b":' || nation || '}', CASE WHEN dotted <> 'applied' THEN '"a.b":"' || c_dotted || '"' END, '"acct":' || CASE acct WHEN 'applied' THEN a_acct ELSE c_acct END, '"notes":' || CASE notes WHEN 'applied' THEN a_notes ELSE c_notes END,
  '"terms":{"band":{"max":' || CASE mosts WHEN 'applied' THEN a_most ELSE c_most END || ',"min":' || k % 5 || '},"lot":' || lot + CASE lots WHEN 'applied' THEN a_more ELSE c_more END || '}') || '}' AS document,
  CASE WHEN whole IS NOT NULL THEN 0 ELSE len(list_filter([acct, dotted, notes] || terms, lambda x: x = 'applied')) END AS applied,
  CASE WHEN whole IS NOT NULL THEN whole::BIGINT ELSE len(list_filter([acct, dotted, notes] || terms, lambda x: x = 'already')) END AS already,
  CASE WHEN whole IS NOT NULL THEN 0 ELSE len(list_filter([acct, dotted, notes] || terms, lambda x: x = 'conflict')) END AS conflicts FROM q""")
def document_merge(spark, sf_dir):
    """Three-way merge of the customers' documents, put together again."""
    return nested.merge_documents(*_sides(Tables(spark, sf_dir)))


@tidy
def atomic_proposals(spark, sf_dir):
    """Moves between years and changes of orders: what is applied, already there, in conflict or rolled back, with the years and states that the orders then have."""
    t = Tables(spark, sf_dir)
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    document = lambda status: json(F.struct(F.col(status).alias("value")).alias("status"), k.alias("key"))
    orders = t.orders.withColumns({"other": F.lit("Z"), "stale": F.when(k % 3 == 0, "Y").otherwise(F.col("o_orderstatus"))})
    records = orders.select(year.alias("partition"), k.alias("id"), document("o_orderstatus").alias("document"))
    bundle = lambda n: F.when(k % 7 == 0, F.floor(k / 70) + n)
    none = F.lit(None).cast("string")
    out = orders.where(k % 5 == 0).select(year.alias("partition"), k.alias("id"), F.lit("remove").alias("kind"), document("stale").alias("before"), none.alias("after"), bundle(0).alias("bundle"))
    into = orders.where(k % 5 == 0).select((year + 1).alias("partition"), k.alias("id"), F.lit("add").alias("kind"), none.alias("before"), document("other").alias("after"), bundle(F.when(k % 140 == 0, 1).otherwise(0)).alias("bundle"))
    change = orders.where(k % 5 == 1).select(year.alias("partition"), k.alias("id"), F.lit("change").alias("kind"), document("stale").alias("before"), document("other").alias("after"), bundle(0).alias("bundle"))
    outcomes, after = proposals.apply_proposals(records, out.unionByName(into).unionByName(change))
    now = after.select("partition", "id", F.get_json_object("document", "$.status.value").alias("status"))
    return outcomes.select("partition", "id", "kind", "outcome", "conflicts").join(now, ["partition", "id"], "left")


QUERIES["atomic_proposals"] = atomic_proposals
ORACLES["atomic_proposals"] = """WITH RECURSIVE o AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_orderstatus AS s, o_orderkey % 3 = 0 AND o_orderstatus <> 'Y' AS stale, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey // 70 END AS bundle FROM orders),
p AS (SELECT y AS partition, id, 'remove' AS kind, CASE WHEN stale THEN 'conflict' ELSE 'applied' END AS own, bundle, s, NULL AS next FROM o WHERE id % 5 = 0
  UNION ALL SELECT y + 1, id, 'add', 'applied', bundle + (id % 140 = 0)::INT, NULL, 'Z' FROM o WHERE id % 5 = 0
  UNION ALL SELECT y, id, 'change', CASE WHEN s = 'Z' THEN 'already' WHEN stale THEN 'conflict' ELSE 'applied' END, bundle, s, 'Z' FROM o WHERE id % 5 = 1),
fallen(id) AS (SELECT id FROM p WHERE own = 'conflict' AND (kind = 'remove' OR bundle IS NOT NULL) UNION SELECT b.id FROM fallen f JOIN p a ON a.id = f.id JOIN p b ON a.bundle = b.bundle)
SELECT p.partition::INTEGER AS partition, p.id, kind, CASE WHEN f.id IS NOT NULL AND own <> 'conflict' THEN 'rolled_back' ELSE own END AS outcome, (own = 'conflict')::BIGINT AS conflicts,
  CASE WHEN f.id IS NOT NULL OR own <> 'applied' THEN s ELSE next END AS status FROM p LEFT JOIN fallen f ON f.id = p.id"""


@tidy
def batch_fold(spark, sf_dir):
    """Three batches of orders folded into the customers in order: a later row sees what earlier ones inserted; three tenths share one code."""
    t = Tables(spark, sf_dir)
    c, k, o = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    padded = lambda n: F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0"))
    registry = t.customer.select(F.concat(F.lit("c"), c.cast("string")).alias("id"), "c_name", F.when(c % 4 == 0, c).alias("code"), F.col("c_nationkey").alias("partition"), (c % 10).alias("lot")).withColumnRenamed("c_name", "name")
    known = k % 5 == 0
    rows = t.orders.join(t.customer, o == c).select(
        (F.year("o_orderdate") % 3).alias("batch"),
        k.alias("seq"),
        F.when(known, F.concat(F.lit("c"), o.cast("string"))).otherwise(F.concat(F.lit("o"), (k % 4001).cast("string"))).alias("id"),
        F.when(known, F.col("c_name")).otherwise(padded(1000000 + (k * 7) % 9973)).alias("name"),
        F.when(k % 10 == 1, 99999999).when(k % 10 == 2, 99999999).when(k % 10 == 3, 99999999).when(k % 10 == 4, 5000000 + (k * 3) % 7001).when(k % 50 == 5, k % 1500).alias("code"),
        F.when(k % 15 == 0, -1).otherwise(F.col("c_nationkey")).alias("partition"),
        F.when(k % 10 == 0, o % 10).otherwise(k % 10).alias("lot"),
    )
    return folds.batch_fold(registry, rows, ["name", "code"], ["name"], ["lot"])


QUERIES["batch_fold"] = batch_fold
_FOLD_KEYS = ("id", "name", "code")
ORACLES["batch_fold"] = f"""WITH RECURSIVE reg AS (SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS code, c_nationkey AS partition, c_custkey % 10 AS lot FROM customer),
e AS (SELECT (year(o_orderdate) % 3)::INTEGER AS batch, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_custkey ELSE 'o' || o_orderkey % 4001 END AS id, CASE WHEN o_orderkey % 5 = 0 THEN c_name ELSE 'Customer#' || lpad((1000000 + (o_orderkey * 7) % 9973)::VARCHAR, 9, '0') END AS name,
  CASE WHEN o_orderkey % 10 IN (1, 2, 3) THEN 99999999 WHEN o_orderkey % 10 = 4 THEN 5000000 + (o_orderkey * 3) % 7001 WHEN o_orderkey % 50 = 5 THEN o_orderkey % 1500 END AS code, CASE WHEN o_orderkey % 15 = 0 THEN -1 ELSE c_nationkey END AS partition, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey % 10 ELSE o_orderkey % 10 END AS lot FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT *, row_number() OVER (ORDER BY batch, seq) AS ord FROM e),
rounds AS (SELECT 0 AS t, ord, id, name, code, CASE WHEN id IN (SELECT id FROM reg) OR name IN (SELECT name FROM reg) OR coalesce(code IN (SELECT code FROM reg WHERE code IS NOT NULL), false) THEN 2 ELSE 0 END AS st FROM n
  UNION ALL SELECT t + 1, ord, id, name, code, CASE WHEN st <> 0 THEN st WHEN {" OR ".join(f"({k} IS NOT NULL AND {k}_taken)" for k in _FOLD_KEYS)} THEN 2 WHEN {" AND ".join(f"({k} IS NULL OR {k}_first = ord)" for k in _FOLD_KEYS)} THEN 1 ELSE 0 END
  FROM (SELECT *, count(*) FILTER (st = 0) OVER () AS open, {", ".join(f"bool_or(st = 1) OVER (PARTITION BY {k}) AS {k}_taken, min(ord) FILTER (st = 0) OVER (PARTITION BY {k}) AS {k}_first" for k in _FOLD_KEYS)} FROM rounds) WHERE open > 0),
done AS (SELECT ord, st FROM rounds QUALIFY t = max(t) OVER ()),
known AS (SELECT 'r' || row_number() OVER () AS rec, 0 AS since, * FROM reg UNION ALL SELECT 'a' || ord, ord, n.id, n.name, n.code, partition, lot FROM n JOIN done USING (ord) WHERE st = 1),
pairs AS ({" UNION ".join(f"SELECT n.ord, k.rec FROM n JOIN done d ON n.ord = d.ord AND d.st = 2 JOIN known k ON n.{k} = k.{k} AND k.since < n.ord" for k in _FOLD_KEYS)}),
hits AS (SELECT ord, count(*) AS hits, min(rec) AS rec FROM pairs GROUP BY ord)
SELECT n.batch, n.seq, n.id, CASE WHEN st = 1 THEN 'added' WHEN hits > 1 OR k.partition <> n.partition OR k.name <> n.name THEN 'held_conflict' WHEN k.lot = n.lot THEN 'present' ELSE 'held_existing' END AS outcome, CASE WHEN hits = 1 THEN k.id END AS hit
FROM n JOIN done USING (ord) LEFT JOIN hits USING (ord) LEFT JOIN known k ON k.rec = hits.rec"""
