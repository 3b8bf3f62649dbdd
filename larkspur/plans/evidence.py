"""Evidence queries: identity joins, merges, diffs, constraints, set and array operations, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import keys
from larkspur.operators import containment, fields
from larkspur.plans.common import Tables, named, named_sql, spread
from larkspur.sources.scratch import new_path, tidy
from larkspur.streaming import upserts

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' END AS segment FROM supplier)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.nation, a.nation) AS nation, coalesce(b.segment, a.segment) AS segment, (a.k IS NOT NULL)::BIGINT + (b.k IS NOT NULL)::BIGINT AS feeds, ((a.nation <> b.nation) IS TRUE)::INTEGER + ((a.segment <> b.segment) IS TRUE)::INTEGER AS conflicts FROM a FULL JOIN b ON a.k = b.k""")
def merge_feeds(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").alias("segment"))
    return fields.merge_feeds([a, b], "k", ["nation", "segment"])


_PAIR = """WITH l AS (SELECT s_suppkey, s_suppkey % 90 AS code, s_nationkey * 100000 + floor(s_acctbal / 50)::BIGINT AS bucket FROM supplier), r AS (SELECT c_custkey, c_custkey + 20 AS code, c_nationkey * 100000 + floor(c_acctbal / 50)::BIGINT AS bucket FROM customer),
h AS (SELECT s_suppkey, c_custkey, CASE WHEN l.code = r.code AND l.bucket = r.bucket THEN 'bucket+code' WHEN l.code = r.code THEN 'code' ELSE 'bucket' END AS reasons FROM l JOIN r ON l.code = r.code OR l.bucket = r.bucket)"""


_KEYS = [("l_code", "r_code", "code"), ("l_bucket", "r_bucket", "bucket")]


def _pair_sides(t):
    bucket = lambda nation, balance: F.col(nation) * 100_000 + F.floor(F.col(balance) / 50)
    left = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 90).alias("l_code"), bucket("s_nationkey", "s_acctbal").alias("l_bucket"))
    right = t.customer.select("c_custkey", (F.col("c_custkey") + 20).alias("r_code"), bucket("c_nationkey", "c_acctbal").alias("r_bucket"))
    return left, right


@query(_PAIR + " SELECT * FROM h")
def identity_or_join(spark, sf_dir):
    return fields.any_key_matches(*_pair_sides(Tables(spark, sf_dir)), "s_suppkey", "c_custkey", _KEYS)


@query(_PAIR + " SELECT s_suppkey, count(c_custkey) AS matches, CASE count(c_custkey) WHEN 0 THEN 'new' WHEN 1 THEN 'matched' ELSE 'held' END AS class FROM supplier LEFT JOIN h USING (s_suppkey) GROUP BY 1")
def match_class(spark, sf_dir):
    """How many customers each supplier matches on any key, counted without the pairs."""
    return fields.match_counts(*_pair_sides(Tables(spark, sf_dir)), "s_suppkey", "c_custkey", _KEYS)


_N = named_sql("c_custkey", "c_name")


@query(f"""WITH v AS (SELECT DISTINCT c_custkey, unnest([trim(regexp_replace(replace(lower({_N}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(replace(lower(regexp_replace({_N}, '\\s*\\(india\\)', '', 'gi')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))]) AS variant FROM customer),
o AS (SELECT c_custkey AS other, trim(regexp_replace(lower(c_name || ' Limited'), '[^a-z0-9]+', ' ', 'g')) AS variant FROM customer), h AS (SELECT DISTINCT c_custkey, other FROM v JOIN o USING (variant))
SELECT c_custkey, other FROM h QUALIFY count(*) OVER (PARTITION BY c_custkey) = 1""")
def variant_join(spark, sf_dir):
    customer = Tables(spark, sf_dir).customer
    left = customer.select("c_custkey", F.explode(keys.name_variants(named("c_custkey", "c_name"))).alias("variant"))
    right = customer.select(F.col("c_custkey").alias("other"), keys.name_key(F.concat("c_name", F.lit(" Limited"))).alias("variant"))
    hits = left.join(right, "variant").select("c_custkey", "other").distinct()
    return hits.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("other")).where("n = 1").drop("n")


_ASKED = "CASE p_partkey % 5 WHEN 0 THEN full_name WHEN 1 THEN left(full_name, length(full_name) - 3) WHEN 2 THEN left(full_name, length(full_name) - 8) WHEN 3 THEN left(full_name, 11) ELSE full_name || ' xyz' END"


@query(f"""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' limited') AS full_name FROM part), k AS (SELECT full_name, count(*) AS n FROM p WHERE p_partkey % 3 > 0 GROUP BY 1), q AS (SELECT p_partkey, trim({_ASKED}) AS asked FROM p),
d AS (SELECT DISTINCT asked FROM q), e AS (SELECT asked, coalesce(n, 0) AS exact FROM d LEFT JOIN k ON full_name = asked),
f AS (SELECT asked, coalesce(sum(n), 0) AS prefix FROM d LEFT JOIN k ON full_name <> asked AND least(length(asked), length(full_name)) >= 12 AND (starts_with(full_name, asked) OR starts_with(asked, full_name))
  AND (length(trim(CASE WHEN length(asked) > length(full_name) THEN substr(asked, length(full_name) + 1) ELSE substr(full_name, length(asked) + 1) END)) <= 3
    OR trim(CASE WHEN length(asked) > length(full_name) THEN substr(asked, length(full_name) + 1) ELSE substr(full_name, length(asked) + 1) END) IN ('limited', 'limite', 'limit', 'limi')) GROUP BY 1)
SELECT p_partkey, CASE WHEN exact = 1 THEN 'exact' WHEN exact > 1 THEN 'ambiguous_exact' WHEN prefix = 1 THEN 'prefix' WHEN prefix > 1 THEN 'ambiguous_prefix' ELSE 'none' END AS class FROM q JOIN e USING (asked) JOIN f USING (asked)""")
def exact_then_prefix(spark, sf_dir):
    part = Tables(spark, sf_dir).part.select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type", F.lit("limited"))).alias("full_name"))
    name, k, size = F.col("full_name"), F.col("p_partkey") % 5, F.length("full_name")
    asked = F.when(k == 0, name).when(k == 1, F.left(name, size - 3)).when(k == 2, F.left(name, size - 8)).when(k == 3, F.left(name, F.lit(11))).otherwise(F.concat(name, F.lit(" xyz")))
    return fields.exact_then_prefix(part.select("p_partkey", F.trim(asked).alias("asked")), part.where("p_partkey % 3 > 0"), "asked", "full_name").select("p_partkey", "class")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' AND o_custkey IS NOT NULL)""")
def anti_progressed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    recent = t.orders.where("o_orderdate >= timestamp_ntz'2000-06-01 00:00:00'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(recent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT CASE WHEN c_custkey IS NULL THEN 'no_symbol' WHEN c_mktsegment <> 'BUILDING' THEN 'other_series' WHEN c_acctbal < 0 THEN 'negative' ELSE 'selected' END AS reason, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0 GROUP BY 1""")
def keyed_residual(spark, sf_dir):
    t = Tables(spark, sf_dir)
    joined = t.orders.select("o_custkey").join(t.customer.where("c_custkey % 7 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    reason = F.when(F.col("c_custkey").isNull(), "no_symbol").when(F.col("c_mktsegment") != "BUILDING", "other_series").when(F.col("c_acctbal") < 0, "negative").otherwise("selected")
    return joined.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH p AS (SELECT item_id, list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS ts FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS tok FROM documents),
t AS (SELECT item_id, len(ts) AS need, unnest(ts) AS tok FROM p) SELECT item_id, count(*) AS docs FROM (SELECT item_id, doc_id FROM t JOIN w USING (tok) GROUP BY item_id, doc_id, need HAVING count(*) = need) GROUP BY 1""")
def token_containment(spark, sf_dir):
    """Documents with every token of a passage: only those with its rarest token are looked at, by an equi-join, and then for the others.

    A common token multiplies nothing: a passage meets as many documents as have its rarest token. Runs jobs when called.
    """
    t = Tables(spark, sf_dir)
    passages = t.benchmark.select("item_id", containment.tokens_of(F.col("text")).alias("ts"))
    docs = spread(t.documents.select("doc_id", "text")).select("doc_id", containment.tokens_of(F.col("text")).alias("has"))
    return containment.contained(passages, docs).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


@query("""WITH reg AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice) END AS total FROM orders WHERE o_orderkey % 3 <> 0), inc AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN round(o_totalprice) + 1 ELSE round(o_totalprice) END AS total FROM orders WHERE o_orderkey % 2 = 0)
SELECT CASE WHEN reg.o_orderkey IS NULL THEN 'added' WHEN reg.total IS NULL THEN 'enriched' WHEN reg.total = inc.total THEN 'held' ELSE 'conflict' END AS outcome, count(*) AS n FROM inc LEFT JOIN reg USING (o_orderkey) GROUP BY 1""")
def upsert_hold(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = Tables(spark, sf_dir).orders
    registry = orders.where(k % 3 != 0).select(k.alias("known"), F.when(k % 5 != 0, F.round("o_totalprice")).alias("old"))
    batch = orders.where(k % 2 == 0).select(k.alias("key"), F.when(k % 7 == 0, F.round("o_totalprice") + 1).otherwise(F.round("o_totalprice")).alias("new"))
    outcome = F.when(F.col("known").isNull(), "added").when(F.col("old").isNull(), "enriched").when(F.col("old") == F.col("new"), "held").otherwise("conflict")
    return batch.join(registry, F.col("key") == F.col("known"), "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH al AS (SELECT s_suppkey AS alias_of, (s_suppkey + 1) % 100 AS target FROM supplier WHERE s_suppkey % 10 = 3) SELECT s.s_suppkey, coalesce(al.target, e.s_suppkey) AS matched, CASE WHEN al.target IS NOT NULL THEN 'alias' WHEN e.s_suppkey IS NOT NULL THEN 'exact' ELSE 'none' END AS via
FROM supplier s LEFT JOIN al ON al.alias_of = s.s_suppkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) e ON e.s_suppkey = s.s_suppkey""")
def alias_join(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    aliases = s.where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("alias_of"), ((F.col("s_suppkey") + 1) % 100).alias("target"))
    exact = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("same"))
    joined = s.join(aliases, F.col("s_suppkey") == F.col("alias_of"), "left").join(exact, F.col("s_suppkey") == F.col("same"), "left")
    via = F.when(F.col("target").isNotNull(), "alias").when(F.col("same").isNotNull(), "exact").otherwise("none")
    return joined.select("s_suppkey", F.coalesce("target", "same").alias("matched"), via.alias("via"))


@query("""SELECT CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN a.st = b.st THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM (SELECT o_orderkey, o_orderstatus AS st FROM orders WHERE o_orderkey % 4 <> 0) b
FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 5 <> 0) a ON a.o_orderkey = b.o_orderkey GROUP BY 1""")
def full_outer_diff(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.col("o_orderstatus").alias("st"))
    before, after = o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 5 <> 0").withColumn("st", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("st")))
    return fields.diff(before, after, "o_orderkey", ["st"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


_THREE = "SELECT o_orderkey, o_orderstatus AS b, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'Y' WHEN o_orderkey % 18 = 0 THEN 'X' ELSE o_orderstatus END AS c FROM orders"


@query(f"""WITH t AS ({_THREE}), o AS (SELECT *, CASE WHEN b = a THEN 'unchanged' WHEN c = a THEN 'already' WHEN c = b THEN 'applied' ELSE 'conflict' END AS outcome FROM t) SELECT outcome, CASE WHEN outcome = 'applied' THEN a ELSE c END AS merged, count(*) AS n FROM o GROUP BY ALL""")
def three_way_merge(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    after = F.when(k % 6 == 0, "X").otherwise(status)
    current = F.when(k % 4 == 0, "Y").when(k % 18 == 0, "X").otherwise(status)
    merged, outcome = fields.three_way(current, status, after)
    return Tables(spark, sf_dir).orders.groupBy(outcome.alias("outcome"), merged.alias("merged")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT o_orderkey % 9973 AS id, year(o_orderdate) AS y FROM orders), c AS (SELECT id, count(DISTINCT y) AS ys FROM s GROUP BY 1) SELECT CASE WHEN ys > 1 THEN 'rolled_back' ELSE 'kept' END AS outcome, count(*) AS ids FROM c GROUP BY 1""")
def identity_atomicity(spark, sf_dir):
    ids = Tables(spark, sf_dir).orders.groupBy((F.col("o_orderkey") % 9973).alias("id")).agg(F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high"))
    return ids.groupBy(F.when(F.col("low") != F.col("high"), "rolled_back").otherwise("kept").alias("outcome")).agg(F.count(F.lit(1)).alias("ids"))


@query("""SELECT user_id, event_type, max_by(event_id, (ts, value, event_id)) AS event_id, count(*) AS attempts FROM events GROUP BY ALL""")
def upsert_latest(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "value", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("attempts"))


@query("""WITH p AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), i AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 10 <> 0 GROUP BY 1)
SELECT coalesce(i.user_id, p.user_id) AS user_id, coalesce(i.n, p.n) AS n, i.user_id IS NULL AS not_seen FROM p FULL JOIN i ON p.user_id = i.user_id""")
def snapshot_merge(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    cut = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    old = events.where(F.col("ts") < cut).groupBy("user_id").agg(F.count(F.lit(1)).alias("old")).withColumnRenamed("user_id", "old_id")
    new = events.where((F.col("ts") >= cut) & (F.col("user_id") % 10 != 0)).groupBy("user_id").agg(F.count(F.lit(1)).alias("new"))
    joined = old.join(new, F.col("old_id") == F.col("user_id"), "full")
    return joined.select(F.coalesce("user_id", "old_id").alias("user_id"), F.coalesce("new", "old").alias("n"), F.col("user_id").isNull().alias("not_seen"))


@query("""SELECT p_brand, max_by(p_name, (length(p_name), p_name)) AS longest, min_by(p_type, p_partkey) FILTER (p_size > 25) AS first_type, count(DISTINCT p_type) AS types FROM part GROUP BY 1""")
def coalesce_by_key(spark, sf_dir):
    first = F.min_by("p_type", F.when(F.col("p_size") > 25, F.col("p_partkey")))
    return Tables(spark, sf_dir).part.groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("longest"), first.alias("first_type"), F.count_distinct("p_type").alias("types"))


@query("""WITH e AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS t FROM orders), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS t FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CASE WHEN s.o_orderkey IS NULL THEN 'absent' WHEN e.o_orderstatus <> s.o_orderstatus AND s.t IS NULL THEN 'status+total' WHEN e.o_orderstatus <> s.o_orderstatus THEN 'status' WHEN s.t IS NULL THEN 'total' ELSE 'ok' END AS errors, count(*) AS n FROM e LEFT JOIN s USING (o_orderkey) GROUP BY 1""")
def served_diff(spark, sf_dir):
    k = F.col("o_orderkey")
    expected = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("t"))
    served = expected.where(k % 11 != 0).select(k.alias("sk"), F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("ss"), F.when(k % 17 != 0, F.col("t")).alias("st"))
    codes = F.array_join(F.array_compact(F.array(F.when(~F.col("o_orderstatus").eqNullSafe(F.col("ss")), "status"), F.when(~F.col("t").eqNullSafe(F.col("st")), "total"))), "+")
    errors = F.when(F.col("sk").isNull(), "absent").when(codes == "", "ok").otherwise(codes)
    return expected.join(served, k == F.col("sk"), "left").groupBy(errors.alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT lower(c_name) AS name, 1 AS src, c_custkey AS pos FROM customer UNION ALL SELECT replace(lower(s_name), 'supplier', 'customer'), 2, s_suppkey FROM supplier) SELECT min_by(src, (src, pos))::INTEGER AS src, min_by(pos, (src, pos)) AS pos, name FROM u GROUP BY name""")
def union_dedup(spark, sf_dir):
    """Keep-first over two sources by name, as a grouped minimum of (source, place)."""
    t = Tables(spark, sf_dir)
    a = t.customer.select(F.lower("c_name").alias("name"), F.lit(1).alias("src"), F.col("c_custkey").alias("pos"))
    b = t.supplier.select(F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("name"), F.lit(2).alias("src"), F.col("s_suppkey").alias("pos"))
    return a.unionByName(b).groupBy("name").agg(F.min(F.struct("src", "pos")).alias("first")).select("first.src", "first.pos", "name")


@query("""WITH s AS (SELECT o_custkey, list_distinct(list(o_orderstatus) FILTER (o_orderkey % 2 = 0)) AS a, list_distinct(list(o_orderstatus) FILTER (o_orderkey % 2 = 1)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::INTEGER AS either, len(list_intersect(coalesce(a, []), coalesce(b, [])))::INTEGER AS both, coalesce(len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), 0) > 0 AS removed FROM s""")
def array_ops(spark, sf_dir):
    k = F.col("o_orderkey")
    sets = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.collect_set(F.when(k % 2 == 0, F.col("o_orderstatus"))).alias("a"), F.collect_set(F.when(k % 2 == 1, F.col("o_orderstatus"))).alias("b"))
    return sets.select("o_custkey", F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_intersect("a", "b")).alias("both"), (F.size(F.array_except("a", "b")) > 0).alias("removed"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_ops(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = t.customer.where("c_acctbal > 9000").select("c_nationkey"), t.supplier.where("s_acctbal > 5000").select("s_nationkey")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT unnest(['positive_quantity', 'discount_in_range', 'ships_after_order', 'has_part']) AS rule, unnest([count(*) FILTER (NOT l_quantity > 0), count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05), count(*) FILTER (NOT coalesce(l_shipdate >= o_orderdate, false)), count(*) FILTER (l_partkey IS NULL)]) AS violations, count(*) AS checked FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def constraint_violations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return fields.violations(rows, {"positive_quantity": F.col("l_quantity") > 0, "discount_in_range": F.col("l_discount").between(0, 0.05), "ships_after_order": F.col("l_shipdate") >= F.col("o_orderdate"), "has_part": F.col("l_partkey").isNotNull()})


@query("""SELECT o_orderkey, greatest(o_orderdate, max(l_shipdate)) AS clock, coalesce(max(l_shipdate) > o_orderdate, false) AS lifted FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def clock_guard(spark, sf_dir):
    t = Tables(spark, sf_dir)
    latest = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("child"))
    return t.orders.join(latest, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.greatest("o_orderdate", "child").alias("clock"), F.coalesce(F.col("child") > F.col("o_orderdate"), F.lit(False)).alias("lifted"))


@query("""WITH g AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'corrected' WHEN o_orderstatus = 'F' THEN 'already' ELSE 'refused' END AS outcome, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS value FROM orders) SELECT outcome, value, count(*) AS n FROM g GROUP BY ALL""")
def guarded_correction(spark, sf_dir):
    value, outcome = fields.guarded(F.col("o_orderstatus"), F.lit("P"), F.lit("F"))
    return Tables(spark, sf_dir).orders.groupBy(outcome.alias("outcome"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem GROUP BY 1), t AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'P' THEN 'A' ELSE 'N' END END AS cur, flag AS new FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT CASE WHEN new IS NULL THEN 'no_value' WHEN cur IS NULL THEN 'filled' WHEN cur = new THEN 'corroborated' ELSE 'conflict' END AS outcome, coalesce(cur, new) AS value, count(*) AS n FROM t GROUP BY ALL""")
def fill_or_conflict(spark, sf_dir):
    t = Tables(spark, sf_dir)
    flags = t.lineitem.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"))
    status = F.col("o_orderstatus")
    current = F.when(F.col("o_orderkey") % 4 != 0, F.when(status == "F", "R").when(status == "P", "A").otherwise("N"))
    value, outcome = fields.fill_or_conflict(current, F.col("flag"))
    return t.orders.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(outcome.alias("outcome"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) FILTER (l_linestatus = 'F' AND l_linenumber = 1) = 1 THEN min(l_returnflag) FILTER (l_linestatus = 'F' AND l_linenumber = 1) END AS value,
CASE count(DISTINCT l_returnflag) FILTER (l_linestatus = 'F' AND l_linenumber = 1) WHEN 1 THEN 'agreed' WHEN 0 THEN 'absent' ELSE 'conflict' END AS reason FROM lineitem GROUP BY 1""")
def consensus(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select("l_partkey", F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), F.col("l_returnflag")).alias("seen"))
    return fields.consensus(rows, ["l_partkey"], "seen")


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1""")
@tidy
def stream_upsert(spark, sf_dir):
    """The events as a stream of files into a keyed table of the latest event a user; the table after all that is there. Runs the stream when called."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    return upserts.latest_table(events, ["user_id"], ["ts", "event_id"], new_path(spark, "upsert")).select("user_id", "event_id", "ts")
