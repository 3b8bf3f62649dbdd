"""Queries from candidates to a release."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import labels, terms
from larkspur.operators import release
from larkspur.plans.common import Tables, spread
from larkspur.plans.forms import text

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query("""WITH r AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 OR o_orderstatus = 'F' THEN 'verified' WHEN o_orderstatus = 'O' THEN 'rejected' ELSE 'unavailable' END AS status FROM orders), c AS (SELECT o_custkey, count(*) AS attempted, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'unavailable') AS unavailable FROM r GROUP BY 1)
SELECT *, CASE WHEN verified = attempted THEN 'complete' WHEN verified > 0 THEN 'partial' ELSE 'failed' END AS status FROM c""")
def verification_batches(spark, sf_dir):
    """Batches of verified candidates with their counts and status."""
    status = F.when((F.col("o_custkey") % 3 == 0) | (F.col("o_orderstatus") == "F"), "verified").when(F.col("o_orderstatus") == "O", "rejected").otherwise("unavailable")
    return release.batch_summary(Tables(spark, sf_dir).orders.select("o_custkey", status.alias("status")), ["o_custkey"])


@query("""WITH a AS (SELECT user_id AS key, event_id % 7 AS route, min(CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'verified' END) AS good, min(event_type) FILTER (NOT (event_type = 'purchase' AND event_id % 3 = 0)) AS other, min(event_id) FILTER (event_type = 'purchase' AND event_id % 3 = 0) AS g_id FROM events GROUP BY ALL),
o AS (SELECT user_id AS key, event_id % 7 AS route, min((event_type, event_id)) AS m FROM events WHERE NOT (event_type = 'purchase' AND event_id % 3 = 0) GROUP BY ALL),
p AS (SELECT key, route, coalesce(good, other) AS status, coalesce(g_id, m[2]) AS result, good IS NOT NULL AS is_good FROM a LEFT JOIN o USING (key, route)), u AS (SELECT *, min(route) FILTER (is_good) OVER (PARTITION BY key) AS until, max(route) OVER (PARTITION BY key) AS last FROM p)
SELECT key, route, status, result, (SELECT count(*) FROM p WHERE p.key = u.key AND (u.until IS NULL OR p.route <= u.until)) AS tried FROM u WHERE route = coalesce(until, last)""".replace("m[2]", "struct_extract_at(m, 2)"))
def attempts_by_route(spark, sf_dir):
    """Attempts by routes in order: the first verified one stands, else the last."""
    k = F.col("event_id")
    good = (F.col("event_type") == "purchase") & (k % 3 == 0)
    rows = Tables(spark, sf_dir).events.select(F.col("user_id").alias("key"), (k % 7).alias("route"), F.when(good, "verified").otherwise(F.col("event_type")).alias("status"), k.alias("result"))
    return release.by_route(rows, "key")


@query("""WITH q AS (SELECT c_custkey AS code, c_custkey % 700 AS name FROM customer WHERE c_custkey % 29 <> 0), p AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 17 = 0 THEN 'odd' WHEN c_custkey % 2 = 0 THEN 'published' ELSE 'awaiting' END AS d, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 19 = 0 THEN 's' || c_custkey END AS sid, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey % 23 END AS approval, CASE WHEN c_custkey % 31 = 0 THEN 2 ELSE 1 END AS n FROM customer WHERE c_custkey % 37 <> 0),
r AS (SELECT 's' || c_custkey AS sid, CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE c_custkey % 700 END AS name, c_custkey AS code, 'h' || c_custkey % 23 + (c_custkey % 11 = 0)::INT AS hash FROM customer WHERE c_custkey % 4 = 0),
j AS (SELECT coalesce(q.code, p.code) AS code, q.code IS NULL AS nq, p.code IS NULL AS np, coalesce(p.n, 1) AS n, d, p.sid, approval, q.name, r.sid AS rsid, r.name AS rname, r.hash, q.name IN (SELECT name FROM r) AS by_name, coalesce(q.code, p.code) IN (SELECT code FROM r) AS by_code FROM q FULL JOIN p ON q.code = p.code LEFT JOIN r ON r.sid = p.sid)
SELECT code, d AS state, concat_ws('+', CASE WHEN nq THEN 'not_in_queue' END, CASE WHEN np THEN 'not_in_progress' END, CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN d = 'odd' THEN 'unknown_disposition' END, CASE WHEN d = 'awaiting' AND (sid IS NOT NULL OR approval IS NOT NULL) THEN 'awaiting_has_release_fields' END,
CASE WHEN d = 'published' AND rsid IS NULL THEN 'not_released' END, CASE WHEN d = 'published' AND rsid IS NOT NULL AND rname IS DISTINCT FROM name THEN 'released_under_other_name' END, CASE WHEN d = 'published' AND rsid IS NOT NULL AND hash IS DISTINCT FROM approval THEN 'approval_mismatch' END, CASE WHEN d = 'awaiting' AND (coalesce(by_name, false) OR by_code) THEN 'possibly_released' END) AS faults FROM j""".replace("c_custkey % 23 + (c_custkey % 11 = 0)::INT", "(c_custkey % 23 + (c_custkey % 11 = 0)::INT)"))
def progress_ledger(spark, sf_dir):
    """A queue against its progress and what is released: what does not hold together. All customers are taken; each side leaves out others by key, so that every fault occurs."""
    c = F.col("c_custkey")
    t = Tables(spark, sf_dir).customer
    queue = t.where(c % 29 != 0).select(c.alias("code"), (c % 700).alias("name_key"))
    disposition = F.when(c % 17 == 0, "odd").when(c % 2 == 0, "published").otherwise("awaiting")
    progress = t.where(c % 37 != 0).select(c.alias("code"), disposition.alias("disposition"), F.when((c % 2 == 0) | (c % 19 == 0), text("s", c)).alias("stable_id"), F.when(c % 2 == 0, text("h", c % 23)).alias("approval"))
    progress = progress.unionByName(progress.where("code % 31 = 0"))
    released = t.where(c % 4 == 0).select(text("s", c).alias("stable_id"), F.when(c % 13 == 0, -1).otherwise(c % 700).alias("name_key"), c.alias("code"), text("h", c % 23 + (c % 11 == 0).cast("int")).alias("hash"))
    return release.ledger(queue, progress, released).select("code", "state", F.array_join("faults", "+").alias("faults"))


@query("""WITH o AS (SELECT o_orderkey AS id, year(o_orderdate)::INT AS y, o_orderstatus AS s, o_orderkey % 6 AS f FROM orders)
SELECT id, CASE WHEN f IN (0, 1) THEN y + 1 ELSE y END::INTEGER AS partition, CASE WHEN f = 0 THEN 'X' ELSE s END AS status, CASE f WHEN 0 THEN 'partition:' || y || '>' || (y + 1) || CASE WHEN s <> 'X' THEN ',status:' || s || '>X' ELSE '' END WHEN 1 THEN 'partition:' || y || '>' || (y + 1) ELSE '' END AS history,
CASE f WHEN 0 THEN 'applied' WHEN 1 THEN 'applied' WHEN 2 THEN 'refused' WHEN 3 THEN 'already' WHEN 4 THEN 'refused' ELSE 'untouched' END AS outcome FROM o UNION ALL SELECT -1, NULL, NULL, NULL, 'unknown'""")
def moves_with_history(spark, sf_dir):
    """Records moved to another year and corrected on the way, with what they were before kept."""
    k, y, s = F.col("o_orderkey"), F.year("o_orderdate"), F.col("o_orderstatus")
    t = Tables(spark, sf_dir).orders
    none = F.expr("cast(array() as array<struct<field: string, before: string, after: string, at: string>>)")
    registry = t.select(k.alias("id"), y.alias("partition"), s.alias("status"), none.alias("history"))
    move = lambda expected, target, status: F.struct(expected.alias("expected"), target.alias("target"), status.cast("string").alias("status"), F.lit("2026-01-01").alias("at"))
    null = F.lit(None)
    asked = (
        F.when(k % 6 == 0, F.array(move(y, y + 1, F.lit("X"))))
        .when(k % 6 == 1, F.array(move(y, y + 1, null)))
        .when(k % 6 == 2, F.array(move(y - 1, y + 1, null)))
        .when(k % 6 == 3, F.array(move(y - 1, y, s)))
        .when(k % 6 == 4, F.array(move(y, y + 1, null), move(y, y + 2, null)))
    )
    moves = t.select(k.alias("id"), F.explode(asked).alias("m")).select("id", "m.*")
    lost = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(2000).alias("expected"), F.lit(2001).alias("target"), F.lit("x").alias("status"), F.lit("2026-01-01").alias("at"))
    found = release.moved(registry, moves.unionByName(lost), ["status"])
    shown = F.array_join(F.transform("history", lambda h: F.concat(h["field"], F.lit(":"), h["before"], F.lit(">"), h["after"])), ",")
    return found.select("id", "partition", "status", shown.alias("history"), "outcome")


@query("""WITH m AS (SELECT c_nationkey AS release, c_custkey // (CASE WHEN c_custkey % 40 < 2 THEN 80 ELSE 1 END) AS name, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN 'same' ELSE 'body ' || c_custkey END AS content FROM customer),
a AS (SELECT release, count(*) AS n FROM m GROUP BY 1), g AS (SELECT release, name, count(*) AS times, min(sha256(content)) AS hash FROM m GROUP BY ALL), h AS (SELECT *, count(*) OVER (PARTITION BY release, hash) AS alike FROM g)
SELECT release, name, hash, CASE WHEN n > 15 THEN 'too_many' WHEN times > 1 THEN 'repeated' WHEN hash IS NULL THEN 'empty' WHEN alike > 1 THEN 'same_content' END AS reason FROM h JOIN a USING (release)""")
def release_selection(spark, sf_dir):
    """Manifests of a release with their hashes; too many, repeated, empty or equal ones cannot be released."""
    c = F.col("c_custkey")
    name = F.floor(c / F.when(c % 40 < 2, 80).otherwise(1))
    content = F.when(c % 9 == 0, F.lit(None)).when(c % 8 == 1, "same").otherwise(text("body ", c))
    return release.selection(Tables(spark, sf_dir).customer.select(F.col("c_nationkey").alias("release"), name.alias("name"), content.alias("content")))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 10 AS f FROM customer)
SELECT id, CASE WHEN f IN (0, 1, 3) THEN DATE '2024-03-04' END AS open, CASE WHEN f IN (0, 1, 3) THEN DATE '2024-03-06' END AS close, CASE WHEN f IN (5, 6, 9) THEN 'missing_or_competing' WHEN f IN (7, 8) THEN 'unrecognized' WHEN f IN (2, 4) THEN 'inconsistent' END AS period_reason,
CASE WHEN f IN (0, 4, 5) THEN 90::DOUBLE WHEN f = 1 THEN 95 END AS band_min, CASE WHEN f = 2 THEN 'competing_price_bands' WHEN f = 3 THEN 'duplicate' WHEN f IN (6, 7, 8, 9) THEN 'term_absent' END AS band_reason FROM c""")
def stated_periods(spark, sf_dir):
    """Offer periods and bands, ordinary or revised, that must not contradict themselves or each other."""
    k = F.col("c_custkey")
    item = lambda title, value: F.struct(F.lit(title).alias("title"), F.lit(value).alias("value"))
    days, band = "04-Mar-2024 to 06-Mar-2024", item("Price Band", "Rs 90 to Rs 100 per share")
    revised = lambda low: item("Revised Price Range", f"Rs {low} to Rs 100 per share")
    forms = [
        [item("Issue Period", days), band],
        [item("Issue period:", days + " (The Issue is further extended to 06-Mar-2024)"), revised(95)],
        [item("Issue Period", days + " (The Issue is further extended to 07-Mar-2024)"), revised(95), band],
        [item("Revised/Extended Issue Period", days + " (The Issue is further extended from start date 04/03/2024 to end date 06/03/2024)"), revised(95), revised(96)],
        [item("Revised/Extended Issue Period", days + " (The Issue is further extended from start date 04/03/2024 to end date 07/03/2024)"), band],
        [item("Issue Period", days), item("Revised/Extended Issue Period", days), band],
        [item("Period", days)],
        [item("Issue Period", "04-Mar-2024 until 06-Mar-2024")],
        [item("Issue Period", "30-Feb-2024 to 06-Mar-2024")],
        [item("Issue Period", days), item("Issue Period", days)],
    ]
    items = F.when(k % len(forms) == 0, F.array(*forms[0]))
    for i, form in enumerate(forms[1:], 1):
        items = items.when(k % len(forms) == i, F.array(*form))
    made = spread(Tables(spark, sf_dir).customer.select("c_custkey")).select(k.alias("id"), items.alias("i")).select("id", terms.stated_period(F.col("i")).alias("p"), terms.revised_band(F.col("i")).alias("b"))
    return made.select("id", "p.open", "p.close", F.col("p.reason").alias("period_reason"), F.col("b.value.min").alias("band_min"), F.col("b.reason").alias("band_reason"))


@query("""SELECT o_orderkey AS id, o_orderkey % 5 IN (0, 1) AS opens, o_orderkey % 5 IN (0, 1) AND NOT (o_orderkey % 5 = 1 AND o_orderkey % 2 = 0) AS closes FROM orders""")
def stored_extractions(spark, sf_dir):
    """Stored days against the present rules on their source texts."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    # the rules know the days of this century only
    day = F.add_months(day, 12 * 20)
    written = F.date_format(day, "MMMM d, yyyy")
    forms = lambda label: F.when(k % 5 == 0, text(label, ": ", written)).when(k % 5 == 1, text("the ", label, " being ", written)).when(k % 5 == 2, text(label, ". ", written)).when(k % 5 == 3, text(label, " ", F.date_format(F.date_add(day, 1), "MMMM d, yyyy"))).otherwise(text("Anchor investor ", label, " ", written))
    listed = F.when(k % 2 == 0, F.date_add(day, F.when(k % 5 == 1, -1).otherwise(1)))
    return Tables(spark, sf_dir).orders.select(k.alias("id"), labels.still_extracts(forms("Offer opening date"), "open", day).alias("opens"), labels.still_extracts(forms("Offer closing date"), "close", day, listed).alias("closes"))
