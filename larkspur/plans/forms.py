"""Queries over forms of documents: schemas, tables, labels, columns; sources of observations, retained attempts, changed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import labels, layout, notices, tables
from larkspur.operators import documents, retained, reviewed, schemas
from larkspur.plans.common import Tables, spread
from larkspur.sources import adapters, manifests, reports
from larkspur.sources.scratch import materialize, new_path, tidy
from larkspur.streaming import attempts

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def text(*parts) -> Column:
    """Parts as one text: columns, and texts as they are."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


EVENT = {
    "$defs": {"day": {"type": ["string", "null"], "format": "date"}},
    "type": "object",
    "required": ["id", "at"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "type": {"enum": ["click", "view", "purchase"]},
        "at": {"$ref": "#/$defs/day"},
        "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "exclusiveMinimum": 10, "maximum": 89}}},
        "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 2}},
    },
}


@query("""WITH e AS (SELECT event_id AS id, event_type, (props::JSON ->> 'k')::INT AS n FROM events)
SELECT id, '$.at' AS path, 'format date' AS rule FROM e WHERE id % 11 = 0 UNION ALL SELECT id, '$.at', 'required' FROM e WHERE id % 13 = 0 AND id % 11 <> 0
UNION ALL SELECT id, '$.id', 'type integer' FROM e WHERE id % 17 = 0 UNION ALL SELECT id, '$.type', 'must be one of ["click","view","purchase"]' FROM e WHERE event_type NOT IN ('click', 'view', 'purchase')
UNION ALL SELECT id, '$.props.k', 'exclusiveMinimum 10' FROM e WHERE n <= 10 UNION ALL SELECT id, '$.props.k', 'maximum 89' FROM e WHERE n > 89
UNION ALL SELECT id, '$.tags', 'minItems 1' FROM e WHERE id % 6 = 0 UNION ALL SELECT id, '$.tags[1]', 'minLength 2' FROM e WHERE id % 6 = 1 UNION ALL SELECT id, '$.tags[0]', 'type string' FROM e WHERE id % 6 = 2
UNION ALL SELECT id, '$.extra', 'not allowed' FROM e WHERE id % 19 = 0""")
def schema_violations(spark, sf_dir):
    """The events as documents, and what in each breaks their schema."""
    k = F.col("event_id")
    at = F.when(k % 11 == 0, '"at":"2024-02-30"').when(k % 13 == 0, F.lit(None)).when(k % 7 == 0, '"at":null').otherwise(text('"at":"', F.date_format("ts", "yyyy-MM-dd"), '"'))
    tags = F.when(k % 6 == 0, '"tags":[]').when(k % 6 == 1, '"tags":["ok","x"]').when(k % 6 == 2, '"tags":[3,"éé"]')
    members = F.concat_ws(",", text('"id":', F.when(k % 17 == 0, text('"', k, '"')).otherwise(k.cast("string"))), text('"type":"', F.col("event_type"), '"'), text('"props":', F.col("props")), at, tags, F.when(k % 19 == 0, '"extra":{}'))
    return schemas.violations(spread(Tables(spark, sf_dir).events).select(k.alias("id"), text("{", members, "}").alias("document")), EVENT)


TURN = {"type": "object", "required": ["role", "text"], "properties": {"role": {"enum": ["user", "assistant"]}, "turn": {"maximum": 3}, "text": {"anyOf": [{"type": "string", "minLength": 60, "pattern": "^[A-Z]"}, {"const": "ok"}]}}}


@query("""SELECT conv_id * 1000 + turn AS id, '$.role' AS path, 'must be one of ["user","assistant"]' AS rule FROM conversations WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id * 1000 + turn, '$.turn', 'maximum 3' FROM conversations WHERE turn > 3
UNION ALL SELECT conv_id * 1000 + turn, '$.text', 'does not match an allowed form' FROM conversations WHERE text IS NULL OR (text <> 'ok' AND (length(text) < 60 OR NOT regexp_matches(text, '^[A-Z]')))
UNION ALL SELECT conv_id * 1000 + turn, '$.role', 'must be one of ["user","assistant"]' FROM conversations WHERE role IS NULL""")
def schema_turns(spark, sf_dir):
    """The turns of conversations against a schema of alternatives; lengths count code points."""
    document = F.to_json(F.struct("role", "turn", "text"), {"ignoreNullFields": "false"})
    return schemas.violations(spread(Tables(spark, sf_dir).conversations).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), document.alias("document")), TURN)


def order_pages(t: Tables) -> DataFrame:
    """(id, html): a page for each twenty consecutive orders, in two layouts, and one with spans for each customer (below zero); tags in any case, some left open."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    row = (
        F.when(k % 7 == 0, text("<tr><td>total<td>", k))
        .when(k % 2 == 0, text("<tr><td>", k + 600000, "</td><td><b>Order&nbsp;", k, "</b> &amp; Co</td><td>INE", F.lpad(k.cast("string"), 9, "0"), "</td><td>", F.col("o_orderstatus"), " <a class=x href=\"/d?id=", k, "&amp;t=1\">view</a><a href='/e'>e</a></td></tr>"))
        .otherwise(text("<!-- <tr><td>no</td></tr> --><TR class='r'><TD>Order ", k, " Ltd</TD><td align=right> ", k + 600000, " </td><Td>", F.col("o_orderpriority"), "</tD></TR>"))
    )
    # twenty keys are a page
    rows = spread(t.orders.select(k, "o_orderstatus", "o_orderpriority", F.floor(k / 20).alias("id")), "id").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    listed = rows.select("id", text("<html><script>var t='<table><tr><td>';</script><p>Orders</p><table border=1><tbody>", F.col("rows"), "</tbody></table></html>").alias("html"))
    spans = text("<p><TABLE><tr><th>Name</th><th colspan=\"2\">Where</th></tr><tr><td rowspan=2>", F.col("c_name"), "</td><td>", F.col("c_mktsegment"), "</td><td>a</td></tr><tr><td>", F.col("c_nationkey"), "</td></tr></TABLE>")
    return listed.unionByName(spread(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")).select((-1 - c).alias("id"), spans.alias("html")))


_PAGE_ROWS = """o AS (SELECT o_orderkey // 20 AS id, row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) - 1 AS row_no, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
cells AS (SELECT id, row_no, unnest([{'col': 0, 'text': CASE WHEN k % 7 = 0 THEN 'total' WHEN k % 2 = 0 THEN (k + 600000)::VARCHAR ELSE 'Order ' || k || ' Ltd' END, 'link': NULL},
  {'col': 1, 'text': CASE WHEN k % 7 = 0 THEN k::VARCHAR WHEN k % 2 = 0 THEN 'Order ' || k || ' & Co' ELSE (k + 600000)::VARCHAR END, 'link': NULL},
  {'col': 2, 'text': CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN 'INE' || lpad(k::VARCHAR, 9, '0') ELSE p END, 'link': NULL}, {'col': 3, 'text': CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN s || ' view e' END, 'link': '/d?id=' || k || '&t=1'}]) AS c FROM o
  UNION ALL SELECT -1 - c_custkey, r, unnest([{'col': 0, 'text': CASE r WHEN 0 THEN 'Name' ELSE c_name END, 'link': NULL}, {'col': 1, 'text': ['Where', c_mktsegment, c_nationkey::VARCHAR][r + 1], 'link': NULL}, {'col': 2, 'text': ['Where', 'a', NULL][r + 1], 'link': NULL}]) FROM customer, range(3) AS x(r))"""


@query(f"WITH {_PAGE_ROWS} SELECT id, 0 AS table_no, row_no::INTEGER AS row_no, c.col::INTEGER AS col, c.text AS text, c.link AS link FROM cells WHERE c.text IS NOT NULL")
def page_tables(spark, sf_dir):
    """Every cell of every table of the pages in its row and column, with its first link."""
    rows = tables.table_rows(order_pages(Tables(spark, sf_dir)))
    return rows.select("id", "table_no", "row_no", F.posexplode("cells").alias("col", "cell")).select("id", "table_no", "row_no", "col", "cell.text", F.get("cell.links", F.lit(0)).alias("link"))


LAYOUTS = [("index_watch", {0: r"^\d{6}$", 2: "^INE[A-Z0-9]{9}$"}, {"code": 0, "company": 1, "isin": 2}), ("services", {0: ".", 1: r"^\d{6}$"}, {"company": 0, "code": 1, "sector": 2})]


@query(f"""WITH {_PAGE_ROWS}, w AS (SELECT id, row_no, max(c.text) FILTER (c.col = 0) AS a, max(c.text) FILTER (c.col = 1) AS b, max(c.text) FILTER (c.col = 2) AS d FROM cells GROUP BY ALL),
l AS (SELECT id, row_no, a, b, d, CASE WHEN regexp_matches(a, '^[0-9]{{6}}$') AND regexp_matches(d, '^INE[A-Z0-9]{{9}}$') THEN 'index_watch' WHEN regexp_matches(a, '.') AND regexp_matches(b, '^[0-9]{{6}}$') THEN 'services' END AS layout FROM w)
SELECT id, CASE layout WHEN 'index_watch' THEN a ELSE b END AS code, layout, nullif(CASE layout WHEN 'index_watch' THEN b ELSE a END, '') AS company, CASE layout WHEN 'index_watch' THEN d END AS isin, CASE layout WHEN 'services' THEN nullif(d, '') END AS sector FROM l WHERE layout IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id, code ORDER BY row_no DESC) = 1""")
def table_layouts(spark, sf_dir):
    """Rows of two layouts read into one form; rows that fit none are left out."""
    return tables.by_layout(tables.table_rows(order_pages(Tables(spark, sf_dir))), LAYOUTS, "code").drop("table_no", "row_no")


@query("""SELECT -1 - c_custkey AS id, r::INTEGER AS row_no, unnest(['Name', 'Where', 'Where'][:CASE r WHEN 2 THEN 2 ELSE 3 END]) AS name, unnest([c_name, [c_mktsegment, c_nationkey::VARCHAR][r], 'a'][:CASE r WHEN 2 THEN 2 ELSE 3 END]) AS text FROM customer, range(1, 3) AS x(r)""")
def table_records(spark, sf_dir):
    """Cells under the names of their columns, in tables whose first row names them."""
    return tables.records(order_pages(Tables(spark, sf_dir))).select("id", "row_no", "name", "text")


#: What stands before a document's text, by its id; {m} is the day as 'March 4, 2024', {d} as '4 March 2024', {s} as '4th Mar, 2024'.
OPENINGS = [
    "Bid/Issue Opening Date: Monday, {m}. ",
    "The issue opens on - i.e. {d} and more. ",
    "Offer Opening Date. The {m} is no date of it. ",
    "Anchor Investor Bid/Issue opening date {m}. ",
    "The offer opened on {d} and allocation to anchor investors followed. ",
    "Issue opening date February 31, 2024. ",
    "Bid opening date except in relation to any bids received from the anchor investors, being {s}. ",
    "",
]


def _dated(template: Column, day: Column) -> Column:
    for mark, form in (("{m}", "MMMM d, yyyy"), ("{d}", "d MMMM yyyy"), ("{s}", "d'th' MMM, yyyy")):
        template = F.replace(template, F.lit(mark), F.date_format(day, form))
    return template


def offer_texts(t: Tables) -> DataFrame:
    """(id, page, text, listing_date): the documents in two pages, with labelled days before, between and behind."""
    k = F.col("doc_id")
    day = F.date_add(F.lit("2021-01-01").cast("date"), (k % 900).cast("int"))
    first = _dated(F.get(F.array(*(F.lit(o) for o in OPENINGS)), (k % 8).cast("int")), day)
    last = _dated(F.lit(" Bid closing date, {m}"), F.date_add(day, (k % 5 - 1).cast("int")))
    again = F.when(k % 9 == 0, _dated(F.lit(" The offer closed on {d}."), F.date_add(day, F.when(k % 2 == 0, 30).otherwise((k % 5 - 1).cast("int"))))).otherwise("")
    rows = spread(t.documents.select("doc_id", "text").where("doc_id is not null")).select(k.alias("id"), F.when(k % 4 == 0, F.date_add(day, 1)).alias("listing_date"), F.explode(F.array(F.struct(F.lit(1).alias("page"), F.concat(first, F.coalesce("text", F.lit(""))).alias("text")), F.struct(F.lit(2).alias("page"), F.concat(last, again).alias("text")))).alias("p"))
    return rows.select("id", "p.page", "p.text", "listing_date")


_WRITTEN = "replace(replace(replace({0}, '{{m}}', strftime(day, '%B %-d, %Y')), '{{d}}', strftime(day, '%-d %B %Y')), '{{s}}', strftime(day, '%-dth %b, %Y'))"
_OPENED = f"""d AS (SELECT doc_id AS id, DATE '2021-01-01' + (doc_id % 900)::INT AS day, [{', '.join("'" + o + "'" for o in OPENINGS)}][doc_id % 8 + 1] AS template FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT id, day, {_WRITTEN.format('template')} AS sentence, [1, 5, NULL, NULL, NULL, NULL, 1, NULL][id % 8 + 1] AS start,
  {_WRITTEN.format("['Bid/Issue Opening Date: Monday, {m}', 'issue opens on - i.e. {d}', '', '', '', '', 'Bid opening date except in relation to any bids received from the anchor investors, being {s}', ''][id % 8 + 1]")} AS said FROM d)"""


@query(f"WITH {_OPENED} SELECT id, start::INTEGER - 1 AS start, length(said)::INTEGER AS length, day::DATE AS day FROM o WHERE start IS NOT NULL")
def label_dates(spark, sf_dir):
    """Labels of an opening day with their day, across phrases that may stand between, and where they stand in the page's collapsed text."""
    pages = offer_texts(Tables(spark, sf_dir)).where("page = 1")
    return pages.select("id", F.inline(labels.date_mentions(F.col("text"), labels.LABELS["open"])))


@query(f"""WITH {_OPENED}, s AS (SELECT id, CASE WHEN start IS NOT NULL THEN day::DATE END AS first, (day + (id % 5 - 1)::INT)::DATE AS last, id % 9 = 0 AND id % 2 = 0 AS clash, CASE WHEN id % 4 = 0 THEN (day + 1)::DATE END AS listed FROM o),
r AS (SELECT *, CASE WHEN clash THEN 'official_date_conflict' WHEN first > last THEN 'invalid_offer_chronology' WHEN last > listed THEN 'closing_after_listing' END AS reason FROM s)
SELECT id, CASE WHEN reason IS NULL THEN first END AS open_date, CASE WHEN reason IS NULL THEN last END AS close_date, CASE WHEN reason IS NULL AND first IS NOT NULL THEN 1 END AS open_page, CASE WHEN reason IS NULL THEN 2 END AS close_page, reason FROM r""")
def offer_dates(spark, sf_dir):
    """An offer's first and last day by consensus over its pages, with rules of chronology."""
    pages = offer_texts(Tables(spark, sf_dir))
    return labels.offer_dates(pages, pages.where("page = 1"))


@query("""SELECT c_custkey AS id, 1 + c_custkey % 3 AS header_line, 8 + c_custkey % 17 AS start, CASE WHEN c_custkey % 4 = 3 THEN 8 + c_custkey % 17 + 34 ELSE 28 + c_custkey % 17 END AS "end",
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (1 + c_custkey) * 1000000 + 500000 END AS amount FROM customer WHERE c_custkey % 6 <> 5""")
def header_cells(spark, sf_dir):
    """Amounts in a column whose limits come from its header and the neighbour's; other columns hold amounts too."""
    k = F.col("c_custkey")
    at = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    start = 8 + k % 17
    above = F.repeat(F.lit("x\n"), (k % 3).cast("int"))
    neighbour = F.when(k % 4 == 3, "OTHER").otherwise("ELIGIBILITY")
    # the neighbour's header may stand a line below its own
    header = F.when(k % 4 == 1, text(at(start), "Total  Offer Size\n", at(start + 20), neighbour)).otherwise(text(at(start), "TOTAL ISSUE SIZE", at(F.lit(4)), neighbour))
    header = F.when(k % 6 == 5, F.lit("no header")).otherwise(header)
    value = F.when(k % 5 == 0, text(at(start), "not stated")).otherwise(text(at(start), "Rs ", F.format_number(1 + k, 0), ".5"))
    unit = text(at(start), "million")
    page = text("first\n", above, header, "\n7 million\n", value, "\n", unit, F.when(k % 2 == 0, "\r\nRisks in Relation to the issue\n").otherwise("\nGENERAL RISK\n"), at(start), "99 million")
    found = Tables(spark, sf_dir).customer.select(k.alias("id"), layout.column_below(page, r"TOTAL\s+(?:OFFER|ISSUE)", "ELIGIBILITY", r"RISKS?\s+IN\s+RELATION|GENERAL\s+RISK").alias("c")).where("c is not null")
    return found.select("id", F.col("c.header_line").cast("long").alias("header_line"), F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"), layout.million_amount(F.col("c.content")).alias("amount"))


def sources(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, suppliers, orders and pages read as observations, with what is left out and what is missing."""
    c, s, o = F.col("c_custkey"), F.col("s_suppkey"), F.col("o_orderdate")
    gap = ("some_need_review", F.try_element_at("reasons", F.lit("needs_review")) > 0)
    read = [
        (adapters.Adapter("customers", c, {"issuer_name": F.when(c % 10 != 3, F.col("c_name")), "code": c, "board": F.lower("c_mktsegment")}, (("needs_review", F.col("c_acctbal") < 0, F.col("c_mktsegment")),), (gap,)), t.customer),
        (adapters.Adapter("suppliers", s, {"issuer_name": F.concat(F.lit("Customer#"), F.lpad((s * 7).cast("string"), 9, "0")), "code": s, "outcome": F.lit("listed")}, (("needs_review", s < 0, F.lit("")), ("closed", s % 9 == 0, F.lit("x"))), (gap,)), t.supplier),
        (adapters.Adapter("orders", F.col("o_orderkey"), {"issuer_name": F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")), "observation_date": o.cast("date"), "outcome": F.when(F.col("o_orderstatus") == "F", "listed").when(F.col("o_orderstatus") == "O", "scheduled")}), t.orders),
        (adapters.Adapter("pages", F.col("page_id"), {"issuer_name": F.col("url")}, (("no_company", F.lit(True), F.lit(None)),)), t.pages),
        (adapters.Adapter("nothing", F.col("n_nationkey"), {"issuer_name": F.col("n_name")}), t.nation.where("n_nationkey < 0")),
    ]
    return adapters.observe(read, (F.lit("1993-01-01").cast("date"), F.lit("1999-12-31").cast("date")))


_OBSERVED = """o AS (SELECT 'customers' AS source, c_custkey::VARCHAR AS row, CASE WHEN c_custkey % 10 <> 3 THEN c_name END AS name, c_custkey::VARCHAR AS code, lower(c_mktsegment) AS board, NULL AS outcome, NULL::DATE AS day, CASE WHEN c_acctbal < 0 THEN 'needs_review' WHEN c_custkey % 10 = 3 THEN 'missing_issuer_identity' END AS reason, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS detail FROM customer
UNION ALL SELECT 'suppliers', s_suppkey::VARCHAR, 'Customer#' || lpad((s_suppkey * 7)::VARCHAR, 9, '0'), s_suppkey::VARCHAR, NULL, 'listed', NULL, CASE WHEN s_suppkey % 9 = 0 THEN 'closed' END, CASE WHEN s_suppkey % 9 = 0 THEN 'x' END FROM supplier
UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0'), NULL, NULL, CASE o_orderstatus WHEN 'F' THEN 'listed' WHEN 'O' THEN 'scheduled' END, o_orderdate::DATE, CASE WHEN o_orderdate < '1993-01-01' OR o_orderdate >= '2000-01-01' THEN 'outside_window' END, CASE WHEN o_orderdate < '1993-01-01' OR o_orderdate >= '2000-01-01' THEN o_orderdate::DATE::VARCHAR END FROM orders
UNION ALL SELECT 'pages', page_id::VARCHAR, url, NULL, NULL, NULL, NULL, 'no_company', NULL FROM pages)"""


@query(f"""WITH {_OBSERVED} SELECT name AS "key", count(*) AS observations, array_to_string(list_sort(list_distinct(list(source))), '+') AS sources, coalesce(array_to_string(list_sort(list_distinct(list(code))), '+'), '') AS codes, min(day) AS first_date, max(day) AS last_date, CASE WHEN count(DISTINCT outcome) > 1 THEN 'conflict' ELSE min(outcome) END AS outcome FROM o WHERE reason IS NULL GROUP BY name""")
def observations(spark, sf_dir):
    """Observations of all sources rolled up by identity."""
    rolled = adapters.roll_up(sources(Tables(spark, sf_dir))[0], F.col("issuer_name"))
    return rolled.select("key", "observations", F.array_join("sources", "+").alias("sources"), F.array_join("codes", "+").alias("codes"), "first_date", "last_date", "outcome")


@query(f"WITH {_OBSERVED} SELECT source, row, reason, detail FROM o WHERE reason IS NOT NULL")
def observation_exclusions(spark, sf_dir):
    """Every row of a source that is no observation, with the reason."""
    return sources(Tables(spark, sf_dir))[1]


@query(f"""WITH {_OBSERVED}, c AS (SELECT source, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'needs_review') AS review FROM o GROUP BY source)
SELECT source, 'nothing_kept' AS gap FROM c WHERE kept = 0 UNION ALL SELECT source, 'some_need_review' FROM c WHERE review > 0 UNION ALL SELECT 'nothing', 'no_rows'""")
def observation_gaps(spark, sf_dir):
    """What each source cannot show."""
    return sources(Tables(spark, sf_dir))[2]


_ATTEMPTS = """a AS (SELECT user_id, event_id, ts AS tm, 1 + (event_id % 97 = 0)::INT + (event_id % 389 = 0)::INT AS version, CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'verified' WHEN event_type = 'view' THEN 'rejected' ELSE 'failed' END AS status, event_type || event_id AS result FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM a)"""


@query(f"""WITH RECURSIVE {_ATTEMPTS},
s AS (SELECT user_id, rn, version, 1::BIGINT AS attempts, 0::BIGINT AS skipped, tm, status, result, CASE WHEN status = 'verified' THEN tm END AS verified_at FROM n WHERE rn = 1
UNION ALL SELECT s.user_id, n.rn, greatest(s.version, n.version), CASE WHEN n.version > s.version THEN 1 WHEN late THEN s.attempts ELSE s.attempts + 1 END, s.skipped + (late AND n.version <= s.version)::INT, CASE WHEN n.version <= s.version AND late THEN s.tm ELSE n.tm END,
  CASE WHEN keep THEN s.status ELSE n.status END, CASE WHEN keep THEN s.result ELSE n.result END, CASE WHEN keep THEN s.verified_at WHEN n.status = 'verified' THEN n.tm END
  FROM (SELECT s.*, (n.version < s.version OR n.tm < s.tm OR s.status = 'verified' OR n.tm - s.tm < INTERVAL 6 HOUR) AS late, CASE WHEN n.version > s.version THEN s.status = 'verified' AND n.status <> 'verified' ELSE (n.version < s.version OR n.tm < s.tm OR s.status = 'verified' OR n.tm - s.tm < INTERVAL 6 HOUR) END AS keep
    FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1) s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1)
SELECT user_id, version::INTEGER AS version, attempts, skipped, tm AS last_at, status, result, verified_at FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""")
@tidy
def attempt_state(spark, sf_dir):
    """The events as a stream of attempts, folded into a retained state for each user. Runs the stream when called."""
    k = F.col("event_id")
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    status = F.when((F.col("event_type") == "purchase") & (k % 5 == 0), "verified").when(F.col("event_type") == "view", "rejected").otherwise("failed")
    rows = events.select("user_id", k.alias("place"), F.col("ts").cast("timestamp").alias("at"), (1 + (k % 97 == 0).cast("int") + (k % 389 == 0).cast("int")).alias("version"), status.alias("status"), text(F.col("event_type"), k).alias("result"))
    states = attempts.attempt_states(rows, ["user_id"], attempts.Rules(cool_down=6 * 3600))
    path = new_path(spark, "attempts")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch-{number}")
    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(states.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
    last = seen.groupBy("user_id").agg(F.max_by(F.struct(*(c for c in seen.columns if c != "user_id")), F.struct("version", F.col("attempts") + F.col("skipped"))).alias("s")).select("user_id", "s.*")
    return last.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in ("last_at", "verified_at") else c for c in last.columns))


@query("""WITH b AS (SELECT year(o_orderdate)::VARCHAR AS partition, count(*) AS n, count(*) FILTER (o_orderkey % 500 = 7) AS edits FROM orders GROUP BY 1)
SELECT partition, CASE WHEN partition = '1996' THEN 'removed' WHEN partition = '1995' THEN 'changed' WHEN partition::INT % 2 = 0 AND edits > 0 THEN 'changed' ELSE 'same' END AS change, n AS rows_before, CASE WHEN partition <> '1996' THEN n + (partition = '1995')::INT END AS rows_after FROM b
UNION ALL SELECT '2050', 'added', NULL, 3""")
@tidy
def changed_partitions(spark, sf_dir):
    """Orders written by year, then written anew with edits in some years, one year gone and one added: what the second write changes. Runs jobs when called."""
    path = new_path(spark, "changed")
    k = F.col("o_orderkey")
    first = Tables(spark, sf_dir).orders.select(k, F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    manifests.write_changed(first, path)
    edited = first.where("year <> 1996").withColumn("status", F.when((k % 500 == 7) & (F.col("year") % 2 == 0), "edited").otherwise(F.col("status")))
    more = spark.range(3).select(F.col("id").alias("o_orderkey"), F.lit("new").alias("status"), F.lit(2050).alias("year"))
    one = spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("new").alias("status"), F.lit(1995).alias("year"))
    return manifests.write_changed(edited.unionByName(more).unionByName(one).repartition(3), path)


_MENTION = {"number": "[0-9]{2,}", "licence": "[Ll]icen[cs]e[d]?", "stop": "[.] "}
_MENTIONS = " UNION ALL ".join(f"SELECT id, page, t, '{k}' AS label, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM p" for k, p in _MENTION.items())


@query(f"""WITH p AS (SELECT doc_id AS id, 1 AS page, coalesce(text, '') AS t FROM documents),
h AS ({_MENTIONS}),
m AS (SELECT id, page, t, label, found[i] AS found, (list_sum(list_transform(gaps[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0))::INTEGER AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM h)),
c AS (SELECT *, substr(t, greatest(0, start - 10) + 1, least(start, 10) + len(found) + 15) AS context FROM m),
r AS (SELECT *, (row_number() OVER (PARTITION BY id, page, label ORDER BY start))::INTEGER AS nth FROM c WHERE regexp_matches(context, '[a-z]{{4}}'))
SELECT id, page, label, nth, start, found, context FROM r WHERE nth <= 6""")
def mention_places(spark, sf_dir):
    """The first six mentions of each pattern in the documents' pages, with places and what stands around them; contexts need a word."""
    docs = spread(Tables(spark, sf_dir).documents.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return documents.mentions(docs, _MENTION, before=10, after=15, needs="[a-z]{4}")


def _fills(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    records = t.part.select(k.alias("id"), F.when(k % 3 == 0, F.col("p_size")).alias("size"))
    seen = t.lineitem.join(t.part, F.col("l_partkey") == k).select(k.alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_size") + F.when((F.col("l_orderkey") % 40 == 0) | (k % 9 == 0), 1).otherwise(0)).alias("value"))
    return documents.fill_field(records, seen, "size")


_FILLED = """s AS (SELECT l_partkey AS id, count(DISTINCT p_size + (l_orderkey % 40 = 0 OR l_partkey % 9 = 0)::INT) AS n, min(p_size + (l_orderkey % 40 = 0 OR l_partkey % 9 = 0)::INT) AS seen FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0 GROUP BY 1),
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS current, seen, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' ELSE 'agreed' END AS reason FROM part LEFT JOIN s ON s.id = p_partkey),
o AS (SELECT *, CASE WHEN reason <> 'agreed' THEN 'unchanged' WHEN current IS NULL THEN 'filled' WHEN current = seen THEN 'corroborated' ELSE 'conflict' END AS outcome FROM r)"""


@query(f"WITH {_FILLED} SELECT id, CASE WHEN outcome = 'filled' THEN seen ELSE current END AS value, reason, outcome FROM o")
def field_fills(spark, sf_dir):
    """A field filled from what was observed: gaps are filled by an agreed value, equal ones corroborated, others held."""
    return _fills(Tables(spark, sf_dir))[0]


@query(f"""WITH {_FILLED} SELECT count(*) FILTER (current IS NULL) AS candidates, count(*) FILTER (outcome = 'filled') AS filled, count(*) FILTER (outcome = 'corroborated') AS corroborated, count(*) FILTER (outcome = 'conflict') AS conflicts,
count(*) FILTER (reason = 'ambiguous') AS ambiguous, count(*) FILTER (reason = 'absent') AS absent, count(*) FILTER (current IS NULL AND outcome <> 'filled') AS remaining FROM o""")
def field_fill_counters(spark, sf_dir):
    """How many records were candidates, filled, corroborated, in conflict and left open."""
    return _fills(Tables(spark, sf_dir))[1]


@query("""WITH g AS (SELECT c_custkey AS id, c_nationkey AS partition, CASE WHEN c_custkey % 20 = 0 THEN 'NA' ELSE c_name END AS name, c_custkey % 10 AS lot, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 7 END AS band FROM customer),
b AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS id, CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_nationkey END AS partition, CASE c_custkey % 6 WHEN 0 THEN 'new ' || c_custkey WHEN 1 THEN c_name WHEN 2 THEN NULL WHEN 3 THEN 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') WHEN 4 THEN 'pair ' || c_custkey // 12 ELSE c_name END AS name,
  CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE c_custkey % 10 END AS lot, c_custkey % 7 AS band FROM customer),
x AS (SELECT DISTINCT b.id, g.id AS hit, g.partition FROM b JOIN g ON b.id = g.id UNION SELECT b.id, g.id, g.partition FROM b JOIN g ON b.name = g.name),
h AS (SELECT id, count(*) AS hits, min(hit) AS hit, min(partition) AS p FROM x GROUP BY id),
again AS (SELECT id FROM b QUALIFY count(*) OVER (PARTITION BY id) > 1 UNION SELECT id FROM b WHERE name IS NOT NULL QUALIFY count(*) OVER (PARTITION BY name) > 1)
SELECT b.id, CASE WHEN b.id IN (SELECT id FROM again) THEN 'repeated' WHEN hits IS NULL THEN 'added' WHEN hits > 1 OR h.p <> b.partition THEN 'held' WHEN g.lot = b.lot AND g.band IS NOT DISTINCT FROM b.band THEN 'present' WHEN g.lot = b.lot AND g.band IS NULL THEN 'enriched' ELSE 'conflict' END AS outcome
FROM b LEFT JOIN h ON h.id = b.id LEFT JOIN g ON g.id = h.hit""")
def reviewed_batch(spark, sf_dir):
    """One batch of reviewed rows against the customers: added, present, enriched, held, in conflict or repeated; a twentieth of the names are one."""
    c = F.col("c_custkey")
    t = Tables(spark, sf_dir).customer
    padded = lambda n: F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0"))
    registry = t.select(c.alias("id"), F.col("c_nationkey").alias("partition"), F.when(c % 20 == 0, "NA").otherwise(F.col("c_name")).alias("name"), (c % 10).alias("lot"), F.when(c % 4 != 0, c % 7).alias("band"))
    name = F.when(c % 6 == 0, text("new ", c)).when(c % 6 == 2, F.lit(None)).when(c % 6 == 3, padded(c + 1)).when(c % 6 == 4, text("pair ", F.floor(c / 12))).otherwise(F.col("c_name"))
    batch = t.select(F.when(c % 5 == 0, c + 10000000).otherwise(c).alias("id"), F.when(c % 11 == 0, -1).otherwise(F.col("c_nationkey")).alias("partition"), name.alias("name"), F.when(c % 13 == 0, -1).otherwise(c % 10).alias("lot"), (c % 7).alias("band"))
    return reviewed.reviewed_import(registry, batch, ["id", "name"], ["lot", "band"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 3 <> 0 THEN year(o_orderdate)::INT + 1 ELSE year(o_orderdate)::INT END::VARCHAR AS partition,
CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 10 = 0 THEN 'applied' ELSE 'refused' END WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey % 3 <> 0 THEN 'applied' ELSE 'refused' END WHEN o_orderkey % 5 = 2 THEN 'already' WHEN o_orderkey % 5 = 3 THEN 'refused' ELSE 'untouched' END AS outcome FROM orders
UNION ALL SELECT -1 - n_nationkey, NULL, NULL, 'unknown' FROM nation""")
def guarded_actions(spark, sf_dir):
    """Corrections and moves that apply only where the record still is what the action expects."""
    t, k = Tables(spark, sf_dir), F.col("o_orderkey")
    year = F.year("o_orderdate").cast("string")
    registry = t.orders.select(k.alias("id"), year.alias("partition"), F.col("o_orderstatus").alias("value"))
    action = lambda kind, expected, target: F.struct(F.lit(kind).alias("kind"), expected.alias("expected"), target.alias("target"))
    s, later = F.col("o_orderstatus"), (F.year("o_orderdate") + 1).cast("string")
    asked = (
        F.when(k % 5 == 0, F.array(action("correct", F.when(k % 10 == 0, s).otherwise("old"), F.lit("X"))))
        .when(k % 5 == 1, F.array(action("move", F.when(k % 3 != 0, year).otherwise("1900"), later)))
        .when(k % 5 == 2, F.array(action("correct", F.lit("old"), s)))
        .when(k % 5 == 3, F.array(action("correct", s, F.lit("Y")), action("correct", s, F.lit("Z"))))
    )
    actions = t.orders.select(k.alias("id"), F.explode(asked).alias("a")).select("id", "a.*").unionByName(t.nation.select((-1 - F.col("n_nationkey").cast("long")).alias("id"), F.lit("move").alias("kind"), F.lit("1").alias("expected"), F.lit("2").alias("target")))
    return reviewed.reconciled(registry, actions)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey % 4 + 1 END::BIGINT AS page FROM customer""")
def fact_pages(spark, sf_dir):
    """The first page of a notice that holds a fact's text, across any white space."""
    k = F.col("c_custkey")
    pages = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when((i == k % 4) & (k % 4 != 3) | (i == 4) & (k % 4 != 3), text("Scrip  Code\n", k, " Market Lot")).otherwise(text("page ", i)))
    return Tables(spark, sf_dir).customer.select(k.alias("id"), notices.page_of(pages, text("Scrip Code ", k, " Market")).alias("page"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey // 100 AS n FROM customer) SELECT n || '-batch' || (1 + n % 2) AS batch, (row_number() OVER (PARTITION BY n ORDER BY id) - 1)::INTEGER AS row_index, id, CASE WHEN n % 5 = 1 THEN 'missing' WHEN n % 3 = 1 THEN 'changed' ELSE 'bound' END AS binding FROM c""")
@tidy
def reviewed_folders(spark, sf_dir):
    """Reviewed batches found by name among drafts, and bound by hash to the queues they were made for; a hundred customers are a batch, a folder each. Runs jobs when called."""
    path = new_path(spark, "reviewed")
    c = F.col("c_custkey")
    n = F.floor(c / 100)
    t = Tables(spark, sf_dir).customer
    batches = t.groupBy(n.alias("n")).agg(F.array_sort(F.collect_list(F.struct(c.alias("id"), F.col("c_name").alias("name")))).alias("entries"))
    n = F.col("n")
    made_for = F.sha2(text("queue ", n, F.when(n % 3 == 1, " before").otherwise("")).cast("binary"), 256)
    batches = batches.select(text(n, "-batch", 1 + n % 2).alias("batch"), text("queue-", n).alias("queue"), made_for.alias("queue_sha256"), "entries", F.lit("reviewed").alias("kind"))
    drafts = batches.withColumns({"kind": F.lit("drafts"), "queue": F.lit("none")})
    batches.unionByName(drafts).write.partitionBy("kind", "batch").json(path)
    queues = t.select(F.floor(c / 100).alias("n")).distinct().where(n % 5 != 1).select(text("queue-", n).alias("file"), F.sha2(text("queue ", n).cast("binary"), 256).alias("sha256"))
    found = manifests.named_documents(spark, path, "queue string, queue_sha256 string, entries array<struct<id: bigint, name: string>>", r"^kind=reviewed/batch=\d+-batch\d+/")
    return manifests.bound_batches(found, queues).select(F.regexp_extract("file", "batch=([^/]+)/", 1).alias("batch"), "row_index", "id", "binding")


@query("""SELECT p_brand AS brand, count(*) AS parts, sum(p_size)::BIGINT AS sizes, count(*) AS full_parts FROM part GROUP BY 1""")
@tidy
def audit_reports(spark, sf_dir):
    """A report by brand written in full and compact form, and both read back. Runs jobs when called."""
    path = new_path(spark, "audit")
    report = Tables(spark, sf_dir).part.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("sizes"), F.sort_array(F.collect_set("p_type")).alias("types"))
    reports.write_both(materialize(report, "report"), path, [F.col("brand"), F.col("parts"), F.col("sizes")])
    compact = spark.read.schema("brand string, parts bigint, sizes bigint").json(f"{path}/compact")
    full = spark.read.schema("brand string, parts bigint, types array<string>").json(f"{path}/full")
    return compact.join(full.select("brand", F.col("parts").alias("full_parts")), "brand")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderkey % 8 AS f, o_orderkey % 3 = 0 AS clash FROM orders),
r AS (SELECT *, CASE f WHEN 0 THEN 'filled' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'corroborated' WHEN 3 THEN 'unchanged' WHEN 4 THEN 'amended' WHEN 5 THEN 'unchanged' WHEN 6 THEN 'filled' ELSE 'amended' END AS outcome FROM o)
SELECT id, outcome, CASE WHEN f = 3 THEN 'other' WHEN f = 5 THEN 'old' ELSE s END AS value, CASE WHEN f = 5 THEN 'provisional' WHEN f IN (1, 2, 3) THEN 'verified' WHEN clash THEN 'conflict' ELSE 'verified' END AS status,
CASE f WHEN 0 THEN clash::INT WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 1 + clash::INT WHEN 5 THEN 0 WHEN 6 THEN clash::INT ELSE 1 + clash::INT END AS more_sources,
CASE f WHEN 4 THEN 'amendment:old' || CASE WHEN clash THEN '+disagreement:' ELSE '' END WHEN 7 THEN 'amendment:older+amendment:old' || CASE WHEN clash THEN '+disagreement:' ELSE '' END WHEN 0 THEN CASE WHEN clash THEN 'disagreement:' ELSE '' END WHEN 6 THEN CASE WHEN clash THEN 'disagreement:' ELSE '' END ELSE '' END AS history FROM r""")
def retained_terms(spark, sf_dir):
    """Retained terms after a source's newer word: filled, corroborated, amended with history, in conflict, or left alone."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    word = lambda x: F.lit(x).cast("string")
    live = lambda url, at, kind="feed": retained.source(word(url), word(kind), word("id"), word(at))
    none = F.lit(None)
    field = lambda value, status, origin, history=(): F.struct(value.cast("string").alias("value"), word(status).alias("status"), origin.alias("source"), F.array().cast(f"array<{retained.SOURCE}>").alias("additional"), F.array(*history).cast(f"array<{retained.CORRECTION}>").alias("corrections"))
    older = retained.correction("amendment", word("2022"), word("older"), word("verified"), word("old"))
    forms = [none, field(s, "verified", live("u2", "2024")), field(s, "verified", live("u1", "2023")), field(word("other"), "verified", live("u1", "2023", "paper")), field(word("old"), "verified", live("u1", "2023")), field(word("old"), "provisional", live("u1", "2023")), field(none, "missing", live("u1", "2023")), field(word("old"), "verified", live("u1", "2023"), [older])]
    old = F.when(k % 8 == 1, forms[1])
    for i in range(2, 8):
        old = old.when(k % 8 == i, forms[i])
    others = F.array(F.struct(F.when(k % 3 == 0, word("else")).otherwise(s).alias("value"), live("u3", "2024").alias("source")), F.struct(none.cast("string").alias("value"), live("u4", "2024").alias("source")))
    seen = retained.observed(F.when(k % 8 != 5, s), live("u2", "2024"), others)
    rows = Tables(spark, sf_dir).orders.select(k.alias("id"), retained.updated(old, seen).alias("u")).select("id", "u.outcome", "u.field.*")
    history = F.array_join(F.transform("corrections", lambda c: F.concat(c["kind"], F.lit(":"), F.coalesce(c["previous_value"], F.lit("")))), "+")
    return rows.select("id", "outcome", "value", "status", F.size("additional").alias("more_sources"), history.alias("history"))
