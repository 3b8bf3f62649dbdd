"""Tables in HTML: a grid of cells with spans, layouts of rows, and the links of a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.keys import collapse, decode_entities
from larkspur.operators.nested import let

#: The most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def cell_text(html: Column) -> Column:
    """The text of a piece of HTML: tags are white space, entities decoded, white space collapsed."""
    return collapse(decode_entities(F.regexp_replace(html, "<[^>]*>", " ")))


def _cell(html: Column) -> Column:
    """struct(text, links, header, columns, rows) of a cell from its opening tag on."""
    span = lambda tag, name, most: F.least(F.greatest(F.coalesce(F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']?\s*(\d+)""", 1).try_cast("int"), F.lit(1)), F.lit(1)), F.lit(most))

    def of(s: Column) -> Column:
        tag, body = s["tag"], s["body"]
        anchors = F.regexp_extract_all(body, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
        links = F.transform(anchors, lambda a: decode_entities(F.substr(a, F.lit(2), F.length(a) - 2)))
        return F.struct(cell_text(body).alias("text"), links.alias("links"), tag.rlike("(?i)^<th").alias("header"), span(tag, "colspan", MOST_COLUMNS).alias("columns"), span(tag, "rowspan", MOST_ROWS).alias("rows"))

    # tag and body are named more than once, so they are cut out first
    body = lambda tag: F.get(F.split(F.substr(html, F.length(tag) + 1), r"(?i)</t[dh]\s*>", 2), F.lit(0))
    return let(let(F.regexp_extract(html, r"(?i)^<t[dh]\b[^>]*>?", 0), lambda tag: F.struct(tag.alias("tag"), body(tag).alias("body"))), of)


def _laid(rows: Column) -> Column:
    """Rows whose cells stand in their columns: a cell that spans rows stands in the same columns of the rows below."""
    empty = F.slice(F.get(rows, F.lit(0)), 1, 0)
    no_spans = F.expr("cast(array() as array<struct<at: int, left: int, cell: struct<text: string, links: array<string>, header: boolean, columns: int, rows: int>>>)")
    start = F.struct(F.slice(F.array(empty), 1, 0).alias("grid"), no_spans.alias("open"))

    def step(state: Column, row: Column) -> Column:
        taken = F.transform(state["open"], lambda o: o["at"])
        free = F.filter(F.sequence(F.lit(0), F.size(row) + F.size(taken)), lambda i: ~F.array_contains(taken, i))
        placed = F.transform(row, lambda c, i: F.struct(F.get(free, i).alias("at"), (c["rows"] - 1).alias("left"), c.alias("cell")))

        def after(here: Column) -> Column:
            later = F.filter(F.concat(F.transform(state["open"], lambda o: F.struct(o["at"].alias("at"), (o["left"] - 1).alias("left"), o["cell"].alias("cell"))), here), lambda o: o["left"] > 0)
            whole = F.array_sort(F.concat(state["open"], here), lambda a, b: a["at"] - b["at"])
            return F.struct(F.array_append(state["grid"], F.transform(whole, lambda o: o["cell"])).alias("grid"), later.alias("open"))

        return let(placed, after)

    return F.aggregate(rows, start, step, lambda s: s["grid"])


def grids(html: Column) -> Column:
    """array (tables) of arrays (rows) of arrays (columns) of struct(text, links, header, columns, rows): the tables of a page.

    Comments, scripts and styles are left out. A cell that spans columns stands in each of them, one that spans rows in each of
    these. Rows and cells need no closing tags. A table within a cell is a table of its own, and what
    follows it in the outer table is not read. A row without cells is empty; null html gives null.
    """
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    pieces = lambda text, opening: F.slice(F.split(text, rf"(?i)<{opening}\b[^>]*>"), 2, 1 << 30)

    def rows(table: Column) -> Column:
        inside = F.get(F.split(table, r"(?i)</table\s*>", 2), F.lit(0))
        cells = lambda row: F.transform(F.filter(F.split(row, r"(?i)(?=<t[dh]\b)"), lambda c: c.rlike(r"(?i)^<t[dh]\b")), _cell)
        wide = lambda row: F.flatten(F.transform(cells(row), lambda c: F.array_repeat(c, c["columns"])))
        return let(F.transform(pieces(inside, "tr"), wide), lambda r: F.when(F.exists(r, lambda row: F.exists(row, lambda c: c["rows"] > 1)), _laid(r)).otherwise(r))

    return F.transform(pieces(plain, "table"), rows)


def page_grids(pages: DataFrame) -> DataFrame:
    """(id, table_no, table) of pages (id, html). A plain explode would compute the grids three times: the optimizer infers a filter from it."""
    return pages.select("id", F.posexplode_outer(grids(F.col("html"))).alias("table_no", "table")).where("table is not null")


def table_rows(pages: DataFrame) -> DataFrame:
    """(id, table_no, row_no, cells) of pages (id, html): every row of every table; numbers count from 0."""
    tables = page_grids(pages)
    return tables.select("id", "table_no", F.posexplode("table").alias("row_no", "cells"))


def records(pages: DataFrame) -> DataFrame:
    """(id, table_no, row_no, name, text, link): cells under the headers of their table, one row each.

    The first row of a table names its columns if all its cells are header cells; tables without such a row have no records. Of the links of a
    cell the first counts. Cells beyond the last header have a null name.
    """
    tables = page_grids(pages).withColumn("head", F.get("table", F.lit(0)))
    named = tables.where((F.size("head") > 0) & F.forall("head", lambda c: c["header"]))
    rows = named.select("id", "table_no", "head", F.posexplode(F.slice("table", 2, 1 << 30)).alias("row_no", "cells"))
    cells = rows.select("id", "table_no", (F.col("row_no") + 1).alias("row_no"), "head", F.posexplode("cells").alias("col", "cell"))
    return cells.select("id", "table_no", "row_no", F.get("head", F.col("col"))["text"].alias("name"), "cell.text", F.get("cell.links", F.lit(0)).alias("link"))


def by_layout(rows: DataFrame, layouts: list[tuple[str, dict[int, str], dict[str, int]]], key: str) -> DataFrame:
    """One row for each id and ``key`` of rows (id, table_no, row_no, cells): the fields of the first layout that a row fits.

    A layout is (name, patterns that columns must match, column of each field). Rows that fit none are left out. Of rows with
    one key in a page the last counts, at the place of the first (``table_no``, ``row_no``). Fields that a layout lacks and empty ones are null.
    """
    fields = list(dict.fromkeys(f for _, _, columns in layouts for f in columns))
    text = lambda i: F.get("cells", F.lit(i))["text"]
    fits = [reduce(lambda a, b: a & b, (F.coalesce(text(i).rlike(p), F.lit(False)) for i, p in guards.items())) for _, guards, _ in layouts]
    pick = lambda values: F.coalesce(*(F.when(ok & ~reduce(lambda a, b: a | b, fits[:n], F.lit(False)), v) for n, (ok, v) in enumerate(zip(fits, values))))
    laid = rows.select("id", "table_no", "row_no", pick([F.lit(name) for name, _, _ in layouts]).alias("layout"), *(pick([F.nullif(text(columns[f]), F.lit("")) if f in columns else F.lit(None).cast("string") for _, _, columns in layouts]).alias(f) for f in fields))
    place = F.struct("table_no", "row_no")
    kept = laid.where(F.col("layout").isNotNull() & F.col(key).isNotNull()).groupBy("id", key).agg(F.min(place).alias("first"), F.max_by(F.struct("layout", *(f for f in fields if f != key)), place).alias("last"))
    return kept.select("id", "first.table_no", "first.row_no", "last.layout", *(key if f == key else f"last.{f}" for f in fields))
