"""Small readers of pages and files: page ranges, fragments, excerpts, quoted hints, attachments, kinds of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.arrays import occurrences
from larkspur.functions.keys import collapse
from larkspur.functions.tables import cell_text
from larkspur.operators.nested import let


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit("")).try_cast("int")


def page_range(html: Column, most: int = 10000) -> Column:
    """struct(start, end, total, reason) of 'a to b of n records': ``missing`` without one, ``invalid`` if it does not hold together; the numbers are then null."""
    form = r"(?i)\b(\d+)\s+to\s+(\d+)\s+of\s+([\d,]+)\s+records\b"

    def of(t: Column) -> Column:
        start, end, total = (_number(t, form, i) for i in (1, 2, 3))
        fits = F.coalesce((start >= 1) & (end >= start) & (end <= total) & (total <= most), F.lit(False))
        reason = F.when(~t.rlike(form), "missing").when(~fits, "invalid")
        return F.struct(*(F.when(reason.isNull(), v).alias(n) for v, n in ((start, "start"), (end, "end"), (total, "total"))), reason.alias("reason"))

    return let(cell_text(F.coalesce(html, F.lit(""))), of)


def listing_statistics(html: Column) -> Column:
    """struct(total_records, page, total_pages) of a listing's text and hidden fields; a page that is not named is the first."""
    hidden = lambda name: _number(html, rf"""(?i)name=['"]{name}['"]\s+value=['"]?(\d+)""")
    return F.struct(_number(cell_text(html), r"(?i)\bof\s+([\d,]+)\s+records\b").alias("total_records"), F.coalesce(hidden("nextValue"), F.lit(1)).alias("page"), hidden("totalpage").alias("total_pages"))


def fragment(text: Column, mark: str = "#@#") -> Column:
    """What stands before a mark."""
    return F.substring_index(F.trim(text), mark, 1)


def excerpt(text: Column, markers: tuple[str, ...], before: int = 80, limit: int = 700) -> Column:
    """At most ``limit`` characters of a collapsed text, from ``before`` characters ahead of its earliest marker (in any case) on, or from its beginning."""

    def of(t: Column) -> Column:
        places = F.filter(F.array(*(F.instr(F.lower(t), F.lit(m.lower())) for m in markers)), lambda p: p > 0)
        start = F.coalesce(F.greatest(F.lit(0), F.array_min(places) - 1 - before), F.lit(0))
        return F.substr(t, start + 1, F.lit(limit))

    return let(collapse(text), of)


def quoted_hints(source: Column, wanted: str, most: int = 30, longest: int = 240) -> Column:
    """The first ``most`` different texts between quotation marks of any kind that match ``wanted`` and have a letter, collapsed."""
    found = F.regexp_extract_all(source, F.lit(rf"""["'`](.{{1,{longest}}}?)["'`]"""), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, collapse), lambda h: h.rlike(f"(?i){wanted}") & h.rlike("[A-Za-z]"))), 1, most)


def attachments(html: Column, opening: str, admitted: str, most: int = 4) -> Column:
    """The first ``most`` different links of a page that begin with ``opening`` (in any case) and match ``admitted``."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    plain = F.transform(links, lambda x: F.regexp_replace(x, "(?i)&amp;", "&"))
    return F.slice(F.array_distinct(F.filter(plain, lambda x: F.startswith(F.lower(x), F.lit(opening.lower())) & x.rlike(admitted))), 1, most)


def content_kind(content: Column, declared: Column, url: Column) -> Column:
    """pdf by the first bytes; html by the declared type, the beginning of the text or the ending of the URL's path; else null."""
    begin = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 512), "UTF-8"), r"^\s+", ""))
    path = F.lower(F.try_parse_url(url, F.lit("PATH")))
    html = F.lower(F.coalesce(declared, F.lit(""))).contains("text/html") | begin.startswith("<!doctype html") | begin.startswith("<html")
    return F.when(F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary"), "pdf").when(html | F.coalesce(path.rlike(r"\.html?$"), F.lit(False)), "html")


def bid_terms(html: Column) -> Column:
    """struct(bid_lot, minimum_order_quantity, contexts) of a page's text: shares behind either label, and what stands around the first six labels."""

    def of(t: Column) -> Column:
        shares = lambda label: _number(t, rf"(?i)\b{label}\s*[:-]?\s*(\d[\d,]*)\s+equity\s+shares\b")
        lot, order = r"bid\s+lot", r"minimum\s+order\s+quantity"
        seen = F.slice(occurrences(t, rf"(?i)\b(?:{lot}|{order})\b", 100, 260), 1, 6)
        # 260 characters are counted from the label's first
        contexts = F.transform(seen, lambda o: F.concat(o["lead"], F.left(F.concat(o["found"], o["tail"]), F.lit(260))))
        return F.struct(shares(lot).alias("bid_lot"), shares(order).alias("minimum_order_quantity"), contexts.alias("contexts"))

    return let(cell_text(html), of)
