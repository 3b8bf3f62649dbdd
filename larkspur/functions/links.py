"""Links: parameters, exact admission, documents behind viewers, codes in paths; years in labels and escaped text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.keys import collapse
from larkspur.operators.nested import let

#: Names of filings that a year in brackets may follow; an update may be numbered.
FILINGS = r"(?:(?:Updated\s+Draft\s+Red\s+Herring\s+Prospectus|UDRHP)(?:[-\s]*(?:I{1,4}|V|\d+))?|Draft\s+Red\s+Herring\s+Prospectus|DRHP)"


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def parameters(url: Column) -> Column:
    """array<struct(name, value)> of a URL's parameters in order, decoded, repeated ones each; one without a sign has an empty value. Without any it is empty."""
    pairs = F.filter(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&"), lambda p: p != "")
    text = lambda t: F.coalesce(F.try_url_decode(t), t)
    name = lambda p: F.substring_index(p, "=", 1)
    return F.transform(pairs, lambda p: F.struct(text(name(p)).alias("name"), text(F.substr(p, F.length(name(p)) + 2)).alias("value")))


def admitted(url: Column, host: str, path: str, exactly: dict[str, str]) -> Column:
    """Whether a URL is https at this host and path, without credentials, and its parameters are exactly these, each once and with a value that matches its pattern. Null is not."""

    def once(found: Column, name: str, form: str) -> Column:
        return F.size(F.filter(found, lambda p: (p["name"] == name) & p["value"].rlike(f"^(?:{form})$"))) == 1

    def of(found: Column) -> Column:
        return reduce(lambda a, b: a & b, (once(found, n, form) for n, form in exactly.items()), F.size(found) == len(exactly))

    place = (_part(url, "PROTOCOL") == "https") & (_part(url, "HOST") == host) & (_part(url, "PATH") == path) & _part(url, "USERINFO").isNull()
    return F.coalesce(place & let(parameters(url), of), F.lit(False))


def appended(url: Column, name: str, value: Column) -> Column:
    """The URL with one more parameter, before its fragment; the value is encoded."""
    bare = F.substring_index(url, "#", 1)
    mark = F.when(F.instr(bare, F.lit("?")) == 0, "?").when(bare.rlike("[?&]$"), "").otherwise("&")
    return F.concat(bare, mark, F.lit(f"{name}="), F.url_encode(value.cast("string")), F.substr(url, F.length(bare) + 1))


def inner_document(url: Column, ending: str = "pdf", deep: int = 2) -> Column:
    """The address of a document that a URL is or carries: itself if its path has the ending, else the first parameter that is such an https address, down to ``deep`` viewers or encodings."""

    def of(u: Column, left: int) -> Column:
        own = F.when((_part(u, "PROTOCOL") == "https") & _part(u, "PATH").rlike(rf"(?i)\.{ending}$"), u)
        if not left:
            return own
        inside = F.transform(parameters(u), lambda p: of(F.coalesce(F.when(p["value"].rlike("^[A-Za-z]+://"), p["value"]), F.try_url_decode(p["value"])), left - 1))
        return F.coalesce(own, F.get(F.filter(inside, lambda x: x.isNotNull()), F.lit(0)))

    return of(url, deep)


def last_code(url: Column, digits: int = 6) -> Column:
    """The last segment of a URL's path that is just so many digits."""
    return F.try_element_at(F.filter(F.split(_part(url, "PATH"), "/"), lambda s: s.rlike(f"^[0-9]{{{digits}}}$")), F.lit(-1))


def filing_year(label: Column) -> Column:
    """The year of this century in brackets at the end of a label, right behind the name of a filing."""
    return F.regexp_extract(collapse(label), rf"(?i)\b{FILINGS}\s*\(\s*(20\d{{2}})\s*\)$", 1).try_cast("int")


def escaped(text: Column) -> Column:
    """Text for use in HTML: the ampersand, brackets and both quotation marks as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
