"""Canonical keys and text forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.operators.nested import let

#: White space of any kind, words that a search skips, HTML entities in the order in which they are decoded.
BLANK = r"[\s\x{A0}\x{FEFF}]+"
SEARCH_SKIPS = (
    "limited", "ltd", "private", "pvt", "company", "corporation", "india", "gujarat", "global", "united", "and", "of", "the",
    "industries", "industry", "international", "services", "solutions", "systems", "system", "info", "information",
    "technology", "technologies", "engineering", "developers", "logistics", "consulting", "projects", "project", "infra",
    "infrastructure", "equipment", "power", "enterprises", "enterprise", "ventures", "collaboration",
)
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&#x2f;": "/", "&lt;": "<", "&gt;": ">"}


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _without(key: Column, pattern: str) -> Column:
    """Drops whole words of a space-separated key."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.replace(key, F.lit(" "), F.lit("  ")), F.lit(" ")), f" ({pattern}) ", " "), " +", " "))


def name_key(name: Column) -> Column:
    """Lower case, & as 'and', anything but letters and digits as one space; 'limited' stays."""
    return _words(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")))


def _long_form(key: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), key, F.lit(" ")), " ltd ", " limited "))


def issuer_key(name: Column) -> Column:
    """The name key with ltd written out and 'limited' at the end dropped."""
    return F.trim(F.regexp_replace(_long_form(name_key(name)), "( |^)limited$", ""))


def bare_key(name: Column) -> Column:
    """The name key without private, pvt, limited and ltd anywhere."""
    return _without(name_key(name), "private|pvt|limited|ltd")


def long_key(name: Column) -> Column:
    """The name key with ltd written out; 'limited' stays."""
    return _long_form(name_key(name))


def listing_key(name: Column) -> Column:
    """``long_key`` after '(formerly known as ...)' is dropped."""
    return long_key(F.regexp_replace(name, r"(?i)\(formerly known as [^)]*\)", " "))


def plain_key(name: Column) -> Column:
    """Like ``bare_key``, but & is no word."""
    return _without(_words(F.lower(name)), "private|pvt|limited|ltd")


def compact_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def slug(name: Column) -> Column:
    return F.replace(name_key(name), F.lit(" "), F.lit("-"))


def search_token(name: Column, least: int = 3) -> Column:
    """First word of the issuer key of at least ``least`` letters that a search does not skip, else the first of that length, else the first word."""
    words = F.split(issuer_key(name), " ")
    long = F.filter(words, lambda w: F.length(w) >= least)
    return F.coalesce(F.get(F.filter(long, lambda w: ~w.isin(*SEARCH_SKIPS)), F.lit(0)), F.get(long, F.lit(0)), F.get(words, F.lit(0)))


def strip_tags(html: Column) -> Column:
    """Text of HTML: scripts, styles and tags dropped, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return collapse(F.regexp_replace(bare, "<[^>]*>", " "))


def decode_entities(text: Column) -> Column:
    """Named entities in any case, then decimal references of one UTF-16 unit; what names no character stays as it is."""
    def decoded(part: Column) -> Column:
        code = F.regexp_extract(part, "^([0-9]+);", 1).try_cast("int")
        mark = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        known = code.between(1, 0xFFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.concat(mark, F.regexp_replace(part, "^[0-9]+;", ""))).otherwise(F.concat(F.lit("&#"), part))

    def of(t: Column) -> Column:
        named = t
        for entity, mark in ENTITIES.items():
            named = F.regexp_replace(named, f"(?i){entity}", mark)
        joined = lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), decoded), ""))
        # most texts have no entity
        return F.when(F.contains(t, F.lit("&")), let(F.split(named, "&#(?=[0-9]+;)"), joined)).otherwise(t)

    return let(text, of)


def initials(name: Column) -> Column:
    """First letters of the first two words, in upper case."""
    return F.upper(F.array_join(F.transform(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), lambda w: F.left(w, F.lit(1))), ""))


def tone(text: Column, tones: int = 4) -> Column:
    """A stable bucket: sum of the characters' codes modulo ``tones``."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: a + c) % tones


def name_variants(name: Column) -> Column:
    """A name's key and, if it has '(India)', the key without."""
    return F.array_distinct(F.array(name_key(name), name_key(F.regexp_replace(name, r"(?i)\s*\(india\)", ""))))
