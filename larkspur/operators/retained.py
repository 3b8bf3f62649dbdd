"""Retained terms: a value with its status, its sources and the history of its corrections, updated by what a source says now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.operators.nested import let

SOURCE = "struct<url:string,type:string,identity:string,at:string>"
CORRECTION = "struct<kind:string,at:string,previous_value:string,previous_status:string,replacement_value:string>"
FIELD = f"struct<value:string,status:string,source:{SOURCE},additional:array<{SOURCE}>,corrections:array<{CORRECTION}>>"


def source(url: Column, kind: Column, identity: Column, at: Column) -> Column:
    """Where a value comes from."""
    return F.struct(url.alias("url"), kind.alias("type"), identity.alias("identity"), at.alias("at"))


def correction(kind: str, at: Column, previous: Column, status: Column, replacement: Column) -> Column:
    """A row of a term's history."""
    return F.struct(F.lit(kind).alias("kind"), at.alias("at"), previous.alias("previous_value"), status.alias("previous_status"), replacement.alias("replacement_value"))


def _field(value: Column, status: Column, origin: Column, additional: Column, corrections: Column) -> Column:
    return F.struct(value.alias("value"), status.alias("status"), origin.alias("source"), additional.alias("additional"), corrections.alias("corrections")).cast(FIELD)


def observed(value: Column, origin: Column, others: Column) -> Column:
    """A field of what a source says, with what its other endpoints say (array of struct(value, source)).

    Those that differ make it a ``conflict``: their sources are kept beside its own, and a correction of the kind ``disagreement`` says that it is
    not resolved. Endpoints without a value do not count; a null value gives no field.
    """
    differing = F.filter(others, lambda o: o["value"].isNotNull() & (o["value"] != value))

    def of(d: Column) -> Column:
        clash = F.size(d) > 0
        rows = F.when(clash, F.array(correction("disagreement", origin["at"], F.lit(None), F.lit(None), F.lit(None)))).otherwise(F.array())
        return _field(value, F.when(clash, "conflict").otherwise("verified"), origin, F.transform(d, lambda o: o["source"]), rows)

    return F.when(value.isNotNull(), let(F.coalesce(differing, F.slice(others, 1, 0)), of))


def _known(field: Column, origin: Column) -> Column:
    same = lambda s: s["url"].eqNullSafe(origin["url"]) & s["type"].eqNullSafe(origin["type"]) & s["identity"].eqNullSafe(origin["identity"])
    return same(field["source"]) | F.coalesce(F.exists(field["additional"], same), F.lit(False))


def updated(field: Column, seen: Column) -> Column:
    """struct(field, outcome) of a retained field after a newer one of the same kind of source, both of the type FIELD or null.

    ``filled``: there was no value, the new field stands. ``corroborated``: the value is the same, the source is added if its url, type and identity
    are new. ``amended``: the new field stands, with the old history, a correction that keeps the previous value and status, and the
    previous source among its own. ``unchanged``: nothing is new, or the field comes from another kind of source, which this one may not amend.
    """

    def pair(made: Column, outcome: str) -> Column:
        return F.struct(made.alias("field"), F.lit(outcome).alias("outcome"))

    def of(f: Column) -> Column:
        old, new = f["old"], f["new"]
        previous = correction("amendment", new["source"]["at"], old["value"], F.coalesce(old["status"], F.lit("verified")), new["value"])
        history = F.concat(F.coalesce(old["corrections"], F.array().cast(f"array<{CORRECTION}>")), F.array(previous.cast(CORRECTION)), new["corrections"])
        beside = F.when(old["source"]["url"].isNull() | _known(new, old["source"]), new["additional"]).otherwise(F.concat(new["additional"], F.array(old["source"])))
        joined = F.concat(F.coalesce(old["additional"], F.array().cast(f"array<{SOURCE}>")), F.array(new["source"]))
        return (
            F.when(new["value"].isNull() | (old.isNotNull() & ~old["source"]["type"].eqNullSafe(new["source"]["type"])), pair(old, "unchanged"))
            .when(old["value"].isNull(), pair(new, "filled"))
            .when(old["value"] != new["value"], pair(_field(new["value"], new["status"], new["source"], beside, history), "amended"))
            .when(_known(old, new["source"]), pair(old, "unchanged"))
            .otherwise(pair(_field(old["value"], old["status"], old["source"], joined, old["corrections"]), "corroborated"))
        )

    return let(F.struct(field.cast(FIELD).alias("old"), seen.cast(FIELD).alias("new")), of)
