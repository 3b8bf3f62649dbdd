"""A subset of JSON Schema compiled to expressions that give a document's violations with their paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.nested import let, variant_of
from larkspur.functions.values import rfc3339, strict_date

#: The assertions that are compiled; others are refused, so that none passes silently. Notes assert nothing.
ASSERTIONS = ("$ref", "type", "required", "properties", "additionalProperties", "items", "format", "pattern", "minLength", "minItems", "const", "enum", "anyOf", "minimum", "exclusiveMinimum", "maximum")
NOTES = ("$schema", "$id", "title", "description", "$defs")
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")


def check(schema: dict) -> None:
    """Raises ValueError for an assertion, type or format that is not compiled, anywhere in the schema."""
    for key in schema:
        if key not in ASSERTIONS + NOTES:
            raise ValueError(f"unsupported schema assertion: {key}")
    kinds = schema.get("type", [])
    if set([kinds] if isinstance(kinds, str) else kinds) - set(TYPES) or schema.get("format", "date") not in ("date", "date-time"):
        raise ValueError(f"unsupported type or format: {schema}")
    if schema.get("additionalProperties", False) not in (True, False):
        raise ValueError("additionalProperties must be true or false")
    inner = [*schema.get("properties", {}).values(), *schema.get("$defs", {}).values(), *schema.get("anyOf", [])]
    for child in inner + ([schema["items"]] if "items" in schema else []):
        check(child)


def _text(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<path: string, rule: string>>)")


def errors(value: Column, schema: dict, path: Column, defs: dict, seen: tuple[str, ...] = ()) -> Column:
    """array<struct(path, rule)> of a variant (null: absent, which violates nothing) under a schema; ``defs`` are what $ref names."""
    one = lambda bad, rule, at=path: F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule"))))

    def of(node: Column) -> Column:
        v, kind, members, items, text = (node[n] for n in ("v", "kind", "members", "items", "text"))
        number = F.try_variant_get(v, "$", "double")
        found = []
        if "$ref" in schema:
            name = schema["$ref"].removeprefix("#/$defs/")
            if name not in defs or name in seen:
                raise ValueError(f"unsupported schema reference: {schema['$ref']}")
            found.append(errors(v, defs[name], path, defs, (*seen, name)))
        rules = []
        if "const" in schema:
            rules.append(one(F.to_json(v) != _text(schema["const"]), f"must equal {_text(schema['const'])}"))
        if "enum" in schema:
            rules.append(one(~F.to_json(v).isin(*(_text(x) for x in schema["enum"])), f"must be one of {_text(schema['enum'])}"))
        if "anyOf" in schema:
            fails = F.lit(True)
            for option in schema["anyOf"]:
                fails = fails & (F.size(errors(v, option, path, defs, seen)) > 0)
            rules.append(one(fails, "does not match an allowed form"))
        for key, broken in (("minimum", lambda x: number < x), ("exclusiveMinimum", lambda x: number <= x), ("maximum", lambda x: number > x)):
            if key in schema:
                rules.append(one((kind == "number") & broken(float(schema[key])), f"{key} {schema[key]}"))
        if "minLength" in schema:
            rules.append(one((kind == "string") & (F.length(text) < schema["minLength"]), f"minLength {schema['minLength']}"))
        if "pattern" in schema:
            rules.append(one((kind == "string") & ~text.rlike(schema["pattern"]), f"pattern {schema['pattern']}"))
        if "format" in schema:
            good = strict_date(text).isNotNull() if schema["format"] == "date" else rfc3339(text)
            rules.append(one((kind == "string") & ~F.coalesce(good, F.lit(False)), f"format {schema['format']}"))
        for name in schema.get("required", []):
            rules.append(one((kind == "object") & ~F.map_contains_key(members, name), "required", F.concat(path, F.lit(f".{name}"))))
        for name, child in schema.get("properties", {}).items():
            rules.append(F.when(kind == "object", errors(F.try_element_at(members, F.lit(name)), child, F.concat(path, F.lit(f".{name}")), defs, seen)))
        if schema.get("additionalProperties") is False:
            known = list(schema.get("properties", {}))
            others = F.filter(F.map_keys(members), lambda k: ~k.isin(*known)) if known else F.map_keys(members)
            rules.append(F.transform(others, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("not allowed").alias("rule"))))
        if "minItems" in schema:
            rules.append(one((kind == "array") & (F.size(items) < schema["minItems"]), f"minItems {schema['minItems']}"))
        if "items" in schema:
            rules.append(F.flatten(F.transform(items, lambda x, i: errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), defs, seen))))
        inner = F.concat(*(F.coalesce(r, _none()) for r in rules)) if rules else _none()
        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            fits = kind.isin(*kinds)
            if "integer" in kinds:
                fits = fits | ((kind == "number") & (number == F.floor(number)))
            # a value of another type breaks that rule alone
            inner = F.when(fits, inner).otherwise(F.array(F.struct(path.alias("path"), F.lit(f"type {' or '.join(kinds)}").alias("rule"))))
        return F.concat(*found, inner) if found else inner

    def parts(v: Column) -> Column:
        members, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
        return let(F.struct(members.alias("members"), items.alias("items")), lambda held: let(json_of(v, held), lambda json_text: of_json(v, held, json_text)))

    def json_of(v: Column, held: Column) -> Column:
        """A scalar's JSON; what holds others is not written as JSON at each of its levels."""
        return F.when(held["members"].isNotNull(), "{").when(held["items"].isNotNull(), "[").otherwise(F.to_json(v))

    def of_json(v: Column, held: Column, json_text: Column) -> Column:
        first = F.left(json_text, F.lit(1))
        kind = F.when(json_text == "null", "null").when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(json_text.isin("true", "false"), "boolean").otherwise("number")
        return F.struct(v.alias("v"), kind.alias("kind"), held["members"].alias("members"), held["items"].alias("items"), F.when(first == '"', F.try_variant_get(v, "$", "string")).alias("text"))

    return let(value, lambda v: F.when(v.isNull(), _none()).otherwise(let(parts(v), of)))


def violations(docs: DataFrame, schema: dict) -> DataFrame:
    """(id, path, rule) of JSON documents (id, document): every violation of the schema, with its path from ``$``.

    A value of another type than asked for breaks that rule alone; a text that is no JSON is a string; a null document
    breaks ``type`` if the schema asks for one. References may not be circular. One pass, no shuffle.
    """
    check(schema)
    document = F.coalesce(variant_of(F.col("document")), F.parse_json(F.lit("null")))
    return docs.select("id", F.explode(errors(document, schema, F.lit("$"), schema.get("$defs", {}))).alias("e")).select("id", "e.path", "e.rule")
