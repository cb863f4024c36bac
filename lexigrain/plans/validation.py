"""Records against a schema: a fixed part of JSON Schema, compiled to column expressions over parsed JSON.

Records are parsed once (``variant``), and the schema becomes one expression that gives the problems of a record; no Python
runs over rows. A value that misses ``const``, ``enum``, ``anyOf`` or ``type`` is not looked into. Anything but
``KEYWORDS`` is refused when the schema is compiled.

Defined results: a null record and one that is no JSON (or names a key twice) are one problem each; keys that are not
expected are told by name in order; numbers are compared as doubles; patterns are Java's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keywords that a schema may use, and the types of JSON.
KEYWORDS = {"$schema", "$id", "title", "description", "type", "required", "properties", "additionalProperties", "enum", "const", "items", "minItems", "minimum", "maximum", "pattern", "anyOf", "format", "definitions"}
TYPES = ["object", "array", "string", "boolean", "null", "number", "integer"]
#: A moment by its form; whether the day and the time exist is for a cast to say.
DATE_TIME = r"^(?!0000)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)\z"
#: What ``schema_of_variant`` calls values that are no numbers.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


class SchemaError(ValueError):
    """The schema itself cannot be used."""


def parts(schema: dict) -> Iterator[tuple[str, object]]:
    """The schemas inside a schema, each with its place."""
    for group in ("properties", "definitions"):
        yield from ((f"/{group}/{k}", v) for k, v in schema.get(group, {}).items())
    if isinstance(schema.get("items"), dict):
        yield "/items", schema["items"]
    yield from ((f"/anyOf/{k}", v) for k, v in enumerate(schema.get("anyOf", ())))


def supported(schema: object, place: str = "#") -> None:
    """Raises unless every keyword, at any depth, is among ``KEYWORDS`` and every type is known."""
    if not isinstance(schema, dict):
        return
    for word in schema:
        if word not in KEYWORDS:
            raise SchemaError(f'{place}: unsupported JSON Schema keyword "{word}"')
    for t in names_of_types(schema):
        if t not in TYPES:
            raise SchemaError(f'{place}: unsupported type "{t}"')
    for where, part in parts(schema):
        supported(part, place + where)


def names_of_types(schema: dict) -> list[str]:
    t = schema.get("type", [])
    return [t] if isinstance(t, str) else t


def shown(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


class Value:
    """A column of parsed JSON and what it is asked."""

    def __init__(self, v: Column):
        self.v, self.kind = v, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)

    def got(self, kind: str) -> Column:
        return F.try_variant_get(self.v, "$", kind)

    @property
    def number(self) -> Column:
        return ~self.kind.isin(*KINDS)

    @property
    def items(self) -> Column:
        return self.got("array<variant>")

    @property
    def fields(self) -> Column:
        return self.got("map<string,variant>")

    def field(self, name: str) -> Column:
        return F.try_element_at(self.fields, F.lit(name))

    def type_name(self) -> Column:
        return reduce(lambda c, kind: c.when(self.kind == kind, KINDS[kind]), list(KINDS)[1:], F.when(self.kind == "OBJECT", "object")).otherwise("number")

    def has_type(self, name: str) -> Column:
        if name == "number":
            return self.number
        if name == "integer":
            n = self.got("double")
            return self.number & (n == F.floor(n).cast("double"))
        return self.type_name() == name

    def equals(self, x: object) -> Column:
        """Equality of JSON values: true is not 1, but 1 is 1.0."""
        if x is None:
            return self.kind == "VOID"
        if isinstance(x, bool):
            return (self.kind == "BOOLEAN") & (self.got("boolean") == x)
        if isinstance(x, int | float):
            return self.number & (self.got("double") == float(x))
        if isinstance(x, str):
            return (self.kind == "STRING") & (self.got("string") == x)
        if isinstance(x, list):
            own = [Value(F.get(self.items, F.lit(k))).equals(y) for k, y in enumerate(x)]
            return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), own, (self.kind == "ARRAY") & (F.size(self.items) == len(x)))
        own = [Value(self.field(k)).equals(y) for k, y in x.items()]
        return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), own, (self.kind == "OBJECT") & (F.size(F.map_keys(self.fields)) == len(x)))


def is_date_time(s: Column) -> Column:
    """An ISO 8601 moment that exists."""
    return s.rlike(DATE_TIME) & F.substring(s, 1, 19).try_cast("timestamp_ntz").isNotNull()


def every(lists: list[Column]) -> Column:
    return F.concat(*lists) if lists else F.array().cast("array<string>")


def told(wrong: Column, *text: Column | str) -> Column:
    """The text as the only problem where something is wrong, else none."""
    words = F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])
    return F.when(wrong, F.array(words)).otherwise(F.array().cast("array<string>"))


def problems(schema: dict, v: Column, at: Column) -> Column:
    """The problems of a parsed value, as an array of texts that name its place ``at``."""
    x, cases = Value(v), []
    no = lambda c: ~F.coalesce(c, F.lit(False))
    either = lambda cs: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs], F.lit(False))
    if "const" in schema:
        cases.append((no(x.equals(schema["const"])), told(F.lit(True), at, f": must equal {shown(schema['const'])}")))
    if "enum" in schema:
        cases.append((~either(map(x.equals, schema["enum"])), told(F.lit(True), at, f": must be one of {', '.join(map(shown, schema['enum']))}")))
    if "anyOf" in schema:
        cases.append((~either(F.size(problems(s, v, at)) == 0 for s in schema["anyOf"]), told(F.lit(True), at, ": does not satisfy any allowed alternative")))
    if "type" in schema:
        names = names_of_types(schema)
        cases.append((~either(map(x.has_type, names)), told(F.lit(True), at, f": expected type {','.join(names)}, got ", x.type_name())))
    n, s = x.got("double"), x.got("string")
    bounds = [told(wrong, at, ": ", F.to_json(v), f" {sign} {word} {shown(schema[word])}") for word, sign, wrong in (("minimum", "<", n < schema.get("minimum", 0)), ("maximum", ">", n > schema.get("maximum", 0))) if word in schema]
    texts = [told(~s.rlike(schema["pattern"]), at, f": does not match pattern {schema['pattern']}")] if "pattern" in schema else []
    if schema.get("format") == "date-time":
        texts.append(told(~is_date_time(s), at, ": not an ISO-8601 date-time"))
    lists = [told(F.size(x.items) < schema["minItems"], at, f": needs at least {schema['minItems']} item(s)")] if "minItems" in schema else []
    if "items" in schema:
        lists.append(F.flatten(F.transform(x.items, lambda y, k: problems(schema["items"], y, F.concat(at, F.lit("["), k.cast("string"), F.lit("]"))))))
    known = schema.get("properties", {})
    fields = [told(x.field(k).isNull(), at, f': missing required key "{k}"') for k in schema.get("required", ())]
    if schema.get("additionalProperties") is False:
        names = F.array_sort(F.array_except(F.map_keys(x.fields), F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
        fields.append(F.transform(names, lambda k: F.concat(at, F.lit(': unexpected key "'), k, F.lit('"'))))
    for k, part in known.items():
        fields.append(F.when(x.field(k).isNotNull(), problems(part, x.field(k), F.concat(at, F.lit(f".{k}")))).otherwise(F.array().cast("array<string>")))
    cases += [(x.number, every(bounds)), (x.kind == "STRING", every(texts)), (x.kind == "ARRAY", every(lists)), (x.kind == "OBJECT", every(fields))]
    first, *others = cases
    return reduce(lambda c, case: c.when(*case), others, F.when(*first)).otherwise(F.array().cast("array<string>"))


def validated(df: DataFrame, schema: dict, column: str = "record") -> DataFrame:
    """``df`` with ``problems``, an array of texts, empty for a valid record."""
    supported(schema)
    record = F.col(column)
    told_ = problems(schema, F.try_parse_json(record), F.lit("$"))
    return df.withColumn("problems", F.when(record.isNull(), F.array(F.lit("$: no record"))).when(F.try_parse_json(record).isNull(), F.array(F.lit("$: not JSON"))).otherwise(told_))
