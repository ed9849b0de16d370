"""JSON Schema contracts compiled to column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The leading words of a variant's type for each JSON type.
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
# What the formats that are checked look like.
FORMATS = {"uuid": "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", "email": "@"}


def _is(kind: Column, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        if name == "integer":
            out = out | (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
        for start in KINDS.get(name, ()):
            out = out | kind.startswith(start)
    return out


def _fail(path: Column, rule: str) -> Column:
    return F.concat_ws(": ", F.when(path != "", path), F.lit(rule))


def _below(path: Column, name: Column) -> Column:
    return F.concat_ws(".", F.when(path != "", path), name)


def _within(part: Column, schema: dict, root: dict, path: Column) -> Column:
    """The failure of a part that may be missing."""
    return F.try_element_at(F.transform(F.array_compact(F.array(part)), lambda x: failure(x, schema, root, path)), F.lit(1))


def _first(found: Column) -> Column:
    return F.try_element_at(F.array_compact(found), F.lit(1))


def failure(value: Column, schema: dict, root: dict | None = None, path: Column | None = None) -> Column:
    """Where and why ``value`` (VARIANT) breaks the schema first, keyword by keyword in the schema's order: ``path: rule``; null if it holds.

    Knows type, required, properties, additionalProperties, items, minItems, enum, const, minLength, maxLength, pattern,
    minimum, maximum, format (uuid, email) and $ref into the document's own $defs. Names may hold letters, digits and _."""
    root, path = root or schema, F.lit("") if path is None else path
    # Named once: in a plain expression every keyword would read the value, and all above it, anew.
    kind = F.schema_of_variant(value)
    named = {"required", "additionalProperties"} & schema.keys()
    names = F.map_keys(F.when(kind.startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))) if named else F.lit(None).cast("array<string>")
    held = F.array(F.struct(value.alias("value"), kind.alias("kind"), path.alias("path"), names.alias("names")))
    return F.get(F.transform(held, lambda h: _failure(h["value"], h["kind"], h["names"], schema, root, h["path"])), F.lit(0))


def _failure(value: Column, kind: Column, names: Column, schema: dict, root: dict, path: Column) -> Column:
    text = lambda: F.when(_is(kind, "string"), F.try_variant_get(value, "$", "string"))
    number = lambda: F.when(_is(kind, "number"), F.try_variant_get(value, "$", "double"))
    fields = F.when(_is(kind, "object"), F.try_variant_get(value, "$", "map<string,variant>"))
    items = F.when(_is(kind, "array"), F.try_variant_get(value, "$", "array<variant>"))
    checks: list[Column] = []

    def must(holds: Column, rule: str) -> None:
        # What a keyword doesn't apply to holds.
        checks.append(F.when(~F.coalesce(holds, F.lit(True)), _fail(path, rule)))

    for keyword, wants in schema.items():
        if keyword == "$ref":
            target = root
            for step in wants.removeprefix("#/").split("/"):
                target = target[step]
            checks.append(failure(value, target, root, path))
        elif keyword == "type":
            must(_is(kind, *([wants] if isinstance(wants, str) else wants)), "type")
        elif keyword in ("enum", "const"):
            allowed = wants if keyword == "enum" else [wants]
            must(F.coalesce(text().isin(*[w for w in allowed if isinstance(w, str)]), F.lit(False)) | (_is(kind, "null") if None in allowed else F.lit(False)), keyword)
        elif keyword == "minLength":
            must(F.char_length(text()) >= wants, keyword)
        elif keyword == "maxLength":
            must(F.char_length(text()) <= wants, keyword)
        elif keyword == "pattern":
            must(text().rlike(wants), keyword)
        elif keyword == "minimum":
            must(number() >= wants, keyword)
        elif keyword == "maximum":
            must(number() <= wants, keyword)
        elif keyword == "format" and wants in FORMATS:
            must(text().rlike(FORMATS[wants]), f"format {wants}")
        elif keyword == "required":
            checks.append(_first(F.array(*[F.when(~F.array_contains(names, name), _fail(path, f"required {name}")) for name in wants])))
        elif keyword == "properties":
            for name, own in wants.items():
                part = F.try_variant_get(value, f"$.{name}", "variant")
                checks.append(_within(part, own, root, _below(path, F.lit(name))))
        elif keyword == "additionalProperties" and wants is False:
            must(F.size(F.array_except(names, F.array(*map(F.lit, schema.get("properties", {}))))) == 0, keyword)
        elif keyword == "additionalProperties" and isinstance(wants, dict):
            others = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*schema.get("properties", {})) if schema.get("properties") else F.lit(True))
            checks.append(_first(F.transform(others, lambda e: failure(e["value"], wants, root, _below(path, e["key"])))))
        elif keyword == "items":
            checks.append(_first(F.transform(items, lambda x, k: failure(x, wants, root, _below(path, k.cast("string"))))))
        elif keyword == "minItems":
            must(F.size(items) >= wants, keyword)
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def contract_failure(text: Column, schema: dict) -> Column:
    """The first failure of a JSON text; ``json`` if it is none."""
    found = F.transform(F.array_compact(F.array(F.try_parse_json(text))), lambda value: F.coalesce(failure(value, schema), F.lit("")))
    return F.nullif(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("json")), F.lit(""))
