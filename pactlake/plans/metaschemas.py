"""Schemas of schemas, put together for each dialect from one table of keyword rules."""

from __future__ import annotations

from typing import Any

from pactlake.plans.schema import DIALECTS, SINCE

_TYPES = ["array", "boolean", "integer", "null", "number", "object", "string"]


def metaschema(uri: str) -> dict[str, Any]:
    """A self-contained schema that the documents of a dialect obey."""
    draft = DIALECTS[uri]
    key = "definitions" if draft <= 7 else "$defs"
    here = {"$ref": "#"}
    ref = lambda name: {"$ref": f"#/{key}/{name}"}
    names: dict[str, Any] = {"type": "array", "items": {"type": "string"}, "uniqueItems": True} | ({"minItems": 1} if draft == 4 else {})
    size: dict[str, Any] = {"type": "integer", "minimum": 0}
    number: dict[str, Any] = {"type": "number"}
    strict = {"type": "boolean"} if draft == 4 else number
    schemas = {"type": "array", "minItems": 1, "items": here}
    by_name = {"type": "object", "additionalProperties": here}
    text: dict[str, Any] = {"type": "string"}
    flag: dict[str, Any] = {"type": "boolean"}
    types = {"enum": _TYPES}
    positive = {"type": "number", "minimum": 0, "exclusiveMinimum": True} if draft == 4 else {"type": "number", "exclusiveMinimum": 0}
    rules: dict[str, Any] = {
        "id" if draft == 4 else "$id": text, "$schema": text, "$ref": text, "title": text, "description": text,
        "multipleOf": positive, "maximum": number, "minimum": number, "exclusiveMaximum": strict, "exclusiveMinimum": strict,
        "maxLength": ref("size"), "minLength": ref("size"), "maxItems": ref("size"), "minItems": ref("size"), "maxProperties": ref("size"), "minProperties": ref("size"),
        "pattern": text, "uniqueItems": flag, "required": ref("names"), "format": text,
        "properties": by_name, "patternProperties": by_name, key: by_name, "additionalProperties": here if draft > 4 else {"anyOf": [flag, here]},
        "enum": {"type": "array"} | ({"minItems": 1, "uniqueItems": True} if draft == 4 else {}),
        "type": {"anyOf": [types, {"type": "array", "items": types, "minItems": 1, "uniqueItems": True}]},
        "allOf": ref("schemas"), "anyOf": ref("schemas"), "oneOf": ref("schemas"), "not": here,
        "const": {}, "contains": here, "propertyNames": here, "if": here, "then": here, "else": here,
        "readOnly": flag, "writeOnly": flag, "contentEncoding": text, "contentMediaType": text, "contentSchema": here,
        "dependentRequired": {"type": "object", "additionalProperties": ref("names")}, "dependentSchemas": by_name,
        "unevaluatedItems": here, "unevaluatedProperties": here, "minContains": ref("size"), "maxContains": ref("size"), "deprecated": flag,
        "$anchor": {"type": "string", "pattern": "^[A-Za-z_][-A-Za-z0-9._]*$"}, "$dynamicRef": text, "$dynamicAnchor": text, "prefixItems": ref("schemas"),
    }
    rules = {k: v for k, v in rules.items() if SINCE.get(k, 0) <= draft}
    if draft <= 2019:
        rules["items"] = {"anyOf": [here, ref("schemas")]}
        rules["additionalItems"] = here if draft > 4 else {"anyOf": [flag, here]}
    else:
        rules["items"] = here
    if draft <= 7:
        rules["dependencies"] = {"type": "object", "additionalProperties": {"anyOf": [here, ref("names")]}}
    parts = {"size": size, "names": names, "schemas": schemas}
    return {"id" if draft == 4 else "$id": uri, "$schema": uri, "type": "object" if draft == 4 else ["object", "boolean"], "properties": rules, key: parts}
