"""Schemas from ``StructType`` and back, with rules kept in field metadata.

A field's metadata may hold ``rules`` (``"required,minLength=2,enum=a b"``), ``json`` (its name
in documents, ``"-"`` leaves it out) and ``comment`` (a description).  Commas part rules outside
quotes and brackets; ``enum`` and ``examples`` part their values by spaces, or by ``|`` if there is one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection
from typing import Any

from pyspark.sql import types as T

from pactlake.plans.schema import LATEST, Schema

Document = dict[str, Any]
#: A custom rule: (field type, parameters) -> keywords to add.
Rule = Callable[[T.DataType, list[str]], Document]
_CUSTOM: dict[str, Rule] = {}
_SIZES = {"minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains"}
_NUMBERS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
_FLAGS = {"uniqueItems", "deprecated", "readOnly", "writeOnly"}
_TEXTS = {"pattern", "format", "title", "description", "contentEncoding", "contentMediaType"}
_REFERENCES = {"ref": "$ref", "anchor": "$anchor", "dynamicRef": "$dynamicRef"}
_SCHEMAS = {"not", "contains", "propertyNames", "if", "then", "else", "contentSchema", "items"}
_BRANCHES = {"allOf", "anyOf", "oneOf", "prefixItems"}
#: Rules that, on an array, speak of its elements.
_OF_ELEMENTS = (_SIZES | _NUMBERS | {"pattern", "format", "enum"}) - {"minItems", "maxItems", "minContains", "maxContains", "minProperties", "maxProperties"}


def register_rule(name: str, rule: Rule) -> None:
    """A rule for all inferences; one passed to a call comes before it."""
    _CUSTOM[name] = rule


def split_rules(text: str, custom: Collection[str] = ()) -> list[tuple[str, str | None]]:
    """(name, parameter) of each rule; a part that names no rule continues the last parameter."""
    parts, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[({":
            depth += 1
        elif c in "])}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(now)
            now = ""
            continue
        now += c
    parts.append(now)
    rules: list[tuple[str, str | None]] = []
    for part in parts:
        name, equals, value = part.strip().partition("=")
        known = re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", name) and (equals or name in _FLAGS or name in _CUSTOM or name in custom or name in ("required", "additionalProperties", "unevaluatedItems", "unevaluatedProperties", "defs"))
        if known or not rules:
            rules.append((name, value if equals else None))
        else:
            last, so_far = rules[-1]
            rules[-1] = (last, f"{so_far},{part}")
    if any(not n and v for n, v in rules):
        raise ValueError(f"a rule without a name in {text!r}")
    return [(n, v.strip("'\"") if v else v) for n, v in rules if n]


def _value(text: str, kind: str | None) -> Any:
    if kind in ("integer", "number", "boolean") or re.match(r"^[\[{\"]", text):
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


def _parameter(text: str, kind: str | None) -> Any:
    """A schema from a rule's parameter: a document, a type's name, or a constant."""
    if text in ("string", "integer", "number", "boolean", "null", "array", "object"):
        return {"type": text}
    if text in ("true", "false"):
        return text == "true"
    if text.startswith("{"):
        return json.loads(text)
    return {"$ref": f"#/$defs/{text}"} if text[:1].isupper() else {"const": _value(text, kind)}


def _apply(doc: Document, name: str, text: str | None, field: T.DataType, kind: str | None, custom: dict[str, Rule]) -> None:
    text = "" if text is None else text
    if name in custom or name in _CUSTOM:
        doc |= (custom.get(name) or _CUSTOM[name])(field, [p for p in text.split(",") if p])
    elif name in _SIZES | _NUMBERS:
        try:
            doc[name] = int(text) if name in _SIZES else json.loads(text)
        except ValueError:
            raise ValueError(f"rule {name!r} has the parameter {text!r}; rules that are not known continue a parameter") from None
    elif name in _FLAGS:
        doc[name] = text != "false"
    elif name in _TEXTS:
        doc[name] = text
    elif name in _REFERENCES:
        doc[_REFERENCES[name]] = text
    elif name in ("const", "default"):
        doc[name] = _value(text, kind)
    elif name in ("enum", "examples"):
        doc[name] = [_value(v, kind) for v in (text.split("|") if "|" in text else text.split())]
    elif name in _SCHEMAS:
        doc[name] = _parameter(text, kind)
    elif name in _BRANCHES:
        doc[name] = [_parameter(p.strip(), kind) for p in text.strip("[]").split(",")]
    elif name in ("additionalProperties", "unevaluatedItems", "unevaluatedProperties"):
        doc[name] = _parameter(text, kind) if text else True
    elif name == "patternProperties":
        key, _, value = text.partition(",")
        doc.setdefault(name, {})[key] = _parameter(value, kind)
    elif name == "dependentRequired":
        key, *need = text.split(",")
        doc.setdefault(name, {})[key] = need
    elif name == "dependentSchemas":
        key, _, value = text.partition(",")
        doc.setdefault(name, {})[key] = _parameter(value, kind)
    elif name != "defs":  # definitions come with ``extra``; the rule stands for nothing by itself
        raise ValueError(f"unknown rule {name!r}")


def _type_document(kind: T.DataType, options: dict[str, Any]) -> Document:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {"type": "integer"}
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return {"type": "number"}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date-time"}
    if isinstance(kind, T.DateType):
        return {"type": "string", "format": "date"}
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return {"type": "string"} | ({"contentEncoding": "base64"} if isinstance(kind, T.BinaryType) else {})
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _type_document(kind.elementType, options)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": _type_document(kind.valueType, options)}
    if isinstance(kind, T.StructType):
        return _struct(kind, options)
    return {}


def _struct(kind: T.StructType, options: dict[str, Any]) -> Document:
    props: Document = {}
    required = []
    for f in kind:
        rules = split_rules(f.metadata.get(options["rules"], ""), options["custom"]) if f.metadata.get(options["rules"]) else []
        name = f.metadata.get("json") or options["rename"](f.name)
        if name == "-" or not rules and not options["untagged"]:
            continue
        doc = _type_document(f.dataType, options)
        kind_name = doc.get("type")
        for rule, text in rules:
            if rule == "required":
                continue
            to = doc["items"] if kind_name == "array" and rule in _OF_ELEMENTS and isinstance(doc.get("items"), dict) else doc
            _apply(to, rule, text, f.dataType, to.get("type"), options["custom"])
        if f.metadata.get("comment"):
            doc.setdefault("description", f.metadata["comment"])
        if options["nullable"] and f.nullable:
            doc = {"anyOf": [doc, {"type": "null"}]}
        props[name] = doc
        if any(r == "required" for r, _ in rules) or options["required"] and not f.nullable:
            required.append(name)
    return {"type": "object", "properties": props} | ({"required": sorted(required) if options["sort"] else required} if required else {})


def from_struct_type(kind: T.StructType, *, rules: str = "rules", untagged: bool = True, default_required: bool = False, nullable: bool = False, rename: Callable[[str], str] = lambda n: n, custom: dict[str, Rule] | None = None, sort_required: bool = True, version: str = LATEST, extra: Document | None = None) -> Document:
    """A schema document for rows of a type.

    untagged: also fields without rules.  nullable: a nullable field may hold null, rather than
    only be absent.  default_required: fields that are not nullable are required.
    """
    options = {"rules": rules, "untagged": untagged, "nullable": nullable, "rename": rename, "custom": custom or {}, "required": default_required, "sort": sort_required}
    return {"$schema": version} | _struct(kind, options) | (extra or {})


def to_struct_type(node: Schema) -> T.StructType:
    """The Spark type of the objects that a compiled schema describes."""
    kind = _data_type(node)
    if not isinstance(kind, T.StructType):
        raise ValueError("the schema describes no object with properties")
    return kind


def _data_type(node: Schema) -> T.DataType:
    if isinstance(node.get("$ref"), str) and (target := node.target("$ref")) is not None and "type" not in node:
        return _data_type(target)
    names = node.get("type")
    names = [n for n in (names if isinstance(names, list) else [names]) if n not in (None, "null")]
    name = names[0] if len(names) == 1 else "object" if "properties" in node else "number" if set(names) == {"integer", "number"} else None
    if name == "object":
        if "properties" in node:
            need = node.get("required", [])
            return T.StructType([T.StructField(k, _data_type(s), k not in need) for k, s in node.get("properties").items()])
        values = node.get("additionalProperties")
        return T.MapType(T.StringType(), _data_type(values) if values is not None and values.boolean is None else T.VariantType())
    if name == "array":
        return T.ArrayType(_data_type(node.get("items")) if "items" in node else T.VariantType())
    if name == "string":
        return {"date-time": T.TimestampType(), "date": T.DateType()}.get(node.get("format"), T.StringType())
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(name, T.VariantType())


def to_module(node: Schema, name: str = "SCHEMA") -> str:
    """Python source that defines the type, for keeping beside a job's code."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in to_struct_type(node))
    return f'"""Made from a schema document."""\n\nfrom pyspark.sql.types import StructType\n\n{name} = StructType.fromDDL({ddl!r})\n'
