"""Builders of schema documents: typed values, keywords, combinations, ready-made texts.

A builder gives a plain document (a dict), so it can be printed, stored, or compiled by any
catalog.  A keyword is a function that adds to a document.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

Document = dict[str, Any]
Keyword = Callable[[Document], None]


class Property(tuple):
    """A name and a schema, for ``object_``."""


def prop(name: str, schema: Document | bool) -> Property:
    return Property((name, schema))


def typed(name: str | None, keywords: tuple[Keyword, ...]) -> Document:
    out: Document = {} if name is None else {"type": name}
    for k in keywords:
        k(out)
    return out


def object_(*items: Property | Keyword) -> Document:
    """An object with properties and keywords in any order."""
    out = typed("object", tuple(i for i in items if not isinstance(i, Property)))
    props = {name: schema for name, schema in (i for i in items if isinstance(i, Property))}
    if props:
        out["properties"] = props
    return out


def _typed(name: str | None) -> Callable[..., Document]:
    return lambda *keywords: typed(name, keywords)


string, integer, number, boolean, null, array, any_ = (_typed(n) for n in ("string", "integer", "number", "boolean", "null", "array", None))


def const(value: Any) -> Document:
    return {"const": value}


def enum(*values: Any) -> Document:
    return {"enum": list(values)}


def one_of(*schemas: Document) -> Document:
    return {"oneOf": list(schemas)}


def any_of(*schemas: Document) -> Document:
    return {"anyOf": list(schemas)}


def all_of(*schemas: Document) -> Document:
    return {"allOf": list(schemas)}


def not_(schema: Document) -> Document:
    return {"not": schema}


def ref(target: str) -> Document:
    return {"$ref": target}


class Condition:
    """``if_(c).then(a).else_(b)``; ``document()`` ends one without ``else_``."""

    def __init__(self, condition: Document):
        self._out: Document = {"if": condition}

    def then(self, schema: Document) -> Condition:
        self._out["then"] = schema
        return self

    def else_(self, schema: Document) -> Document:
        self._out["else"] = schema
        return self.document()

    def document(self) -> Document:
        return dict(self._out)


if_ = Condition


def _sets(name: str) -> Callable[[Any], Keyword]:
    """A keyword constructor with one value."""
    return lambda value: lambda doc: doc.__setitem__(name, value)


def _lists(name: str) -> Callable[..., Keyword]:
    """A keyword constructor that gathers its values into an array."""
    return lambda *values: lambda doc: doc.__setitem__(name, list(values))


min_length, max_length, pattern, format_ = (_sets(n) for n in ("minLength", "maxLength", "pattern", "format"))
min_, max_, exclusive_min, exclusive_max, multiple_of = (_sets(n) for n in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"))
items, min_items, max_items, unique_items = (_sets(n) for n in ("items", "minItems", "maxItems", "uniqueItems"))
contains, min_contains, max_contains, unevaluated_items = (_sets(n) for n in ("contains", "minContains", "maxContains", "unevaluatedItems"))
prefix_items, required, examples = (_lists(n) for n in ("prefixItems", "required", "examples"))
additional_props = additional_props_schema = _sets("additionalProperties")
min_props, max_props, pattern_props, property_names, unevaluated_props = (_sets(n) for n in ("minProperties", "maxProperties", "patternProperties", "propertyNames", "unevaluatedProperties"))
dependent_required, dependent_schemas = (_sets(n) for n in ("dependentRequired", "dependentSchemas"))
title, description, default, deprecated, read_only, write_only = (_sets(n) for n in ("title", "description", "default", "deprecated", "readOnly", "writeOnly"))
content_encoding, content_media_type, content_schema = (_sets(n) for n in ("contentEncoding", "contentMediaType", "contentSchema"))
id_, schema_uri, anchor, dynamic_anchor, defs = (_sets(n) for n in ("$id", "$schema", "$anchor", "$dynamicAnchor", "$defs"))


def _text(name: str) -> Callable[[], Document]:
    return lambda: {"type": "string", "format": name}


email, date_time, date, time, uri, uri_ref, uuid = (_text(n) for n in ("email", "date-time", "date", "time", "uri", "uri-reference", "uuid"))
hostname, ipv4, ipv6, idn_email, idn_hostname, iri, iri_ref = (_text(n) for n in ("hostname", "ipv4", "ipv6", "idn-email", "idn-hostname", "iri", "iri-reference"))
uri_template, json_pointer, relative_json_pointer, duration, regex = (_text(n) for n in ("uri-template", "json-pointer", "relative-json-pointer", "duration", "regex"))


def _whole(name: str, bound: int) -> Callable[[], Document]:
    return lambda: {"type": "integer", name: bound}


positive_int, non_negative_int, negative_int, non_positive_int = _whole("minimum", 1), _whole("minimum", 0), _whole("maximum", -1), _whole("maximum", 0)
