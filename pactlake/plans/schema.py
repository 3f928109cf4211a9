"""Schema documents as plan trees: dialects, normal form, identifiers and references.

Every dialect is brought to one normal form while a document is compiled; the plan is never
changed afterwards, but for references that are bound when they are first needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

from pactlake.functions import numbers, patterns

#: The dialects by their identifiers, oldest first.
DIALECTS = {
    "http://json-schema.org/draft-04/schema": 4,
    "http://json-schema.org/draft-06/schema": 6,
    "http://json-schema.org/draft-07/schema": 7,
    "https://json-schema.org/draft/2019-09/schema": 2019,
    "https://json-schema.org/draft/2020-12/schema": 2020,
}
LATEST = "https://json-schema.org/draft/2020-12/schema"
ONE = frozenset("not if then else items contains additionalProperties propertyNames unevaluatedItems unevaluatedProperties contentSchema".split())
MANY = frozenset("allOf anyOf oneOf prefixItems".split())
NAMED = frozenset("properties patternProperties dependentSchemas $defs".split())
#: The dialect that brought a keyword in, for those that not all have.
SINCE = {"const": 6, "contains": 6, "propertyNames": 6, "if": 7, "then": 7, "else": 7, "contentEncoding": 7, "contentMediaType": 7, "readOnly": 7, "writeOnly": 7, "dependentRequired": 2019, "dependentSchemas": 2019, "unevaluatedItems": 2019, "unevaluatedProperties": 2019, "minContains": 2019, "maxContains": 2019, "contentSchema": 2019, "$anchor": 2019, "deprecated": 2019, "prefixItems": 2020, "$dynamicRef": 2020, "$dynamicAnchor": 2020}
VALIDATION = frozenset("type enum const multipleOf maximum exclusiveMaximum minimum exclusiveMinimum maxLength minLength pattern maxItems minItems uniqueItems maxContains minContains maxProperties minProperties required dependentRequired".split())
ANNOTATIONS = ("title", "description", "default", "deprecated", "readOnly", "writeOnly", "examples")
KNOWN = ONE | MANY | NAMED | VALIDATION | frozenset(ANNOTATIONS) | frozenset("$id $schema $ref $anchor $dynamicRef $dynamicAnchor $recursiveRef $recursiveAnchor $comment $vocabulary format contentEncoding contentMediaType additionalItems dependencies definitions id".split())
#: Vocabularies either of which turns the validation keywords on.
VALIDATION_VOCABULARIES = frozenset(["https://json-schema.org/draft/2019-09/vocab/validation", "https://json-schema.org/draft/2020-12/vocab/validation"])


class SchemaError(ValueError):
    """A document that is no schema."""


class UnresolvedReference(LookupError):
    """A reference whose target is not known."""


class Schema:
    """One node of a plan: ``keywords`` in normal form, or ``boolean``."""

    __slots__ = ("anchors", "base", "boolean", "bound", "catalog", "dialect", "extra", "keywords", "location", "raw", "resource", "validates")

    def __init__(self, raw: Any, base: str, dialect: str, location: str, resource: Schema | None, catalog: Any):
        self.raw, self.base, self.dialect, self.location, self.catalog = raw, base, dialect, location, catalog
        self.resource = resource or self
        self.boolean = raw if isinstance(raw, bool) else None
        self.keywords: dict[str, Any] = {}
        self.extra: dict[str, Any] = {}
        self.anchors: dict[str, tuple[Schema, bool]] = {}
        self.bound: dict[str, Schema | None] = {}
        self.validates = True

    def get(self, keyword: str, default: Any = None) -> Any:
        return self.keywords.get(keyword, default)

    def __contains__(self, keyword: str) -> bool:
        return keyword in self.keywords

    @property
    def draft(self) -> int:
        return DIALECTS.get(self.dialect.rstrip("#"), 2020)

    def children(self) -> Iterator[tuple[str, Schema]]:
        for k, v in self.keywords.items():
            if k in ONE:
                yield k, v
            elif k in MANY:
                yield from ((f"{k}/{i}", s) for i, s in enumerate(v))
            elif k in NAMED:
                yield from ((f"{k}/{n}", s) for n, s in v.items())

    def walk(self) -> Iterator[Schema]:
        yield self
        for _, child in self.children():
            yield from child.walk()

    def target(self, keyword: str) -> Schema | None:
        """What ``$ref`` and its like point at; bound at first use, None while unknown."""
        if self.bound.get(keyword) is None:
            self.bound[keyword] = self.catalog.resolve(self, self.keywords[keyword])
        return self.bound[keyword]

    def __repr__(self) -> str:
        return f"Schema({self.base}#{self.location})"


def _legacy(raw: dict, draft: int) -> dict:
    """A document object in the normal form's vocabulary, its sub-schemas untouched."""
    out = dict(raw)
    if draft == 4 and isinstance(out.get("id"), str):
        out["$id"] = out.pop("id")
    for bound, strict in (("minimum", "exclusiveMinimum"), ("maximum", "exclusiveMaximum")):
        if isinstance(out.get(strict), bool):
            if out.pop(strict) and bound in out:
                out[strict] = out.pop(bound)
    if isinstance(out.get("items"), list):
        out["prefixItems"] = out.pop("items")
        if "additionalItems" in out:
            out["items"] = out["additionalItems"]
    out.pop("additionalItems", None)
    if draft <= 2019 and isinstance(out.get("dependencies"), dict):
        for name, need in out["dependencies"].items():
            group = "dependentRequired" if isinstance(need, list) else "dependentSchemas"
            out[group] = {**out.get(group, {}), name: need}
    if isinstance(out.get("definitions"), dict):
        out["$defs"] = {**out["definitions"], **(out["$defs"] if isinstance(out.get("$defs"), dict) else {})}
    return out


class Builder:
    """Compiles one document; ``resources`` gets every identified part of it."""

    def __init__(self, catalog: Any):
        self.catalog = catalog
        self.resources: dict[str, Schema] = {}
        self.nodes: dict[int, Schema] = {}

    def build(self, raw: Any, base: str, dialect: str, location: str = "", resource: Schema | None = None) -> Schema:
        if not isinstance(raw, (dict, bool)):
            raise SchemaError(f"{base}#{location} is neither an object nor a boolean")
        if isinstance(raw, bool):
            return Schema(raw, base, dialect, location, resource, self.catalog)
        said = raw.get("$schema")
        if isinstance(said, str):
            dialect = said.rstrip("#")
        rules = self.catalog.dialect_of(dialect)
        draft = DIALECTS.get(rules, 2020)
        norm = _legacy(raw, draft)
        alone = draft <= 7 and isinstance(norm.get("$ref"), str)  # $ref hides its siblings
        name = norm.get("$id")
        anchor = norm.get("$anchor")
        if isinstance(name, str) and not alone:
            if draft <= 7 and name.startswith("#"):
                anchor = name[1:]
            else:
                absolute, fragment = urldefrag(urljoin(base, name))
                base, location, resource = absolute, "", None
                if fragment and draft <= 7:
                    anchor = fragment
        node = Schema(raw, base, rules, location, resource, self.catalog)
        self.nodes[id(raw)] = node
        if resource is None:
            self.resources[base] = node
        node.validates = self.catalog.validates(dialect)
        if isinstance(anchor, str):
            node.resource.anchors[anchor] = (node, False)
        if isinstance(norm.get("$dynamicAnchor"), str):
            node.resource.anchors[norm["$dynamicAnchor"]] = (node, True)
        for k, v in norm.items():
            if k not in KNOWN:
                node.extra[k] = v
                continue
            if alone and k not in ("$ref", "$defs") or SINCE.get(k, 0) > draft and not (k == "prefixItems" and isinstance(raw.get("items"), list) or k in ("dependentRequired", "dependentSchemas") and "dependencies" in raw):
                continue
            at = lambda *more, k=k: "/".join([location, _escape(k), *map(_escape, more)])
            sub = lambda value, *more, k=k: self.build(value, base, dialect, at(*more, k=k), node.resource)
            if k in ONE:
                node.keywords[k] = sub(v)
            elif k in MANY:
                if not isinstance(v, list):
                    raise SchemaError(f"{k} is no array")
                node.keywords[k] = [sub(s, str(i)) for i, s in enumerate(v)]
            elif k in NAMED:
                if not isinstance(v, dict):
                    raise SchemaError(f"{k} is no object")
                node.keywords[k] = {n: sub(s, n) for n, s in v.items()}
            else:
                node.keywords[k] = v
        return node


def _escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def pointer(document: Any, fragment: str) -> Iterator[Any]:
    """The values along a JSON pointer, the last its target."""
    here = document
    yield here
    for token in fragment.split("/")[1:]:
        token = unquote(token).replace("~1", "/").replace("~0", "~")
        try:
            here = here[int(token)] if isinstance(here, list) else here[token]
        except (KeyError, IndexError, ValueError, TypeError):
            raise UnresolvedReference(fragment) from None
        yield here


def check_patterns(node: Schema) -> list[tuple[str, str]]:
    """(location, pattern) of every regular expression outside the dialect."""
    bad = []
    for s in node.walk():
        own = [("pattern", s.get("pattern"))] if isinstance(s.get("pattern"), str) else []
        for where, p in own + [(f"patternProperties/{_escape(p)}", p) for p in s.get("patternProperties", {})]:
            try:
                patterns.compiled(p)
            except patterns.InvalidPattern:
                bad.append((f"{s.location}/{where}", p))
    return bad


def marshal(node: Schema) -> str:
    """The document as deterministic JSON text; unknown keywords stay if the catalog preserves them."""
    if node.boolean is not None:
        return numbers.dumps(node.boolean)
    keep = node.catalog.preserve_extra

    def plain(value: Any) -> Any:
        if isinstance(value, Schema):
            return value.boolean if value.boolean is not None else {k: plain(v) for k, v in (value.keywords | (value.extra if keep else {})).items()}
        if isinstance(value, list):
            return [plain(v) for v in value]
        return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value

    return numbers.dumps(plain(node))


def type_names(node: Schema) -> list[str]:
    names = node.get("type", [])
    return [names] if isinstance(names, str) else list(names)


def limit(value: Any) -> int | Decimal | None:
    """A numeric keyword's value, None if it is no number."""
    return numbers.exact(value) if numbers.is_number(value) else None


Loader = Callable[[str], "str | bytes"]
