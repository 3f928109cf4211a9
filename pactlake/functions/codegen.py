"""Python modules from row types: a builder function and a ``StructType`` for each.

``python -m pactlake.functions.codegen types.json -o schemas.py`` reads an object of named types,
each the JSON form of a ``StructType`` or a DDL string, with rules in field metadata.  A struct
field whose type is another named type becomes a reference to it; functions stand in the order of
their dependencies, and types that contain one another through references are written as well.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from pactlake.functions import builders
from pactlake.functions.inference import Document, from_struct_type

_ONE, _MANY, _NAMED = frozenset("not if then else items contains additionalProperties propertyNames unevaluatedItems unevaluatedProperties contentSchema".split()), ("allOf", "anyOf", "oneOf", "prefixItems"), ("properties", "patternProperties", "dependentSchemas", "$defs")
_TYPES = {"string": "string", "integer": "integer", "number": "number", "boolean": "boolean", "null": "null", "array": "array", "object": "object_"}
_COMBINED = {"allOf": "all_of", "anyOf": "any_of", "oneOf": "one_of"}


def _keyword_names() -> dict[str, str]:
    """The builder of each keyword that has one, found by calling it."""
    out: dict[str, str] = {}
    for name, made in vars(builders).items():
        if callable(made) and getattr(made, "__name__", "") == "<lambda>" and name.islower() and not name.startswith("_"):
            try:
                made(0)(doc := {})
            except TypeError:
                continue
            if len(doc) == 1:
                out.setdefault(next(iter(doc)), name)
    return out


_KEYWORDS = _keyword_names()


def source(doc: Document | bool) -> str:
    """A builder expression that gives the document again."""
    if isinstance(doc, bool):
        return repr(doc)
    rest = dict(doc)
    if set(rest) == {"$ref"}:
        return f"B.ref({rest['$ref']!r})"
    if len(rest) == 1 and (only := next(iter(rest))) in _COMBINED:
        return f"B.{_COMBINED[only]}({', '.join(map(source, rest[only]))})"
    kind = rest.pop("type", None)
    call = "any_" if not isinstance(kind, str) else _TYPES[kind]
    parts = []
    if call == "object_":
        parts += [f"B.prop({n!r}, {source(s)})" for n, s in rest.pop("properties", {}).items()]
    extra = {} if isinstance(kind, str) or kind is None else {"type": repr(kind)}
    for k, v in rest.items():
        name = _KEYWORDS.get(k)
        values = f"*{_value(k, v)}" if k in ("required", "examples", "prefixItems") else _value(k, v)
        if name is None:
            extra[k] = _value(k, v)
        else:
            parts.append(f"B.{name}({values})")
    made = f"B.{call}({', '.join(parts)})"
    return f"{made} | {{{', '.join(f'{k!r}: {v}' for k, v in extra.items())}}}" if extra else made


def _value(keyword: str, value: Any) -> str:
    if keyword in _ONE:
        return source(value)
    if keyword in _MANY:
        return f"[{', '.join(map(source, value))}]"
    if keyword in _NAMED:
        return f"{{{', '.join(f'{n!r}: {source(s)}' for n, s in value.items())}}}"
    return repr(value)


def _with_references(doc: Any, own: str, known: dict[str, str]) -> Any:
    """The document with parts that are another named type's replaced by references."""
    if isinstance(doc, dict):
        name = known.get(json.dumps(doc, sort_keys=True))
        if name and name != own:
            return {"$ref": f"#/$defs/{name}"}
        return {k: _with_references(v, own, known) for k, v in doc.items()}
    return [_with_references(v, own, known) for v in doc] if isinstance(doc, list) else doc


def needed(doc: Any) -> set[str]:
    """The named types that a document refers to."""
    if isinstance(doc, dict):
        own = {doc["$ref"].removeprefix("#/$defs/")} if str(doc.get("$ref", "")).startswith("#/$defs/") else set()
        return own.union(*map(needed, doc.values())) if doc else own
    return set().union(*map(needed, doc)) if isinstance(doc, list) else set()


def ordered(docs: dict[str, Document]) -> list[str]:
    """Names after those that they need; a cycle is broken at its first name."""
    out: list[str] = []

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in out or name in trail or name not in docs:
            return
        for other in sorted(needed(docs[name])):
            visit(other, (*trail, name))
        out.append(name)

    for name in sorted(docs):
        visit(name, ())
    return out


def _closure(name: str, docs: dict[str, Document]) -> list[str]:
    seen, todo = [], sorted(needed(docs[name]))
    while todo:
        n = todo.pop(0)
        if n in docs and n not in seen:
            seen.append(n)
            todo += sorted(needed(docs[n]))
    return sorted(seen)


def module(types: dict[str, T.StructType], **options: Any) -> str:
    """The source of a module with ``<name>_schema()`` and ``<NAME>`` for each type."""
    plain = {n: {k: v for k, v in from_struct_type(t, **options).items() if k != "$schema"} for n, t in types.items()}
    known = {json.dumps(d, sort_keys=True): n for n, d in sorted(plain.items(), reverse=True)}
    docs = {n: {k: _with_references(v, n, known) for k, v in d.items()} for n, d in plain.items()}
    lines = ['"""Made from row types; do not edit."""', "", "from pyspark.sql.types import StructType", "", "from pactlake.functions import builders as B", ""]
    for name in ordered(docs):
        lines += ["", f"def {name}_part():", f"    return {source(docs[name])}", ""]
    for name in sorted(docs):
        defs = ", ".join(f"{n!r}: {n}_part()" for n in sorted({*_closure(name, docs)}))
        lines += ["", f"def {name}_schema():", f"    return {name}_part()" + (f" | {{'$defs': {{{defs}}}}}" if defs else ""), ""]
    lines += [""] + [f"{n.upper()} = StructType.fromJson({types[n].jsonValue()!r})" for n in sorted(types)]
    return "\n".join(lines) + "\n"


def read(path: str) -> dict[str, T.StructType]:
    return {n: T.StructType.fromDDL(t) if isinstance(t, str) else T.StructType.fromJson(t) for n, t in json.loads(Path(path).read_text()).items()}


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codegen", description=__doc__.split("\n")[0])
    p.add_argument("types", help="JSON object of named types")
    p.add_argument("-o", "--out", help="module to write; without it the source is printed")
    p.add_argument("--rules", default="rules", help="metadata key that holds the rules")
    p.add_argument("--check", action="store_true", help="fail if the module differs, and write nothing")
    a = p.parse_args(arguments)
    text = module(read(a.types), rules=a.rules)
    if a.out is None:
        print(text, end="")
    elif a.check:
        return int(not Path(a.out).exists() or Path(a.out).read_text() != text)
    else:
        Path(a.out).write_text(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
