"""Error lists as column expressions, messages filled in, for plans whose outcome has a fixed shape.

Such a plan looks at the fields of typed rows, field by field; its errors and their order are
those that the evaluator gives.  Others raise ``NotNative``: their invalid rows are explained by
the evaluator.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions import numbers
from pactlake.operators.evaluate import evaluate
from pactlake.operators.native import Check, Native, NotNative, Value, any_of, column
from pactlake.operators.results import MESSAGES
from pactlake.plans.schema import ANNOTATIONS, Schema, limit, type_names

_FLAT = frozenset("type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern format properties required minProperties maxProperties minItems maxItems".split())
_INERT = frozenset(ANNOTATIONS) | frozenset("$schema $id $defs $comment $anchor $dynamicAnchor $vocabulary".split())
_LIMITS = {"minimum": "minimum", "maximum": "maximum", "exclusiveMinimum": "exclusive_minimum", "exclusiveMaximum": "exclusive_maximum"}
_COUNTS = {"minLength": "min_length", "maxLength": "max_length", "minItems": "min_items", "maxItems": "max_items", "minProperties": "min_properties", "maxProperties": "max_properties"}
Text = Column | str


def error(path: str, keyword: str, code: str, params: dict[str, Text], template: str | None = None) -> Column:
    """An error with its message."""
    parts = re.split(r"\{(\w+)\}", template or MESSAGES[code])
    texts = [F.lit(t) if i % 2 == 0 else F.coalesce(p, F.lit("")) if isinstance(p := params.get(t, "{" + t + "}"), Column) else F.lit(p) for i, t in enumerate(parts) if i % 2 or t]
    return F.struct(F.lit(path).alias("path"), F.lit(keyword).alias("keyword"), F.lit(code).alias("code"), F.concat(*texts).alias("message"))


def plain(text: Column) -> Column:
    """The text of a number without exponent and trailing zeros."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.split_part(F.regexp_replace(text, "^-", ""), F.lit("E"), F.lit(1))
    power = F.when(text.contains("E"), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")).otherwise(F.lit(0))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    ahead = F.char_length(F.split_part(mantissa, F.lit("."), F.lit(1))) + power  # digits before the point
    whole = F.when(ahead <= 0, F.lit("0")).otherwise(F.rpad(F.substr(digits, F.lit(1), F.greatest(ahead, F.lit(0))), F.greatest(ahead, F.lit(0)), "0"))
    part = F.when(ahead <= 0, F.concat(F.repeat(F.lit("0"), F.greatest(-ahead, F.lit(0))), digits)).otherwise(F.substr(digits, ahead + 1))
    shown = F.regexp_replace(whole, r"^0+(?=\d)", "")
    made = F.when(part == "", shown).otherwise(F.concat(shown, F.lit("."), part))
    usual = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    return F.when(~text.rlike("^[^E]*[1-9]"), F.lit("0")).when(~text.contains("E"), usual).otherwise(F.concat(sign, made))


def said(v: Value) -> Column:
    """A value as the messages give it."""
    if v.type_name == "number":
        return plain(v.col.cast("string"))
    return v.string().cast("string") if v.type_name == "string" else v.col.cast("string")


def told(native: Native, node: Schema, v: Value, path: str = "") -> list[tuple[Check, Column]]:
    """(check, error if it fails) of a node and of the fields below, in the evaluator's order."""
    if node.boolean is True:
        return []
    odd = set(node.keywords) - _FLAT - _INERT
    if node.boolean is False or odd or native.null_means != "absent" or isinstance(v.kind, (T.VariantType, T.MapType, T.BinaryType, T.NullType)):
        raise NotNative("errors that need the outcome tree")
    props: dict[str, Schema] = node.get("properties", {})
    fields = isinstance(v.kind, T.StructType)
    if fields and any(v.kind[n].metadata.get("json") for n in v.kind.fieldNames()):
        raise NotNative("renamed fields")
    names = [n for n in v.kind.fieldNames()] if fields else []
    out = []
    for keyword, code, check in native.checks(node, v):
        if keyword == "properties":
            out.append(_fields(native, node, v, path, props, names))
        elif keyword == "required":
            lacking = _joined([(n, native._present(n, v) if n in names else False) for n in node.get("required")])
            code = ("required_missing", "required_missing") if native.struct_mode else ("missing_required_property", "missing_required_properties")
            out.append((check, _one_or_more(path, "required", *code, lacking, MESSAGES["missing_required_properties"])))
        else:
            out.append((check, error(path, keyword, code, _params(node, v, keyword))))
    out = [(c, e) for c, e in out if c is not True]
    required = node.get("required") if node.validates and isinstance(node.get("required"), list) else []
    for name, s in props.items() if fields else ():
        if name in names:
            col = v.col[name]
            out += [(any_of([col.isNull(), c]), e) for c, e in told(native, s, Value(col, v.kind[name].dataType), f"{path}/{name}")]
        if name in required and not native.struct_mode and s.get("default") is None:
            there = native._present(name, v) if name in names else False
            out += [(there, error(f"{path}/{name}{at}", e.keyword, e.code, dict(e.params))) for at, e in evaluate(s, None).flat()]
    return out


def _fields(native: Native, node: Schema, v: Value, path: str, props: dict[str, Schema], names: list[str]) -> tuple[Check, Column]:
    checks: list[tuple[str, Check]] = []
    required = node.get("required") if node.validates and isinstance(node.get("required"), list) else []
    for n, s in sorted(props.items()):
        own = native.field(s, v, n) if n in names else True
        if n in required and not native.struct_mode and s.get("default") is None and not evaluate(s, None).valid:
            there = native._present(n, v) if n in names else False
            own = there if own is True else (there & own if isinstance(there, Column) and isinstance(own, Column) else False)
        if own is not True:
            checks.append((n, own))
    bad = _joined(checks)
    ok = reduce(lambda a, b: a & b, [F.coalesce(column(c), F.lit(False)) for _, c in checks]) if checks else True
    return ok, _one_or_more(path, "properties", "property_mismatch", "properties_mismatch", bad)


def _joined(checks: list[tuple[str, Check]]) -> Column:
    """The names whose checks fail."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(column(c), F.lit(False)), F.lit(n)) for n, c in checks]))


def _one_or_more(path: str, keyword: str, one: str, many: str, bad: Column, plural: str | None = None) -> Column:
    text = F.array_join(bad, ", ")
    several = error(path, keyword, many, {"properties": text}, plural)
    return F.when(F.size(bad) > 1, several).otherwise(error(path, keyword, one, {"property": text}))


def _params(node: Schema, v: Value, keyword: str) -> dict[str, Text]:
    own = node.get(keyword)
    if keyword == "type":
        kind: Text = v.type_name
        if kind == "number":
            kind = F.when(v.is_type("integer"), F.lit("integer")).otherwise(F.lit("number"))
        return {"received": kind, "expected": ", ".join(type_names(node))}
    if keyword == "enum":
        if v.type_name in ("object", "array"):
            raise NotNative("nested values in a message")
        return {"received": said(v), "expected": numbers.dumps(own)}
    if keyword in _LIMITS:
        return {_LIMITS[keyword]: numbers.number_text(limit(own)), "value": said(v)}
    if keyword == "multipleOf":
        return {"divisor": numbers.number_text(limit(own)), "value": said(v)}
    if keyword in _COUNTS:
        return {_COUNTS[keyword]: numbers.dumps(limit(own))}
    return {keyword: own} if keyword in ("pattern", "format") else {}


def listed(native: Native, node: Schema, v: Value) -> list[Any]:
    """The errors as columns, NULL where a check holds."""
    return [F.when(~F.coalesce(column(c), F.lit(False)), e) for c, e in told(native, node, v)]
