"""The native compiler: plans as column expressions over typed columns or VARIANT.

Everything it emits stays inside Catalyst: predicates over typed columns are written as
``x IS NULL OR check`` so that they reach the Parquet scan, references are inlined, and a
plan that needs run-time state (recursion, dynamic scope, evaluated sets that depend on
branches) or functions without an exact column form raises ``NotNative``; the general evaluator takes those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions import formats, numbers, patterns
from pactlake.operators.evaluate import evaluate
from pactlake.plans.schema import Schema, limit, type_names

#: Keyword checks in one expression at most; larger plans are evaluated generally, with the same results.
MOST_CHECKS = 400
_ANY_BRANCH = ("$ref", "allOf", "anyOf", "oneOf", "if", "dependentSchemas", "unevaluatedProperties", "unevaluatedItems", "contains")
Check = Column | bool


class NotNative(Exception):
    """The plan, or a part of it, has no column form."""


def all_of(checks: list[Check]) -> Check:
    if any(c is False for c in checks):
        return False
    open_ = [c for c in checks if c is not True]
    return reduce(lambda a, b: a & b, open_) if open_ else True


def any_of(checks: list[Check]) -> Check:
    if any(c is True for c in checks):
        return True
    open_ = [c for c in checks if c is not False]
    return reduce(lambda a, b: a | b, open_) if open_ else False


def negate(c: Check) -> Check:
    return not c if isinstance(c, bool) else ~c


def column(c: Check) -> Column:
    return F.lit(c) if isinstance(c, bool) else c


def several(one: str, many: str, checks: list[Check]) -> str | tuple[str, str, Column]:
    """The code for one failed check, or for more of them."""
    open_ = [F.coalesce(c, F.lit(False)) if isinstance(c, Column) else F.lit(c) for c in checks if c is not True]
    if len(open_) < 2:
        return one
    return one, many, reduce(lambda a, b: a + b, [(~c).cast("int") for c in open_]) > 1


def unless(guard: Check, c: Check) -> Check:
    """c where the guard does not hold, else true."""
    return True if c is True else any_of([guard, c])


@dataclass(frozen=True)
class Value:
    """A column that holds the value, known not to be NULL, and its type."""

    col: Column
    kind: T.DataType

    @property
    def variant(self) -> bool:
        return isinstance(self.kind, T.VariantType)

    @property
    def type_name(self) -> str:
        k = self.kind
        if isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer"
        if isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "number"
        if isinstance(k, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "string"
        if isinstance(k, T.BooleanType):
            return "boolean"
        if isinstance(k, T.ArrayType):
            return "array"
        if isinstance(k, T.StructType) or isinstance(k, T.MapType) and isinstance(k.keyType, T.StringType):
            return "object"
        return "null" if isinstance(k, T.NullType) else "unknown"

    # VARIANT parts: each is NULL where the value is of another type.

    def said(self) -> Column:
        return F.schema_of_variant(self.col)

    def is_type(self, name: str) -> Check:
        """Whether the value is of a JSON type (``number`` here includes integers)."""
        if not self.variant:
            own = self.type_name
            if own == "number" and name == "integer":
                n = self.number()
                return n == F.floor(n)
            return own == name or own == "integer" and name == "number"
        s = self.said()
        if name == "object":
            return s.startswith("OBJECT")
        if name == "array":
            return s.startswith("ARRAY")
        if name in ("number", "integer"):
            num = s.startswith("DECIMAL") | s.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
            n = self.number()
            return num if name == "number" else num & F.coalesce(n == F.floor(n), F.lit(False))
        return s == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]

    def number(self) -> Column:
        """The number, exact as far as 38 digits go."""
        if self.variant:
            exact = F.try_variant_get(self.col, "$", "decimal(38,12)")
            wide = F.try_variant_get(self.col, "$", "double")
            is_double = self.said().isin("DOUBLE", "FLOAT")
            return F.when(is_double, F.coalesce(wide.cast("string").try_cast("decimal(38,12)"), F.lit(None).cast("decimal(38,12)"))).otherwise(exact)
        return self.col

    def string(self) -> Column:
        if self.variant:
            return F.try_variant_get(self.col, "$", "string")
        if isinstance(self.kind, T.TimestampType):
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ssXXX")
        if isinstance(self.kind, T.TimestampNTZType):
            return F.concat(F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
        return self.col.cast("string") if isinstance(self.kind, T.DateType) else self.col

    def array(self) -> tuple[Column, T.DataType]:
        if self.variant:
            return F.try_variant_get(self.col, "$", "array<variant>"), T.VariantType()
        return self.col, self.kind.elementType

    def map(self) -> tuple[Column, T.DataType]:
        if self.variant:
            return F.try_variant_get(self.col, "$", "map<string,variant>"), T.VariantType()
        return self.col, self.kind.valueType


@dataclass
class Native:
    """Compiles plan nodes.

    struct_mode: typed rows follow the rules for structures: an empty string or collection counts
    as missing.  null_means: what a NULL field of a typed row stands for, "absent" or "null".
    """

    catalog: Any
    struct_mode: bool = False
    null_means: str = "absent"
    active: tuple[int, ...] = ()
    spent: list[int] = field(default_factory=lambda: [0])

    def holds(self, node: Schema, v: Value) -> Check:
        """Whether a value that is there satisfies a node."""
        return all_of([c for _, _, c in self.checks(node, v)])

    def checks(self, node: Schema, v: Value) -> list[tuple[str, Any, Check]]:
        """(keyword, code, check) of each keyword of a node, in order."""
        if node.boolean is not None:
            return [("schema", "false_schema_mismatch", node.boolean)]
        if id(node) in self.active:
            raise NotNative("recursion")
        if "$dynamicRef" in node or "$recursiveRef" in node:
            raise NotNative("dynamic scope")
        inner = replace(self, active=(*self.active, id(node)))
        out: list[tuple[str, Any, Check]] = []
        if "$ref" in node:
            target = node.target("$ref")
            if target is not None:
                out.append(("$ref", "ref_mismatch", inner.holds(target, v)))
            if node.draft <= 7:
                return out
        if node.validates:
            out += inner._any_type(node, v)
        out += inner._combined(node, v)
        for name, build in (("array", inner._array), ("number", inner._number), ("string", inner._string), ("object", inner._object)):
            guard = v.is_type(name)
            if name == "object" and self.catalog.assert_format and isinstance(f := node.get("format"), str) and f not in self.catalog.custom_formats and f not in formats.FORMATS:
                out.append(("format", "unknown_format", False))
            if guard is not False:
                out += [(k, c, unless(negate(guard), check)) for k, c, check in build(node, v)]
        out = [(k, c, check if isinstance(check, bool) else F.coalesce(check, F.lit(False)) if v.variant else check) for k, c, check in out if check is not True]
        self.spent[0] += len(out)
        if self.spent[0] > MOST_CHECKS:
            raise NotNative("the plan is too large for one expression")
        return out

    def _any_type(self, node: Schema, v: Value) -> list:
        out = []
        if names := type_names(node):
            out.append(("type", "type_mismatch", any_of([v.is_type(n) for n in names])))
        if isinstance(node.get("enum"), list) and node.get("enum"):
            out.append(("enum", "value_not_in_enum", self._one_of(node.get("enum"), v)))
        if "const" in node:
            out.append(("const", "const_mismatch_null" if node.get("const") is None else "const_mismatch", self._one_of([node.get("const")], v)))
        return out

    def _one_of(self, candidates: list, v: Value) -> Check:
        by: dict[str, list] = {}
        for c in candidates:
            kind = numbers.json_type(c)
            by.setdefault("number" if kind == "integer" else kind, []).append(c)
        checks: list[Check] = []
        for kind, values in by.items():
            guard = v.is_type(kind)
            if guard is False:
                continue
            if kind in ("array", "object", "unknown"):
                raise NotNative("nested constants")
            if kind == "null":
                checks.append(guard)
            elif kind == "boolean":
                b = F.try_variant_get(v.col, "$", "boolean") if v.variant else v.col
                checks.append(all_of([guard, b.isin(values)]))
            elif kind == "number":
                checks.append(all_of([guard, any_of([self._compare(v, c, lambda a, b: a == b) for c in values])]))
            else:
                checks.append(all_of([guard, v.string().isin(values)]))
        return any_of(checks)

    def _compare(self, v: Value, bound: Any, how: Callable[[Column, Any], Column]) -> Check:
        bound = numbers.exact(bound)
        if isinstance(v.kind, (T.DoubleType, T.FloatType)):
            if Decimal(repr(float(bound))) != bound:
                raise NotNative("a limit that is no double")
            # Shortest texts of doubles keep their order; a float is its shortest text.
            return how(v.col.cast("string").cast("double") if isinstance(v.kind, T.FloatType) else v.col, F.lit(float(bound)))
        if abs(bound) >= 10**25 or isinstance(bound, Decimal) and -bound.as_tuple().exponent > 12:
            raise NotNative("a limit beyond 38 digits")
        if isinstance(bound, int) and -(2**63) <= bound < 2**63 and not v.variant:
            return how(v.col, F.lit(bound))
        return how(v.number(), F.lit(Decimal(bound)).cast("decimal(38,12)" if v.variant else "decimal(38,10)"))

    def _number(self, node: Schema, v: Value) -> list:
        if not node.validates:
            return []
        out = []
        if (d := limit(node.get("multipleOf"))) is not None:
            if d <= 0:
                out.append(("multipleOf", "invalid_multiple_of", False))
            elif v.type_name == "integer" and not v.variant and isinstance(d, int):
                out.append(("multipleOf", "not_multiple_of", v.col % F.lit(d) == 0))
            else:
                scale = max(12 if v.variant else 10, -d.as_tuple().exponent if isinstance(d, Decimal) else 0)
                if scale > (12 if v.variant else 18) or abs(d) >= 10**18:
                    raise NotNative("a divisor with many digits")
                kind = f"decimal(38,{scale})"
                n = v.number() if v.variant else v.col.cast("string").try_cast(kind)
                whole: Check = n % F.lit(Decimal(d)).cast(kind) == 0
                if isinstance(v.kind, (T.DoubleType, T.FloatType, T.DecimalType)):
                    # What is rounded has more decimals than the divisor; what is too large is told by its text.
                    own = v.col.cast("string")
                    wide = F.when(n.isNull(), _large_multiple(own, d)).otherwise(F.lit(False))
                    whole = F.coalesce((n == v.col if isinstance(v.kind, T.DecimalType) else n.cast(v.kind) == v.col) & whole, wide)
                out.append(("multipleOf", "not_multiple_of", whole))
        for k, code, how in (
            ("minimum", "value_below_minimum", lambda a, b: a >= b),
            ("maximum", "value_above_maximum", lambda a, b: a <= b),
            ("exclusiveMinimum", "exclusive_minimum_mismatch", lambda a, b: a > b),
            ("exclusiveMaximum", "exclusive_maximum_mismatch", lambda a, b: a < b),
        ):
            if (bound := limit(node.get(k))) is not None:
                out.append((k, code, self._compare(v, bound, how)))
        return out

    def _string(self, node: Schema, v: Value) -> list:
        out = []
        s = v.string()
        if node.validates:
            if (most := limit(node.get("maxLength"))) is not None:
                out.append(("maxLength", "string_too_long", F.char_length(s) <= int(most)))
            if (least := limit(node.get("minLength"))) is not None:
                out.append(("minLength", "string_too_short", F.char_length(s) >= int(least)))
            if isinstance(p := node.get("pattern"), str):
                try:
                    out.append(("pattern", "pattern_mismatch", s.rlike(patterns.java(p))))
                except patterns.InvalidPattern:
                    out.append(("pattern", "invalid_pattern", False))
        if self.catalog.assert_format and isinstance(name := node.get("format"), str):
            if name in self.catalog.custom_formats:
                raise NotNative("a custom format")
            if name in formats.COLUMNS:
                out.append(("format", "format_mismatch", formats.COLUMNS[name](s)))
            elif name in formats.FORMATS:
                raise NotNative(f"format {name}")
        return out + self._content(node, s)

    def _content(self, node: Schema, s: Column) -> list:
        encoding, media = node.get("contentEncoding"), node.get("contentMediaType")
        if encoding is None and media is None and "contentSchema" not in node:
            return []
        if encoding not in (None, "base64") or media not in (None, "application/json"):
            raise NotNative("content beyond base64 and JSON")
        out = []
        raw = F.try_to_binary(s, F.lit("base64")) if encoding else None
        if encoding:
            out.append(("contentEncoding", "invalid_encoding", raw.isNotNull()))
        parsed = F.try_parse_json(raw.cast("string") if encoding else s)
        if media:
            out.append(("contentMediaType", "invalid_media_type", unless(raw.isNull(), parsed.isNotNull()) if encoding else parsed.isNotNull()))
        if "contentSchema" in node:
            if not media:
                raise NotNative("content without a media type")
            inner = self.holds(node.get("contentSchema"), Value(parsed, T.VariantType()))
            out.append(("contentSchema", "content_schema_mismatch", unless(parsed.isNull(), inner)))
        return out

    def _combined(self, node: Schema, v: Value) -> list:
        out = []
        if node.get("allOf"):
            out.append(("allOf", "all_of_item_mismatch", all_of([self.holds(s, v) for s in node.get("allOf")])))
        if node.get("anyOf"):
            out.append(("anyOf", "any_of_item_mismatch", any_of([self.holds(s, v) for s in node.get("anyOf")])))
        if node.get("oneOf"):
            good = reduce(lambda a, b: a + b, [F.coalesce(column(self.holds(s, v)), F.lit(False)).cast("int") for s in node.get("oneOf")])
            out.append(("oneOf", ("one_of_item_mismatch", "one_of_multiple_matches", good > 1), good == 1))
        if "not" in node:
            out.append(("not", "not_schema_mismatch", negate(self.holds(node.get("not"), v))))
        if "if" in node:
            met = self.holds(node.get("if"), v)
            if "then" in node:
                out.append(("then", "if_then_mismatch", unless(negate(met), self.holds(node.get("then"), v))))
            if "else" in node:
                out.append(("else", "if_else_mismatch", unless(met, self.holds(node.get("else"), v))))
        return out

    def element(self, node: Schema, kind: T.DataType) -> Callable[[Column], Column]:
        """A predicate for the elements of an array or map, where NULL is JSON null."""
        of_null = evaluate(node, None).valid

        def check(x: Column) -> Column:
            c = self.holds(node, Value(x, kind))
            return column(c) if isinstance(c, bool) and c == of_null else F.when(x.isNull(), F.lit(of_null)).otherwise(column(c))

        return check

    def _array(self, node: Schema, v: Value) -> list:
        out = []
        arr, kind = v.array()
        prefix = node.get("prefixItems", [])
        if prefix:
            one = [unless(F.size(arr) <= i, self.element(s, kind)(F.get(arr, F.lit(i)))) for i, s in enumerate(prefix) if s.boolean is not True]
            out.append(("prefixItems", several("prefix_item_mismatch", "prefix_items_mismatch", one), all_of(one)))
        if "items" in node and node.get("items").boolean is not True:
            rest = F.slice(arr, len(prefix) + 1, F.greatest(F.size(arr) - len(prefix), F.lit(0))) if prefix else arr
            s = node.get("items")
            out.append(("items", "item_mismatch", F.size(arr) <= len(prefix) if s.boolean is False else F.forall(rest, self.element(s, kind))))
        if "contains" in node:
            n = F.size(F.filter(arr, self.element(node.get("contains"), kind)))
            low, high = limit(node.get("minContains")), limit(node.get("maxContains"))
            out.append(("minContains", "contains_too_few_items", n >= F.lit(float(1 if low is None else low))))
            if high is not None:
                out.append(("maxContains", "contains_too_many_items", n <= F.lit(float(high))))
        if node.validates:
            if (most := limit(node.get("maxItems"))) is not None:
                out.append(("maxItems", "items_too_long", F.size(arr) <= F.lit(float(most))))
            if (least := limit(node.get("minItems"))) is not None:
                out.append(("minItems", "items_too_short", F.size(arr) >= F.lit(float(least))))
            if node.get("uniqueItems") is True:
                if v.variant or _unorderable(kind):
                    raise NotNative("uniqueness of nested values")
                own = F.slice(arr, 1, len(prefix)) if "items" in node and node.get("items").boolean is False and prefix else arr
                if not ("items" in node and node.get("items").boolean is False and not prefix):
                    out.append(("uniqueItems", "unique_items_mismatch", F.size(F.array_distinct(own)) == F.size(own)))
        if "unevaluatedItems" in node:
            if any(k in node for k in _ANY_BRANCH if k != "unevaluatedItems"):
                raise NotNative("evaluated items that depend on branches")
            if "items" not in node:
                s = node.get("unevaluatedItems")
                if s.boolean is None and any(k in x for x in s.walk() for k in ("prefixItems", "items", "contains", "unevaluatedItems", "$ref")):
                    raise NotNative("evaluated items that depend on items")
                rest = F.slice(arr, len(prefix) + 1, F.greatest(F.size(arr) - len(prefix), F.lit(0)))
                out.append(("unevaluatedItems", "unevaluated_items_not_allowed" if s.boolean is False else "unevaluated_item_mismatch", F.forall(rest, self.element(s, kind))))
        return out

    def _object(self, node: Schema, v: Value) -> list:
        if "unevaluatedProperties" in node and any(k in node for k in _ANY_BRANCH if k != "unevaluatedProperties"):
            raise NotNative("evaluated properties that depend on branches")
        return self._struct(node, v) if isinstance(v.kind, T.StructType) else self._map(node, v)

    def _present(self, name: str, v: Value) -> Check:
        f = v.kind[name]
        if self.null_means == "null":
            return True
        there: Check = v.col[name].isNotNull()
        if self.struct_mode:
            if isinstance(f.dataType, T.StringType):
                return there & (v.col[name] != "")
            if isinstance(f.dataType, (T.ArrayType, T.MapType)):
                return there & (F.size(v.col[name]) > 0)
        return there

    def field(self, node: Schema, v: Value, name: str) -> Check:
        """A field of a typed row against a node; an absent field holds."""
        col = v.col[name]
        c = self.holds(node, Value(col, v.kind[name].dataType))
        if self.null_means == "null":
            of_null = evaluate(node, None).valid
            return c if c is of_null else F.when(col.isNull(), F.lit(of_null)).otherwise(column(c))
        return c if c is True else any_of([col.isNull(), c])

    def _marked(self, node: Schema, names: list[str], active: tuple[int, ...] = ()) -> set[str]:
        """Names that references and ``allOf`` have looked at: for structures they are not additional."""
        out: set[str] = set()
        targets = [node.target("$ref")] if isinstance(node.get("$ref"), str) else []
        for s in (*targets, *node.get("allOf", [])):
            if s is not None and s.boolean is None and id(s) not in active:
                found = [patterns.compiled(p) for p in s.get("patternProperties", {})]
                out |= set(names) if "additionalProperties" in s or "unevaluatedProperties" in s else {n for n in names if n in s.get("properties", {}) or any(p.search(n) for p in found)}
                out |= self._marked(s, names, (*active, id(s)))
        return out

    def _struct(self, node: Schema, v: Value) -> list:
        names = [n for n in v.kind.fieldNames() if v.kind[n].metadata.get("json") != "-"]
        props, found = node.get("properties", {}), node.get("patternProperties", {})
        required = node.get("required") if node.validates and isinstance(node.get("required"), list) else []
        out = []
        checks = [self.field(s, v, n) for n, s in props.items() if n in names]
        if not self.struct_mode:
            for n, s in props.items():
                if n in required and s.get("default") is None and not evaluate(s, None).valid:
                    checks.append(self._present(n, v) if n in names else False)
        out.append(("properties", "property_mismatch" if self.struct_mode else several("property_mismatch", "properties_mismatch", checks), all_of(checks)))
        match = {n: [s for p, s in found.items() if patterns.compiled(p).search(n)] for n in names}
        skip = set(props) if self.struct_mode else set()
        own = [all_of([self.field(s, v, n) for s in match[n]]) for n in names if n not in skip]
        out.append(("properties", several("pattern_property_mismatch", "pattern_properties_mismatch", own), all_of(own)))
        marked = self._marked(node, names) if self.struct_mode else set()
        rest = [n for n in names if n not in props and not match[n] and n not in marked]
        for k, one, many in (("additionalProperties", "additional_property_mismatch", "additional_properties_mismatch"), ("unevaluatedProperties", "unevaluated_property_mismatch", "unevaluated_properties_mismatch")):
            if k in node and not (k == "unevaluatedProperties" and "additionalProperties" in node):
                own = [self.field(node.get(k), v, n) for n in rest]
                out.append(("additionalProperties" if k[0] == "a" else "properties", several(one, many, own), all_of(own)))
        if "propertyNames" in node:
            bad = [n for n in names if not evaluate(node.get("propertyNames"), n).valid]
            own = [negate(self._present(n, v)) for n in bad]
            out.append(("propertyNames", several("property_name_mismatch", "property_names_mismatch", own), all_of(own)))
        if not node.validates:
            return out
        there = lambda n: self._present(n, v) if n in names else False
        most, least = limit(node.get("maxProperties")), limit(node.get("minProperties"))
        if most is not None or least is not None:
            n = reduce(lambda a, b: a + b, [column(there(x)).cast("int") for x in names])
            if most is not None:
                out.append(("maxProperties", "too_many_properties", n <= F.lit(float(most))))
            if least is not None:
                out.append(("minProperties", "too_few_properties", n >= F.lit(float(least))))
        if required:
            need = [there(n) for n in required]
            out.append(("required", "required_missing" if self.struct_mode else several("missing_required_property", "missing_required_properties", need), all_of(need)))
        if isinstance(node.get("dependentRequired"), dict):
            deps = [unless(negate(there(k)), all_of([there(x) for x in xs])) for k, xs in node.get("dependentRequired").items()]
            out.append(("dependentRequired", "dependent_required_missing" if self.struct_mode else "dependent_property_required", all_of(deps)))
        for k, s in node.get("dependentSchemas", {}).items():
            out.append(("dependentSchemas", "dependent_schema_mismatch", unless(negate(there(k)), self.holds(s, v))))
        return out

    def _map(self, node: Schema, v: Value) -> list:
        m, kind = v.map()
        keys = F.map_keys(m)
        props, found = node.get("properties", {}), node.get("patternProperties", {})
        required = node.get("required") if node.validates and isinstance(node.get("required"), list) else []
        has = lambda k: F.array_contains(keys, k)
        value = lambda k: F.try_variant_get(v.col, f"$['{k}']", "variant") if v.variant and "'" not in k else F.element_at(m, k)
        out = []
        checks: list[Check] = [unless(~has(k), self.element(s, kind)(value(k))) for k, s in props.items() if s.boolean is not True]
        checks += [has(k) for k, s in props.items() if k in required and s.get("default") is None and not evaluate(s, None).valid]
        out.append(("properties", several("property_mismatch", "properties_mismatch", checks), all_of(checks)))
        java = {p: patterns.java(p) for p in found}

        def pick(keep: Callable[[Column], Column], s: Schema) -> Check:
            if s.boolean is not None:
                return True if s.boolean else ~F.exists(keys, keep)
            check = self.element(s, kind)
            return F.forall(F.map_values(F.map_filter(m, lambda k, _: keep(k))), check)

        def more(keep: Callable[[Column], Column], s: Schema) -> Column:
            """Whether more than one of the keys that are kept fails."""
            if s.boolean is not None:
                return F.size(F.filter(keys, keep)) > 1
            check = self.element(s, kind)
            return F.size(F.map_filter(m, lambda k, x: keep(k) & ~F.coalesce(check(x), F.lit(False)))) > 1

        one_p = ("pattern_property_mismatch", "pattern_properties_mismatch")
        pattern_code = (*one_p, more(_like(next(iter(java.values()))), next(iter(found.values())))) if len(found) == 1 else one_p[0]
        out.append(("properties", pattern_code, all_of([pick(_like(java[p]), s) for p, s in found.items()])))

        def rest(k: Column) -> Column:
            c: Column = ~k.isin(list(props)) if props else F.lit(True)
            for p in java.values():
                c = c & ~k.rlike(p)
            return c

        for k, keyword, one, many in (("additionalProperties", "additionalProperties", "additional_property_mismatch", "additional_properties_mismatch"), ("unevaluatedProperties", "properties", "unevaluated_property_mismatch", "unevaluated_properties_mismatch")):
            if k in node and not (k == "unevaluatedProperties" and "additionalProperties" in node):
                out.append((keyword, (one, many, more(rest, node.get(k))), pick(rest, node.get(k))))
        if "propertyNames" in node:
            named = lambda k: column(self.holds(node.get("propertyNames"), Value(k, T.StringType())))
            out.append(("propertyNames", ("property_name_mismatch", "property_names_mismatch", F.size(F.filter(keys, lambda k: ~named(k))) > 1), F.forall(keys, named)))
        if not node.validates:
            return out
        if (most := limit(node.get("maxProperties"))) is not None:
            out.append(("maxProperties", "too_many_properties", F.size(keys) <= F.lit(float(most))))
        if (least := limit(node.get("minProperties"))) is not None:
            out.append(("minProperties", "too_few_properties", F.size(keys) >= F.lit(float(least))))
        if required:
            lacking = F.size(F.array_except(F.array(*map(F.lit, required)), keys))
            out.append(("required", ("missing_required_property", "missing_required_properties", lacking > 1), lacking == 0))
        if isinstance(node.get("dependentRequired"), dict):
            out.append(("dependentRequired", "dependent_property_required", all_of([unless(~has(k), all_of([has(x) for x in xs])) for k, xs in node.get("dependentRequired").items()])))
        for k, s in node.get("dependentSchemas", {}).items():
            out.append(("dependentSchemas", "dependent_schema_mismatch", unless(~has(k), self.holds(s, v))))
        return out

    def errors(self, node: Schema, v: Value, path: str = "") -> list[tuple[str, str, Any, Check]]:
        """(path, keyword, code, check) of a node and, for typed rows, of its fields below."""
        out = [(path, k, c, check) for k, c, check in self.checks(node, v)]
        if isinstance(v.kind, T.StructType):
            for name, s in node.get("properties", {}).items():
                if name in v.kind.fieldNames():
                    inner = Value(v.col[name], v.kind[name].dataType)
                    out += [(p, k, c, check if check is True else any_of([v.col[name].isNull(), check])) for p, k, c, check in self.errors(s, inner, f"{path}/{name}")]
        return out


def _large_multiple(text: Column, divisor: int | Decimal) -> Column:
    """Whether a number of 20 digits or more, given as mantissa and exponent, is a multiple.

    Its value is the mantissa's digits times a power of ten; powers modulo the scaled divisor are
    tabulated up to the largest double.
    """
    d = Decimal(divisor)
    shift = max(0, -d.as_tuple().exponent)
    m = int(d.scaleb(shift))
    digits = F.regexp_replace(F.split_part(F.regexp_replace(text, "^-", ""), F.lit("E"), F.lit(1)), r"\.|0+$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int") - F.char_length(digits) + 1 + shift
    if m > 10**15:
        raise NotNative("a divisor with many digits")
    powers = F.array(*[F.lit(pow(10, k, m)).cast("decimal(19,0)") for k in range(330)])
    rest = F.pmod(digits.try_cast("decimal(18,0)"), F.lit(Decimal(m)).cast("decimal(18,0)")).cast("decimal(19,0)")
    return F.coalesce((power >= 0) & (F.pmod((rest * F.get(powers, power)).cast("decimal(38,0)"), F.lit(Decimal(m)).cast("decimal(38,0)")) == 0), F.lit(False))


def _like(p: str) -> Callable[[Column], Column]:
    return lambda k: k.rlike(p)


def _unorderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _unorderable(kind.elementType)
    return isinstance(kind, T.StructType) and any(_unorderable(f.dataType) for f in kind)
