"""Contracts over DataFrames: flags, errors, lists, quarantine, defaults, reports.

A contract is compiled once on the driver.  If all of it has a column form, it decides natively;
otherwise an Arrow UDF carries the JSON text of each row to closures made from the plan.  Either
way the errors are those of the evaluator: as columns where a plan's outcome has a fixed shape,
else by the evaluator on the rows that are invalid and on no others.  JSON numbers that a VARIANT
cannot keep are decided by it too, row by row.  No operator here shuffles but ``report``; all of
them work on streaming DataFrames in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions import numbers
from pactlake.operators import defaults
from pactlake.operators.evaluate import bind, evaluate, evaluate_json
from pactlake.operators.flags import json_errors, json_flag, reachable
from pactlake.operators.native import Native, NotNative, Value, column
from pactlake.operators.results import MESSAGES, Outcome, Translator
from pactlake.operators.told import listed
from pactlake.plans.catalog import Catalog
from pactlake.plans.schema import Schema

ERRORS = "array<struct<path:string,keyword:string,code:string,message:string>>"
_TIME_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "dateFormat": "yyyy-MM-dd"}


class Contract:
    """A compiled schema, applied to rows.

    column: a column that holds the values: JSON text, BINARY JSON text, VARIANT, or any typed
    column; without one, the whole row is the object.  tier: "auto", "native" or "general".
    struct_mode, null_means: see ``Native``.
    """

    def __init__(self, schema: Schema | str | dict | bool, catalog: Catalog | None = None, *, tier: str = "auto", struct_mode: bool = False, null_means: str = "absent", translate: Translator | None = None):
        self.catalog = catalog or (schema.catalog if isinstance(schema, Schema) else Catalog())
        self.node = bind(schema if isinstance(schema, Schema) else self.catalog.compile(schema))
        self.tier, self.struct_mode, self.null_means, self.translate = tier, struct_mode, null_means, translate

    # One value on the driver

    def evaluate(self, value: Any) -> Outcome:
        """A decoded value, or JSON text as bytes."""
        return evaluate_json(self.node, bytes(value)) if isinstance(value, (bytes, bytearray, memoryview)) else evaluate(self.node, value)

    # Native tier

    def _value(self, df: DataFrame, name: str | None) -> tuple[Value, Column | None]:
        """The value's column and, for text, the check that it is JSON."""
        if name is None:
            return Value(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema), None
        kind = df.schema[name].dataType
        col = F.col(f"`{name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            text = col if isinstance(kind, T.StringType) else F.try_validate_utf8(col.cast("string"))
            parsed = F.try_parse_json(text)
            return Value(parsed, T.VariantType()), parsed.isNotNull() & _one_value(text)
        return Value(col, kind), None

    def _native(self) -> Native:
        return Native(self.catalog, self.struct_mode, self.null_means)

    def tier_for(self, df: DataFrame, name: str | None = None) -> str:
        """The tier that will run, and why the native one cannot, if it cannot."""
        try:
            if self.tier == "general":
                raise NotNative("as asked for")
            self._native().checks(self.node, self._value(df, name)[0])
            return "native"
        except NotNative as e:
            if self.struct_mode:
                raise NotNative(f"struct mode has a native form only: {e}") from None
            if self.tier == "native":
                raise
            return "general" if self.tier == "general" else f"general: {e}"

    def _flat(self, df: DataFrame, name: str | None) -> tuple[Value, Column | None]:
        v, parses = self._value(df, name)
        if name is None:  # fields stay plain columns, so that filters reach the scan
            v = Value(_Fields(), df.schema)
        return v, parses

    def is_valid(self, df: DataFrame, name: str | None = None) -> Column:
        """A boolean column; NULL values of a named column are invalid JSON or JSON null as typed."""
        if self.tier_for(df, name) != "native":
            return _flag_udf(self.node)(self._text(df, name))
        v, parses = self._flat(df, name)
        ok = column(self._native().holds(self.node, v))
        if parses is not None:
            ok = F.coalesce(parses & ok, F.lit(False))
        elif name is not None:
            ok = F.when(F.col(f"`{name}`").isNull(), F.lit(evaluate(self.node, None).valid)).otherwise(ok)
        if v.variant and _weighs_numbers(self.node) and not self.struct_mode:
            text = self._text(df, name)
            long = F.coalesce(text.rlike(_LONG_NUMBER), F.lit(False))
            return F.when(long, _flag_udf(self.node)(F.when(long, text))).otherwise(ok)
        return ok

    def errors(self, df: DataFrame, name: str | None = None) -> Column:
        """An array of (path, keyword, code, message): of several errors of a keyword at one place, the last."""
        return self._checked(df, name)[1]

    def _checked(self, df: DataFrame, name: str | None) -> tuple[Column | None, Column]:
        """Validity, unless it is to be told from the errors, and the errors."""
        if self.tier_for(df, name) != "native":
            return None, _errors_udf(self.node, self.translate)(F.coalesce(self._text(df, name), F.lit("")))
        v, parses = self._flat(df, name)
        ok = self.is_valid(df, name)
        try:
            if self.translate is not None or parses is not None or name is not None:
                raise NotNative("errors that need the outcome tree")
            found = listed(self._native(), self.node, v)
        except NotNative:
            if not self.struct_mode:  # NULL for rows that need no explanation
                invalid = ~F.coalesce(ok, F.lit(False))
                return ok, _errors_udf(self.node, self.translate)(F.when(invalid, F.coalesce(self._text(df, name), F.lit(""))))
            found = [_error_column(p, k, c, check, self.translate) for p, k, c, check in self._native().errors(self.node, v) if check is not True]
        return ok, F.array_compact(F.array(*found)).cast(ERRORS) if found else F.array().cast(ERRORS)

    def _text(self, df: DataFrame, name: str | None) -> Column:
        """The JSON text that the general evaluator reads."""
        options = _TIME_TEXT | {"ignoreNullFields": str(self.null_means == "absent").lower()}
        if name is None:
            seen = _names_seen(self.node)
            own = [F.col(f"`{c}`") for c in df.columns if seen is None or c in seen]
            return F.to_json(F.struct(*own), options) if own else F.lit("{}")
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            return F.col(f"`{name}`")
        if isinstance(kind, T.BinaryType):
            return F.try_validate_utf8(F.col(f"`{name}`").cast("string"))  # NULL, and so no JSON, if malformed
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
            return F.coalesce(F.to_json(F.col(f"`{name}`"), options), F.lit("null"))
        wrapped = F.to_json(F.struct(F.col(f"`{name}`").alias("v")), _TIME_TEXT | {"ignoreNullFields": "false"})
        return F.expr("null").cast("string") if name not in df.columns else F.substring(wrapped, 6, 1 << 30).substr(F.lit(1), F.char_length(wrapped) - 6)

    # Whole frames

    def validate(self, df: DataFrame, name: str | None = None, *, with_errors: bool = True, prefix: str = "") -> DataFrame:
        """Adds ``valid`` and, unless switched off, ``errors``."""
        for c in (f"{prefix}valid", f"{prefix}errors"):
            if c in df.columns:
                raise ValueError(f"the rows already have a column {c}; give a prefix")
        if not with_errors:
            return df.withColumn(f"{prefix}valid", self.is_valid(df, name))
        ok, found = self._checked(df, name)
        if ok is not None:
            return df.withColumns({f"{prefix}valid": ok, f"{prefix}errors": found})
        made = df.withColumn(f"{prefix}errors", found)  # one pass of the evaluator gives both
        return made.withColumn(f"{prefix}valid", F.size(f"{prefix}errors") == 0).select(*df.columns, f"{prefix}valid", f"{prefix}errors")

    def filter(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """The valid rows; a native contract is an ordinary predicate that reaches the scan."""
        return df.where(self.is_valid(df, name))

    def split(self, df: DataFrame, name: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The valid rows, and the others with their errors."""
        return self.filter(df, name), self.validate(df, name).where("NOT valid").drop("valid")

    def error_rows(self, df: DataFrame, name: str | None = None, *, keys: list[str]) -> DataFrame:
        """One row for each error: the keys, path, keyword, code, message."""
        made = df.select(*keys, F.explode(self.errors(df, name)).alias("_e"))
        return made.select(*keys, "_e.path", "_e.keyword", "_e.code", "_e.message")

    def report(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Errors counted by keyword and code."""
        return self.error_rows(df, name, keys=[]).groupBy("keyword", "code").agg(F.count(F.lit(1)).alias("n"))

    def listing(self, df: DataFrame, name: str | None = None, *, hierarchy: bool = True) -> Column:
        """The outcome tree as JSON text: nested, or with all nodes in one list."""
        return _list_udf(self.node, hierarchy, self.translate)(self._text(df, name))

    def detailed_errors(self, df: DataFrame, name: str | None = None) -> Column:
        """Messages by location and keyword, as a map."""
        pairs = F.transform(self.errors(df, name), lambda e: F.struct(F.concat(e["path"], F.lit("/"), e["keyword"]).alias("k"), e["message"].alias("m")))
        # Of pairs with one key the last stays, at the first one's place.
        step = lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_entries(F.array(p)))
        return F.aggregate(pairs, F.create_map().cast("map<string,string>"), step)

    def with_defaults(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Fills defaults: in JSON text by the general evaluator, in typed columns natively."""
        if name is not None and isinstance(df.schema[name].dataType, T.StringType):
            return df.withColumn(name, _fill_udf(self.node)(F.col(f"`{name}`")))
        made = {}
        if name is not None:
            return df.withColumn(name, _fill_column(self.node, F.col(f"`{name}`"), df.schema[name].dataType))
        node = self.node
        while "properties" not in node and isinstance(node.get("$ref"), str) and node.target("$ref") is not None:
            node = node.target("$ref")
        for field, s in node.get("properties", {}).items():
            if field in df.columns:
                made[field] = _fill_property(s, F.col(f"`{field}`"), df.schema[field].dataType)
            elif (value := _default_of(s)) is not None:
                made[field] = _literal(value, None)
        return df.withColumns(made) if made else df


    def unmarshal(self, df: DataFrame, name: str, kind: T.StructType | None = None, *, into: str | None = None) -> DataFrame:
        """Fills defaults in JSON text and reads it into typed columns; fields the type lacks are skipped.

        kind: the target type, else the one that the schema describes.  Nothing is validated;
        text that does not fit a field gives NULL there.
        """
        from pactlake.functions.inference import to_struct_type

        filled = self.with_defaults(df, name)
        return filled.withColumn(into or name, F.from_json(F.col(f"`{name}`"), kind or to_struct_type(self.node)))


class _Fields:
    """Stands for the row itself: its fields are the frame's own columns."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{name}`")


def _one_value(text: Column) -> Column:
    """No text after the JSON value, which the parser lets pass."""
    trimmed = F.regexp_replace(text, r"\s+\z", "")
    closed = trimmed.rlike(r"[}\]]\z") | ~trimmed.rlike(r"^\s*[{\[]")
    return closed & ~trimmed.rlike(r'(?s)^\s*("([^"\\]|\\.)*"|-?[0-9][0-9eE+.\-]*|true|false|null)\s+\S') & (F.json_array_length(F.concat(F.lit("["), trimmed, F.lit("]"))) == 1)


def _error_struct(path: str, keyword: str, code: str | tuple[str, str, Column], translate: Translator | None) -> Column:
    if isinstance(code, tuple):
        one, many, several = code
        return F.when(several, _error_struct(path, keyword, many, translate)).otherwise(_error_struct(path, keyword, one, translate))
    text = (translate and translate(code, {})) or MESSAGES[code]
    return F.struct(F.lit(path).alias("path"), F.lit(keyword).alias("keyword"), F.lit(code).alias("code"), F.lit(text).alias("message"))


def _error_column(path: str, keyword: str, code: str | tuple[str, str, Column], check: Any, translate: Translator | None) -> Column:
    return F.when(~F.coalesce(column(check), F.lit(False)), _error_struct(path, keyword, code, translate))


#: Numbers of JSON text that a VARIANT may round: with an exponent, or with many digits.
_LONG_NUMBER = r"(^|[:\[,\s])-?[0-9]+(\.[0-9]+)?[eE]|[0-9]{26,}|\.[0-9]{13,}"
_WEIGHING = ("type", "enum", "const", "uniqueItems", "multipleOf", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")


def _weighs_numbers(node: Schema) -> bool:
    return any(k in s for s in reachable(node) for k in _WEIGHING)


def _names_seen(node: Schema, active: tuple[int, ...] = ()) -> set[str] | None:
    """The properties of the outermost object that a plan can look at; None for all."""
    if node.boolean is not None or id(node) in active:
        return set()
    if any(k in node for k in ("additionalProperties", "patternProperties", "propertyNames", "minProperties", "maxProperties", "unevaluatedProperties", "enum", "const", "$dynamicRef", "$recursiveRef")):
        return None
    active = (*active, id(node))
    need = node.get("dependentRequired") if isinstance(node.get("dependentRequired"), dict) else {}
    out = {*node.get("properties", {}), *(node.get("required") if isinstance(node.get("required"), list) else []), *need, *(x for xs in need.values() for x in xs), *node.get("dependentSchemas", {})}
    inner = [node.target("$ref")] if isinstance(node.get("$ref"), str) else []
    inner += [s for k in ("allOf", "anyOf", "oneOf") for s in node.get(k) or ()]
    inner += [node.get(k) for k in ("not", "if", "then", "else") if k in node] + list(node.get("dependentSchemas", {}).values())
    for s in inner:
        if s is not None:
            if (seen := _names_seen(s, active)) is None:
                return None
            out |= seen
    return out


def _flag_udf(node: Schema):
    held: list = []  # made in the worker

    @F.pandas_udf("boolean")
    def flags(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(json_flag(node))
        return pd.Series([held[0](t) for t in texts], dtype="bool")

    return flags


def _errors_udf(node: Schema, translate: Translator | None):
    """NULL text has no errors."""
    held: list = []

    @F.arrow_udf(ERRORS)
    def found(texts):
        import numpy as np
        import pyarrow as pa

        if not held:
            held.append(json_errors(node))
        rows = [[] if t is None else held[0](t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = [x for r in rows for x in r]
        columns = [[at for at, _ in flat], [e.keyword for _, e in flat], [e.code for _, e in flat], [e.message(translate) for _, e in flat]]
        parts = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "keyword", "code", "message"])
        return pa.ListArray.from_arrays(pa.array(ends), parts)

    return found


def _list_udf(node: Schema, hierarchy: bool, translate: Translator | None):
    @F.pandas_udf("string")
    def lists(texts: pd.Series) -> pd.Series:
        return pd.Series([numbers.dumps(evaluate_json(node, "" if t is None else t).to_list(hierarchy, translate)) for t in texts], dtype="object")

    return lists


def _fill_udf(node: Schema):
    @F.pandas_udf("string")
    def filled(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else defaults.fill_json(node, t) for t in texts], dtype="object")

    return filled


def _default_of(s: Schema, kind: T.DataType | None = None) -> Any:
    """A constant, or a Column that calls a default function for each row."""
    for branch in (*s.get("anyOf", []), s):
        if (d := defaults.resolve_default(branch)) is not None:
            called = defaults.call_of(branch, d)
            if called is None:
                return d
            made = defaults.evaluate_default(branch, d)
            return made if isinstance(made, Column) else _called(called, made, kind)
    return None


def _called(make: Any, example: Any, kind: T.DataType | None) -> Column:
    """Calls a Python function for each row; its type is the field's, else that of one result."""
    kind = kind or (T.BooleanType() if isinstance(example, bool) else T.LongType() if isinstance(example, int) else T.DoubleType() if isinstance(example, float) else T.StringType())
    simple = isinstance(kind, (T.StringType, T.BooleanType, T.LongType, T.DoubleType))

    @F.udf(kind if simple else T.StringType())
    def value(_: Any) -> Any:
        made = make()
        return made if made is None or isinstance(made, (bool, int, float)) and not isinstance(kind, T.StringType) else str(made)

    called = value.asNondeterministic()(F.lit(0))
    return called if simple else called.try_cast(kind)


def _literal(value: Any, kind: T.DataType | None) -> Column:
    """A default as a literal; a Column (from a default function) as it is."""
    if isinstance(value, Column):
        return value if kind is None else value.try_cast(kind)
    if isinstance(value, (dict, list)):
        text = F.lit(numbers.dumps(value))
        return F.from_json(text, kind) if kind is not None else F.parse_json(text)
    return F.lit(value) if kind is None else F.lit(value).try_cast(kind)


def _fill_property(s: Schema, col: Column, kind: T.DataType) -> Column:
    value = _default_of(s, kind)
    if value is not None:
        col = F.coalesce(col, _literal(value, kind))
    return _fill_column(s, col, kind)


def _fill_column(node: Schema, col: Column, kind: T.DataType) -> Column:
    if isinstance(node.get("$ref"), str) and (t := node.target("$ref")) is not None and t is not node:
        col = _fill_column(t, col, kind)
    if isinstance(kind, T.StructType) and "properties" in node:
        props = node.get("properties")
        if not any(f.name in props for f in kind):
            return col
        made = F.struct(*[(_fill_property(props[f.name], col[f.name], f.dataType) if f.name in props else col[f.name]).alias(f.name) for f in kind])
        return F.when(col.isNotNull(), made)
    if isinstance(kind, T.ArrayType) and "items" in node and isinstance(kind.elementType, T.StructType):
        return F.transform(col, lambda x: _fill_column(node.get("items"), x, kind.elementType))
    return col


def validate_by_contract(df: DataFrame, contracts: dict[str, Contract], by: str, name: str | None = None) -> DataFrame:
    """Validates each row by the contract that column ``by`` names; rows that name none are invalid."""
    ok: Column = F.lit(False)
    for key, contract in contracts.items():
        ok = F.when(F.col(by) == key, contract.is_valid(df, name)).otherwise(ok)
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def metaschema_errors(spark: SparkSession, documents: DataFrame, name: str, catalog: Catalog | None = None) -> DataFrame:
    """Meta-validates a column of schema documents: adds ``valid``."""
    own = catalog or Catalog()

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            try:
                return own.validate_schema(t).valid
            except (ValueError, LookupError):
                return False

        return pd.Series([t is not None and one(t) for t in texts], dtype="bool")

    return documents.withColumn("valid", check(F.col(name)))
