"""The contract engine: keyword semantics, codes, both tiers, defaults, builders, streams."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions import builders as B
from pactlake.functions import formats, inference, numbers, patterns
from pactlake.operators import defaults
from pactlake.operators.contract import Contract
from pactlake.operators.evaluate import evaluate, evaluate_json
from pactlake.operators.native import NotNative
from pactlake.operators.results import MESSAGES
from pactlake.plans.catalog import Catalog, PatternError, now
from pactlake.plans.schema import UnresolvedReference


def codes(schema, value, **options) -> dict[str, str]:
    return {e.keyword: e.code for e in evaluate(Catalog(**options).compile(schema), value).errors}


#: (schema, value that fails, keyword, code)
CODES = [
    ({"additionalProperties": {"type": "string"}}, {"a": 1}, "additionalProperties", "additional_property_mismatch"),
    ({"additionalProperties": False}, {"a": 1, "b": 2}, "additionalProperties", "additional_properties_mismatch"),
    ({"allOf": [{"type": "string"}]}, 1, "allOf", "all_of_item_mismatch"),
    ({"anyOf": [{"type": "string"}]}, 1, "anyOf", "any_of_item_mismatch"),
    ({"if": True, "then": False}, 1, "then", "if_then_mismatch"),
    ({"if": False, "else": False}, 1, "else", "if_else_mismatch"),
    ({"const": None}, 1, "const", "const_mismatch_null"),
    ({"const": 2}, 1, "const", "const_mismatch"),
    ({"contains": {"const": 1}}, [2], "minContains", "contains_too_few_items"),
    ({"contains": {"const": 1}, "maxContains": 1}, [1, 1], "maxContains", "contains_too_many_items"),
    ({"contentEncoding": "rot13"}, "hello", "contentEncoding", "unsupported_encoding"),
    ({"contentEncoding": "base64"}, "%%%", "contentEncoding", "invalid_encoding"),
    ({"contentMediaType": "application/unknown"}, "hello", "contentMediaType", "unsupported_media_type"),
    ({"contentMediaType": "application/json"}, "{", "contentMediaType", "invalid_media_type"),
    ({"contentMediaType": "application/json", "contentSchema": {"type": "array"}}, "{}", "contentSchema", "content_schema_mismatch"),
    ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, "dependentRequired", "dependent_property_required"),
    ({"dependentSchemas": {"a": False}}, {"a": 1}, "dependentSchemas", "dependent_schema_mismatch"),
    ({"dependentSchemas": {"a": False, "b": False}}, {"a": 1, "b": 1}, "dependentSchemas", "dependent_schemas_mismatch"),
    ({"enum": [1, "x"]}, 2, "enum", "value_not_in_enum"),
    ({"exclusiveMaximum": 3}, 3, "exclusiveMaximum", "exclusive_maximum_mismatch"),
    ({"exclusiveMinimum": 3}, 3, "exclusiveMinimum", "exclusive_minimum_mismatch"),
    ({"items": {"type": "string"}}, [1], "items", "item_mismatch"),
    ({"items": {"type": "string"}}, [1, 2], "items", "items_mismatch"),
    ({"maxItems": 1}, [1, 2], "maxItems", "items_too_long"),
    ({"maxLength": 1}, "ab", "maxLength", "string_too_long"),
    ({"maxProperties": 0}, {"a": 1}, "maxProperties", "too_many_properties"),
    ({"maximum": 1}, 2, "maximum", "value_above_maximum"),
    ({"minItems": 1}, [], "minItems", "items_too_short"),
    ({"minLength": 3}, "😀é", "minLength", "string_too_short"),
    ({"minProperties": 1}, {}, "minProperties", "too_few_properties"),
    ({"minimum": 3}, 2, "minimum", "value_below_minimum"),
    ({"multipleOf": 0}, 2, "multipleOf", "invalid_multiple_of"),
    ({"multipleOf": 0.01}, Decimal("4.015"), "multipleOf", "not_multiple_of"),
    ({"not": {}}, 1, "not", "not_schema_mismatch"),
    ({"oneOf": [{}, {}]}, 1, "oneOf", "one_of_multiple_matches"),
    ({"oneOf": [False]}, 1, "oneOf", "one_of_item_mismatch"),
    ({"pattern": "^a$"}, "a\n", "pattern", "pattern_mismatch"),
    ({"patternProperties": {"^x": {"type": "string"}}}, {"x": 1}, "properties", "pattern_property_mismatch"),
    ({"patternProperties": {"^x": False}}, {"x": 1, "xy": 1}, "properties", "pattern_properties_mismatch"),
    ({"prefixItems": [{"type": "string"}]}, [1], "prefixItems", "prefix_item_mismatch"),
    ({"prefixItems": [False, False]}, [1, 2], "prefixItems", "prefix_items_mismatch"),
    ({"properties": {"a": {"type": "string"}}}, {"a": 1}, "properties", "property_mismatch"),
    ({"properties": {"a": False, "b": False}}, {"a": 1, "b": 1}, "properties", "properties_mismatch"),
    ({"propertyNames": {"maxLength": 1}}, {"ab": 1}, "propertyNames", "property_name_mismatch"),
    ({"propertyNames": False}, {"a": 1, "b": 1}, "propertyNames", "property_names_mismatch"),
    ({"required": ["a"]}, {}, "required", "missing_required_property"),
    ({"required": ["a", "b"]}, {}, "required", "missing_required_properties"),
    ({"type": ["string", "null"]}, 1, "type", "type_mismatch"),
    ({"unevaluatedItems": False}, [1], "unevaluatedItems", "unevaluated_items_not_allowed"),
    ({"unevaluatedItems": {"type": "string"}}, [1], "unevaluatedItems", "unevaluated_item_mismatch"),
    ({"unevaluatedItems": {"type": "string"}}, [1, 2], "unevaluatedItems", "unevaluated_items_mismatch"),
    ({"unevaluatedProperties": False}, {"a": 1}, "properties", "unevaluated_property_mismatch"),
    ({"unevaluatedProperties": False}, {"a": 1, "b": 2}, "properties", "unevaluated_properties_mismatch"),
    ({"uniqueItems": True}, [1, {"a": 1}, {"a": Decimal("1.0")}], "uniqueItems", "unique_items_mismatch"),
    ({"$ref": "#/$defs/x", "$defs": {"x": False}}, 1, "$ref", "ref_mismatch"),
    ({"$dynamicRef": "#x", "$defs": {"x": {"$dynamicAnchor": "x", "type": "string"}}}, 1, "$dynamicRef", "dynamic_ref_mismatch"),
    (False, 1, "schema", "false_schema_mismatch"),
]


@pytest.mark.parametrize("schema, value, keyword, code", CODES, ids=[c for *_, c in CODES])
def test_error_codes(schema, value, keyword, code):
    assert codes(schema, value)[keyword] == code
    assert "{" not in next(e for e in evaluate(Catalog().compile(schema), value).errors if e.keyword == keyword).message() or code in ("value_not_in_enum", "dependent_property_required")
    assert code in MESSAGES


def test_more_codes():
    assert evaluate_json(Catalog().compile({}), "{x").errors[0].code == "invalid_json"
    assert codes({"format": "nope"}, "x", assert_format=True) == {"format": "unknown_format"}
    assert codes({"format": "date"}, "2024-1-5", assert_format=True) == {"format": "format_mismatch"}
    assert codes({"format": "date"}, "2024-1-5") == {}
    assert codes({"type": []}, 1) == {} and codes({"enum": []}, 1) == {}


@pytest.mark.parametrize("text, ok", [("-9223372036854775808", True), ("9223372036854775807", True), ("18446744073709551615", True), ("-9223372036854775809", False), ("18446744073709551616", False), ("1e2", True), ("1.0", True), ("1.5", False)])
def test_exact_integers(text, ok):
    schema = {"type": "integer", "minimum": -(2**63), "maximum": 2**64 - 1}
    assert evaluate_json(Catalog().compile(schema), text).valid == ok


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_text_round_trip_keeps_equality(value):
    assert numbers.equal(numbers.parse(numbers.dumps(value)), value)


def test_equality_is_by_value():
    same = [(1, Decimal("1.0")), (Decimal("1e2"), 100), ({"a": 1, "b": 2}, {"b": 2, "a": 1}), (0, Decimal("-0.0"))]
    other = [(1, True), ("1", 1), ([1, 2], [2, 1]), (None, False), ({}, [])]
    assert all(numbers.equal(a, b) for a, b in same) and not any(numbers.equal(a, b) for a, b in other)
    for bad in ('{"a":1,"a":2}', '{"a":1} x', "NaN", ""):
        with pytest.raises(numbers.InvalidJson):
            numbers.parse(bad)


def test_patterns():
    assert patterns.compiled(r"^\s$").search("\n") and not patterns.compiled(r"^\s$").search("\x0b")
    assert not patterns.compiled(r"\d").search("٣") and patterns.compiled(r"^\p{Lu}").search("É")
    for bad in (r"(?=a)", r"(a)\1", "a++", "[a", r"(?<!x)y", "\\" + "u0041"):
        with pytest.raises(patterns.InvalidPattern):
            patterns.compiled(bad)
    with pytest.raises(PatternError) as e:
        Catalog().compile({"properties": {"a": {"pattern": "(?=x)"}}})
    assert e.value.places == [("/properties/a/pattern", "(?=x)")]


FORMAT_CASES = [("date", "2024-02-29", "2023-02-29"), ("time", "23:59:60Z", "12:00:60Z"), ("time", "15:59:60-08:00", "15:59:60+08:00"), ("date-time", "1963-06-19T08:30:06.28Z", "1963-06-19 08:30:06Z"), ("duration", "P1Y2M3DT4H", "P1Y2D"), ("duration", "P4W", "P1Y1W"), ("period", "2020-01-01T00:00:00Z/P1D", "P1D/P1D"), ("hostname", "a.b-c.example.", "-a.example"), ("email", "joe.bloggs@example.com", ".test@example.com"), ("ipv4", "192.168.0.1", "192.168.00.1"), ("ipv6", "::1", "::1%eth0"), ("uri", "http://a/b?c", "//a/b"), ("uri-reference", "/abc", "\\\\WINDOWS"), ("uri-template", "http://x/{a}", "http://x/{a"), ("json-pointer", "/a~1b", "/a~2"), ("relative-json-pointer", "1/a", "01/a"), ("uuid", "2EB8AA08-AA98-11EA-B4AA-73B441D16380", "2eb8aa08-aa98-11ea-b4aa-73b441d1638"), ("regex", "a[b]", "a["), ("unknown", "x", None)]


@pytest.mark.parametrize("name, good, bad", FORMAT_CASES)
def test_formats(name, good, bad):
    assert formats.FORMATS[name](good) and (bad is None or not formats.FORMATS[name](bad))


def test_native_formats_agree(spark):
    texts = [x for _, g, b in FORMAT_CASES for x in (g, b) if x] + ["", "2024-02-30", "0000-01-01", "24:00:00Z", "1998-12-31T23:59:60Z", "a" * 64 + ".com", "P", "PT", "\n", "1.2.3.4\n"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select("s", *[f(F.col("s")).alias(n) for n, f in formats.COLUMNS.items()]).collect()
    assert [(r.s, n) for r in got for n in formats.COLUMNS if r[n] != formats.FORMATS[n](r.s)] == []


def test_references_and_catalog():
    c = Catalog()
    person = {"$id": "http://x/person", "properties": {"home": {"$ref": "address"}}}
    node = c.compile(person)
    assert c.unresolved_references() == ["http://x/address"]
    with pytest.raises(UnresolvedReference):
        evaluate(node, {"home": 1})
    c.compile({"$id": "http://x/address", "type": "object"})
    assert c.unresolved_references() == [] and not evaluate(node, {"home": 1}).valid
    assert c.compile({"type": "string"}, "http://x/address") is c.schema("http://x/address")  # the first stays
    assert evaluate(Catalog(on_unresolved="ignore").compile(person), {"home": 1}).valid
    both = Catalog().compile_batch({"http://y/a": {"$ref": "b"}, "http://y/b": {"type": "integer"}})
    assert not evaluate(both["http://y/a"], "x").valid
    loaded = Catalog()
    loaded.register_loader("mem", lambda uri: '{"type":"null"}')
    assert evaluate(loaded.compile({"$ref": "mem:/doc"}), None).valid
    assert evaluate(Catalog().compile({"$ref": "#"}), 1).valid  # a loop ends


def test_registries():
    c = Catalog(assert_format=True)
    c.register_format("int32", lambda v: -(2**31) <= v < 2**31 and numbers.is_whole(v), "number")
    node = c.compile({"type": "number", "format": "int32"})
    assert [evaluate(node, v).valid for v in (2147483647, 2147483648, Decimal("123.45"))] == [True, False, False]
    c.unregister_format("int32")
    assert not evaluate(node, 1).valid
    c.register_decoder("rev", lambda s: s[::-1].encode())
    c.register_media_type("text/int", lambda b: int(b))
    assert evaluate(c.compile({"contentEncoding": "rev", "contentMediaType": "text/int", "contentSchema": {"minimum": 12}}), "21").valid


@pytest.mark.parametrize("uri", ["http://json-schema.org/draft-04/schema", "http://json-schema.org/draft-06/schema#", "http://json-schema.org/draft-07/schema#", "https://json-schema.org/draft/2019-09/schema", "https://json-schema.org/draft/2020-12/schema"])
def test_metaschemas(uri):
    c = Catalog()
    assert c.validate_schema({"$schema": uri, "type": "object", "properties": {"a": {"minLength": 2}}}).valid
    assert not c.validate_schema({"$schema": uri, "minLength": -1}).valid and not c.validate_schema({"$schema": uri, "properties": {"a": {"type": "nope"}}}).valid


def test_outcome_shapes():
    node = Catalog().compile({"title": "t", "properties": {"a": {"properties": {"b": {"type": "string"}}}}})
    out = evaluate(node, {"a": {"b": 1}})
    assert out.flag() == {"valid": False}
    assert set(out.detailed_errors()) == {"/properties", "/a/properties", "/a/b/type"}
    flat = out.to_list(hierarchy=False)
    assert [d["instanceLocation"] for d in flat["details"]] == ["/a", "/a/b"] and "details" in out.to_list()["details"][0]
    assert evaluate(node, {}).to_list()["annotations"] == {"title": "t"}
    assert out.to_list(translate=lambda code, params: f"<{code}>")["errors"] == {"properties": "<property_mismatch>"}


ROWS = ['{"a":1,"b":"x","c":[1,2]}', '{"a":1.5}', '{"a":null,"b":"yy","c":[]}', "{}", "[1,2,2]", '"x"', "null", "3", "true", '{"a":"1","c":[1,"z",null]}', '{"b":"","x-1":1}', '{"x-2":"s","b":"x"}', "nope", '{"a":1} z', None, '{"c":[5,6,7,8]}', '{"a":20,"b":"long text"}']
DIFFERENTIAL = [
    {"type": "object"}, {"type": ["integer", "array"]}, {"enum": [3, "x", None, True]}, {"const": 3}, {"required": ["a", "b"]}, {"properties": {"a": {"type": "integer"}, "b": {"minLength": 1, "pattern": "^x"}}},
    {"properties": {"a": {"minimum": 1, "exclusiveMaximum": 20, "multipleOf": 0.5}}}, {"properties": {"c": {"items": {"type": "integer"}, "minItems": 1, "maxItems": 3}}}, {"properties": {"c": {"prefixItems": [{"const": 1}, {"type": "string"}], "items": False}}},
    {"properties": {"c": {"contains": {"minimum": 2}, "minContains": 1, "maxContains": 2}}}, {"additionalProperties": {"type": "number"}}, {"properties": {"a": True}, "patternProperties": {"^x-": {"type": "integer"}}, "additionalProperties": False}, {"propertyNames": {"maxLength": 1}}, {"minProperties": 1, "maxProperties": 2},
    {"dependentRequired": {"a": ["b"]}}, {"dependentSchemas": {"a": {"required": ["c"]}}}, {"allOf": [{"type": "object"}, {"required": ["a"]}]}, {"anyOf": [{"type": "string"}, {"required": ["b"]}]}, {"oneOf": [{"type": "integer"}, {"minimum": 2}, {"required": ["a"]}]}, {"not": {"type": "array"}},
    {"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"type": ["object", "array"]}}, {"$ref": "#/$defs/x", "$defs": {"x": {"properties": {"b": {"type": "string", "maxLength": 1}}}}}, {"properties": {"a": {}}, "unevaluatedProperties": False}, {"prefixItems": [True], "unevaluatedItems": {"const": 2}}, {"properties": {"a": {"type": "string"}}, "required": ["a"]},
]


def test_tiers_agree_on_json_text(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ROWS)], "i int, s string")
    own, other = [], []
    for k, schema in enumerate(DIFFERENTIAL):
        native, general = (Contract(schema, tier=t) for t in ("native", "general"))
        own.append(native.is_valid(df, "s").alias(f"v{k}"))
        other.append(general.is_valid(df, "s").alias(f"v{k}"))
    a, b = ({r.i: r.asDict() for r in df.select("i", *c).collect()} for c in (own, other))
    assert [(DIFFERENTIAL[k], ROWS[i]) for i in a for k in range(len(DIFFERENTIAL)) if a[i][f"v{k}"] != b[i][f"v{k}"]] == []


TYPED = "a long, b string, c array<long>, d double, e struct<x:long,y:string>, m map<string,long>, t timestamp, z boolean, u decimal(10,2)"
TYPED_CONTRACTS = [
    {"properties": {"a": {"minimum": 2}, "b": {"minLength": 2}}, "required": ["b"]}, {"properties": {"d": {"type": "integer"}}}, {"properties": {"d": {"multipleOf": 0.25, "maximum": 3}}}, {"properties": {"e": {"required": ["x"], "properties": {"y": {"enum": ["p"]}}, "additionalProperties": False}}},
    {"properties": {"c": {"uniqueItems": True, "contains": {"minimum": 3}}}}, {"properties": {"m": {"additionalProperties": {"maximum": 5}, "minProperties": 1}}}, {"minProperties": 6}, {"properties": {"t": {"pattern": "^2024"}}}, {"properties": {"z": {"const": True}, "u": {"exclusiveMinimum": 1.5}}}, {"anyOf": [{"required": ["c"]}, {"properties": {"a": {"const": 1}}, "required": ["a"]}]}, {"properties": {"c": {"items": {"type": "integer"}}}}, {"propertyNames": {"pattern": "^[a-m]$"}},
]


def test_tiers_agree_on_typed_rows(spark):
    import datetime

    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = [(1, "x", [1, 2], 0.5, (1, "p"), {"k": 3}, at, True, Decimal("1.50")), (None, "", [3, 3], 2.0, (None, "q"), {}, None, None, None), (5, None, None, 3.1, None, {"k": 9, "l": 1}, at, False, Decimal("2.25")), (None,) * 9, (2, "yy", [4, None], None, (2, None), None, at, True, Decimal("9.00"))]
    df = spark.createDataFrame(rows, TYPED)
    more = [{"properties": {"d": {"minimum": 2.5, "maximum": 3, "exclusiveMinimum": 0.5}, "u": {"multipleOf": 2, "maximum": 2}, "a": {"enum": [1, 7], "exclusiveMaximum": 2}}}, {"properties": {"a": {"type": "string"}, "d": {"type": "integer"}, "b": {"type": ["integer", "null"], "enum": ["x", 'q"'], "maxLength": 0, "pattern": "^z"}}, "required": ["a", "c", "zz"], "minProperties": 9, "maxProperties": 2}, {"oneOf": [{"required": ["a"]}, {"required": ["t"]}]}, {"properties": {"e": {"properties": {"x": {"minimum": 2}, "y": {"type": "string", "minLength": 5}}, "required": ["x", "y"]}, "c": {"minItems": 3, "type": "array"}}, "required": ["e", "d"]}]
    for schema in TYPED_CONTRACTS + more:
        x, y = ([(r.valid, [tuple(e) for e in r.errors]) for r in Contract(schema, tier=t).validate(df).collect()] for t in ("native", "general"))
        assert x == y, schema


def test_numbers_in_messages_are_plain(spark):
    from pactlake.operators.told import plain

    texts = ["0.0", "-0.0", "1.0", "-12.50", "1.0E10", "1.2345678912E8", "1.23456789E-5", "-9.999999999999999E22", "1.7976931348623157E308", "4.9E-324", "100", "-7", "0.001", "120.00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(plain(F.col("t"))).collect()] == [numbers.number_text(Decimal(t)) for t in texts]


BIG = ["-1e-13", "1e-13", "1e30", "1e300", "1" * 41, "-0.0000000000001", "5", "1e400", "12345678901234567890123456.5", "0.1e1", '"1e5"', "[1e2, 100]", "[1e-13, 0]", "2.0", "1.00000000000000000000000000000000000000001"]


def test_numbers_that_a_variant_rounds(spark):
    df = spark.createDataFrame(list(enumerate(BIG)), "i int, s string")
    for schema in ({"minimum": 0}, {"type": "integer"}, {"maximum": 10**25 - 1}, {"multipleOf": 0.5}, {"const": 1}, {"enum": [0, 10**13, 1]}, {"items": {"type": "integer"}}, {"exclusiveMaximum": 1}):
        contract = Contract(schema)
        assert contract.tier_for(df, "s") == "native"
        got = {r.i: (r.valid, [tuple(e) for e in r.errors]) for r in contract.validate(df, "s").collect()}
        for i, t in enumerate(BIG):
            want = contract.evaluate(t.encode())
            assert got[i] == (want.valid, [(p, e.keyword, e.code, e.message()) for p, e in want.flat()]), (schema, t)
    typed = spark.createDataFrame([(1e-13, 1e300), (1e30, 0.1), (2.5, 1e22)], "x double, y double")
    for schema in ({"properties": {"x": {"multipleOf": 0.5}, "y": {"multipleOf": 4}}}, {"properties": {"x": {"type": "integer"}, "y": {"multipleOf": 0.3}}}, {"properties": {"y": {"multipleOf": 7}}}):
        assert [r.valid for r in Contract(schema, tier="native").validate(typed).collect()] == [r.valid for r in Contract(schema, tier="general").validate(typed).collect()], schema


def test_bytes_details_and_long_plans(spark):
    df = spark.createDataFrame([(1, b'{"a": 1}'), (2, b"\xff{"), (3, None), (4, b"[1, 2")], "i int, b binary")
    for tier in ("native", "general"):
        got = {r.i: (r.valid, [e.code for e in r.errors]) for r in Contract({"required": ["a"]}, tier=tier).validate(df, "b").collect()}
        assert got == {1: (True, []), 2: (False, ["invalid_json"]), 3: (False, ["invalid_json"]), 4: (False, ["invalid_json"])}
    rows = spark.createDataFrame([('{"a": 1, "x1": "s", "b": [1]}',)], "s string")
    schema = {"properties": {"a": {"type": "string"}, "b": {"items": {"type": "string"}}}, "patternProperties": {"^x": {"type": "number"}}}
    for tier in ("native", "general"):
        contract = Contract(schema, tier=tier)
        assert rows.select(contract.detailed_errors(rows, "s").alias("m")).first().m == contract.evaluate(b'{"a": 1, "x1": "s", "b": [1]}').detailed_errors()
    wide = spark.createDataFrame([(1, 2.0), (-1, 0.5)], "a long, d double")
    many = {"properties": {"a": {"minimum": 0, "allOf": [{"minimum": -k} for k in range(500)]}, "d": {"minimum": 1}}}
    few = {"properties": {"a": {"minimum": 0, "allOf": [{"minimum": -k} for k in range(3)]}, "d": {"minimum": 1}}}
    lists = [[[tuple(e)[:3] for e in r.errors if "allOf" not in e.path] for r in Contract(s).validate(wide).collect()] for s in (many, few)]
    assert Contract(many).tier_for(wide).startswith("general") and Contract(few).tier_for(wide) == "native"
    assert [[(p, c) for p, _, c in r if p.count("/") < 2 and "all_of" not in c and p != "/a"] for r in lists[0]] == [[(p, c) for p, _, c in r if p.count("/") < 2 and "all_of" not in c and p != "/a"] for r in lists[1]]


def test_struct_mode_has_no_general_form(spark):
    df = spark.createDataFrame([("", 1)], "s string, n long")
    with pytest.raises(NotNative):
        Contract({"required": ["s"]}, struct_mode=True, tier="general").validate(df)
    with pytest.raises(NotNative):
        Contract({"const": {"s": ""}}, struct_mode=True).validate(df)
    errors = Contract({"required": ["s", "n", "q"], "properties": {"n": {"minimum": 5}}}, struct_mode=True).validate(df).first().errors
    assert [(e.path, e.code, e.message) for e in errors] == [("", "property_mismatch", "Property n does not match the schema"), ("", "required_missing", "Required properties s, q are missing"), ("/n", "value_below_minimum", "1 should be at least 5")]


def test_default_functions_run_for_each_row(spark):
    import uuid

    own = Catalog()
    own.register_default_function("uuid", lambda: str(uuid.uuid4()))
    own.register_default_function("stamp", lambda: F.current_timestamp())
    own.register_default_function("broken", lambda: 1 / 0)
    schema = own.compile({"properties": {"u": {"default": "uuid()"}, "t": {"default": "stamp()"}, "b": {"default": "broken()"}, "k": {"default": "unknown()"}}})
    df = spark.createDataFrame([(None, None)] * 5, "u string, k string")
    got = Contract(schema).with_defaults(df).collect()
    assert len({r.u for r in got}) == 5 and {r.k for r in got} == {"unknown()"} and {r.b for r in got} == {"broken()"} and all(r.t is not None for r in got)


def test_only_columns_that_a_plan_sees_are_read(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as x", "cast(id as string) as unused").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    flag = Contract({"allOf": [{"properties": {"x": {"minimum": 4}}}], "required": ["id"]}, tier="general").is_valid(df)
    plan = df.select(flag.alias("v"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,x:bigint>" in plan


def test_struct_mode(spark):
    df = spark.createDataFrame([("", 0, []), ("x", None, [1])], "s string, n long, c array<long>")
    strict = Contract({"required": ["s", "n", "c"]}, struct_mode=True, tier="native")
    assert [[e.code for e in r.errors] for r in strict.validate(df).collect()] == [["required_missing"], ["required_missing"]]
    assert [r.valid for r in Contract({"required": ["s", "c"]}, tier="native").validate(df).collect()] == [True, True]
    as_null = Contract({"properties": {"n": {"type": "integer"}}}, null_means="null", tier="native")
    assert [r.valid for r in as_null.validate(df).collect()] == [True, False]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("x", F.col("id") * 1.0).write.parquet(f"{tmp_path}/t")
    plan = Contract({"properties": {"x": {"minimum": 10}}}).filter(spark.read.parquet(f"{tmp_path}/t")).select("x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,10.0)" in plan and "ReadSchema: struct<x:double>" in plan and "Python" not in plan


def test_what_is_not_native(spark):
    df = spark.createDataFrame([("{}",)], "s string")
    for schema in ({"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"n": {"$ref": "#/$defs/n"}}}}}, {"anyOf": [{"properties": {"a": {}}}], "unevaluatedProperties": False}, {"const": {"a": 1}}):
        assert Contract(schema).tier_for(df, "s").startswith("general: ")
        with pytest.raises(NotNative):
            Contract(schema, tier="native").tier_for(df, "s")


def test_split_report_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n long, valid string")
    contract = Contract({"properties": {"n": {"maximum": 2}}})
    with pytest.raises(ValueError, match="prefix"):
        contract.validate(df)
    assert contract.validate(df, prefix="c_").where("c_valid").count() == 2
    good, bad = contract.split(df.drop("valid"))
    assert good.count() == 2 and bad.first().n == 3 and {e.code for e in bad.first().errors} == {"property_mismatch", "value_above_maximum"}
    assert {(r.code, r.n) for r in contract.report(df).collect()} == {("property_mismatch", 1), ("value_above_maximum", 1)}
    assert contract.validate(df.drop("valid").limit(0)).count() == 0


def test_defaults(spark):
    c = Catalog()
    c.register_default_function("now", now)
    schema = {"$defs": {"d": {"default": "ref"}}, "properties": {"country": {"default": "US"}, "active": {"default": True}, "r": {"$ref": "#/$defs/d"}, "n": {"anyOf": [{"default": 5}, {"type": "null"}]}, "at": {"default": "now(2006)"}, "u": {"default": "missing()"}, "list": {"items": {"properties": {"q": {"default": 1}}}}, "none": {"default": None}}}
    node = c.compile(schema)
    got = defaults.fill(node, {"active": None, "n": None, "list": [{}, {"q": 2}]})
    assert got["country"] == "US" and got["active"] is None and got["r"] == "ref" and got["n"] == 5 and len(got["at"]) == 4 and got["u"] == "missing()" and got["list"] == [{"q": 1}, {"q": 2}] and "none" not in got
    with pytest.raises(defaults.DefaultLoop):
        defaults.fill(c.compile({"$ref": "#/$defs/loop", "$defs": {"loop": {"properties": {"x": {"$ref": "#/$defs/loop", "default": {}}}}}}), {})
    df = spark.createDataFrame([("{}", None, (None, 2)), ('{"country":"DE"}', "x", None)], "j string, s string, e struct<a:long,b:long>")
    contract = Contract({"properties": {"country": {"default": "US"}, "s": {"default": "d"}, "e": {"properties": {"a": {"default": 7}}}, "new": {"default": 1}}})
    assert [json.loads(r.j)["country"] for r in contract.with_defaults(df, "j").collect()] == ["US", "DE"]
    assert [(r.s, r.e and tuple(r.e), r.new) for r in contract.with_defaults(df).collect()] == [("d", (7, 2), 1), ("x", None, 1)]


def test_unmarshal_marshal_and_codecs(spark):
    from pactlake.plans.schema import marshal

    doc = {"type": "object", "x-own": 1, "properties": {"a": {"type": "integer", "default": 4}, "b": {"type": "string"}}, "required": ["b"]}
    df = spark.createDataFrame([('{"b":"x","c":1}',), ('{"a":9,"b":"y"}',), ("nope",)], "j string")
    assert [r.j and tuple(r.j) for r in Contract(doc).unmarshal(df, "j").collect()] == [(4, "x"), (9, "y"), None]
    assert "x-own" not in marshal(Catalog().compile(doc)) and '"x-own":1' in marshal(Catalog(preserve_extra=True).compile(doc))
    loose = Contract({"type": "number"}, Catalog(decode=lambda t: float(t)))
    assert loose.evaluate(b" 1.5 ").valid and not loose.evaluate(b"x").valid


def test_builders():
    doc = B.object_(B.prop("id", B.positive_int()), B.prop("mail", B.email()), B.prop("tags", B.array(B.items(B.string(B.min_length(1))), B.unique_items(True))), B.required("id"), B.additional_props(False))
    node = Catalog(assert_format=True).compile(doc)
    assert evaluate(node, {"id": 1, "mail": "a@b.c", "tags": ["x"]}).valid and not evaluate(node, {"id": 0}).valid
    assert B.if_(B.const(1)).then(B.any_()).else_(B.not_(B.null())) == {"if": {"const": 1}, "then": {}, "else": {"not": {"type": "null"}}}
    assert B.one_of(B.enum(1, 2), B.ref("#/x")) == {"oneOf": [{"enum": [1, 2]}, {"$ref": "#/x"}]}


def test_inference_and_back():
    tag = lambda rules, **more: {"rules": rules, **more}
    kind = T.StructType([T.StructField("id", T.LongType(), False, tag("required,minimum=1")), T.StructField("name", T.StringType(), True, tag("minLength=2,maxLength=5,pattern=^[a-z,]+$", comment="who")), T.StructField("tags", T.ArrayType(T.StringType()), True, tag("minItems=1,minLength=3,uniqueItems")), T.StructField("kind", T.StringType(), True, tag("enum=a b,default=a", json="type")), T.StructField("secret", T.StringType(), True, {"json": "-"}), T.StructField("at", T.TimestampType()), T.StructField("dep", T.StringType(), True, tag("dependentRequired=x,y,z")), T.StructField("q", T.StringType(), True, tag("shout"))])
    doc = inference.from_struct_type(kind, custom={"shout": lambda t, p: {"pattern": "^[A-Z]+$"}})
    props = doc["properties"]
    assert doc["required"] == ["id"] and props["name"] == {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z,]+$", "description": "who"}
    assert props["tags"] == {"type": "array", "items": {"type": "string", "minLength": 3}, "minItems": 1, "uniqueItems": True}
    assert props["type"] == {"type": "string", "enum": ["a", "b"], "default": "a"} and "secret" not in props and props["at"]["format"] == "date-time"
    assert props["dep"]["dependentRequired"] == {"x": ["y", "z"]} and props["q"]["pattern"] == "^[A-Z]+$"
    node = Catalog().compile(doc)
    back = inference.to_struct_type(node)
    assert back["id"].dataType == T.LongType() and not back["id"].nullable and back["tags"].dataType == T.ArrayType(T.StringType())
    space: dict = {}
    exec(inference.to_module(node), space)
    assert space["SCHEMA"] == back


@pytest.mark.parametrize("rules", ["minLenght=2", "minLength=2,requird", "maximum=x", "=3", "no_such"])
def test_rules_that_are_not_known(rules):
    kind = T.StructType([T.StructField("a", T.StringType(), metadata={"rules": rules})])
    with pytest.raises(ValueError, match="rule"):
        inference.from_struct_type(kind)


def test_cycles_on_one_value_and_marks_of_items():
    own = Catalog()
    node = own.compile({"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"k": True}, "additionalProperties": False, "minProperties": 1, "anyOf": [{"$ref": "#/$defs/a"}]}}})
    found = [(p, e.code) for p, e in evaluate(node, {"x": 1}).flat()]
    assert ("", "additional_property_false") in found and ("", "additional_property_mismatch") in found
    assert evaluate(node, {"k": 1}).valid and not evaluate(node, {}).valid
    nested = own.compile({"unevaluatedItems": {"type": "array", "prefixItems": [True, True]}})
    assert evaluate(nested, [[1, 2], 5]).valid and not evaluate(nested, [[1], 5, 6]).valid


def test_structures_mark_what_references_looked_at(spark):
    df = spark.createDataFrame([(1, "x", None)], "a long, b string, c string")
    schema = {"allOf": [{"properties": {"b": {"type": "string"}}}], "properties": {"a": True}, "additionalProperties": False}
    assert [Contract(schema, struct_mode=m).validate(df).first().valid for m in (True, False)] == [True, False]


def test_generated_modules(tmp_path):
    from pactlake.functions import codegen

    point = T.StructType([T.StructField("x", T.DoubleType(), metadata={"rules": "minimum=0,required"}), T.StructField("tag", T.StringType(), metadata={"rules": "enum=a|b,pattern=^[ab]$"})])
    line = T.StructType([T.StructField("from", point), T.StructField("to", point), T.StructField("names", T.ArrayType(T.StringType()), metadata={"rules": "minItems=1,minLength=2"}), T.StructField("on", T.TimestampType())])
    types = {"line": line, "point": point}
    (tmp_path / "types.json").write_text(json.dumps({n: t.jsonValue() for n, t in types.items()}))
    out = tmp_path / "made.py"
    assert codegen.main([str(tmp_path / "types.json"), "-o", str(out)]) == 0
    assert codegen.main([str(tmp_path / "types.json"), "-o", str(out), "--check"]) == 0
    made: dict = {}
    exec(out.read_text(), made)  # noqa: S102
    assert made["LINE"] == line and made["point_schema"]() == {k: v for k, v in inference.from_struct_type(point).items() if k != "$schema"}
    assert made["line_schema"]()["properties"]["from"] == {"$ref": "#/$defs/point"} and "point" in made["line_schema"]()["$defs"]
    node = Catalog().compile(made["line_schema"]())
    for value in ({"from": {"x": 1, "tag": "a"}}, {"to": {"x": -1}}, {"from": {}}, {"names": ["a"]}, {"names": []}, {"on": 5}, {}):
        assert evaluate(node, value).valid == evaluate(Catalog().compile(inference.from_struct_type(line)), value).valid
    out.write_text("")
    assert codegen.main([str(tmp_path / "types.json"), "-o", str(out), "--check"]) == 1
    for doc in ({"type": ["string", "null"], "maxLength": 3}, {"anyOf": [{"const": 1}, {"type": "object", "required": ["a"], "x-own": 2}]}, {"if": {"minimum": 1}, "then": False, "items": True, "examples": [1, "b"]}, {"$ref": "#/$defs/a", "$defs": {"a": {"not": {"type": "null"}}}}):
        assert eval(codegen.source(doc), {"B": B}) == doc  # noqa: S307


def test_streams(spark, tmp_path):
    from pactlake.streaming.contracts import quarantine

    spark.range(100).selectExpr("id", "cast(id % 10 as double) v").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v double").parquet(f"{tmp_path}/in")
    q = quarantine(stream, Contract({"properties": {"v": {"maximum": 6}}}), None, valid_path=f"{tmp_path}/ok", invalid_path=f"{tmp_path}/bad", checkpoint=f"{tmp_path}/ck", available_now=True)
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 70 and spark.read.parquet(f"{tmp_path}/bad").count() == 30


def test_general_tier_on_streams(spark, tmp_path):
    spark.createDataFrame([('{"k":1}',), ('{"k":"x"}',)], "s string").write.text(f"{tmp_path}/in")
    contract = Contract({"properties": {"k": {"type": "integer"}}}, tier="general")
    stream = spark.readStream.text(f"{tmp_path}/in")
    q = contract.validate(stream, "value").writeStream.format("memory").queryName("checked").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and sorted(r.valid for r in spark.table("checked").collect()) == [False, True]


def test_sources(spark, tmp_path):
    from pactlake.sources import json_text

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"type":"object","properties":{"b":{"$ref":"b.json"}}}')
    (tmp_path / "s" / "b.json").write_text('{"type":"string"}')
    nodes = json_text.compile_folder(spark, f"file://{tmp_path}/s")
    a = next(n for u, n in nodes.items() if u.endswith("a.json"))
    assert evaluate(a, {"b": "x"}).valid and not evaluate(a, {"b": 1}).valid
    assert json_text.json_documents(spark, f"file://{tmp_path}/s").count() == 2 and json_text.json_lines(spark, f"file://{tmp_path}/s").count() == 2
