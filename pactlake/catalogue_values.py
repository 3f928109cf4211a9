"""Queries of formats, content, references, dialects and numbers over made-up texts.

The texts are made from the keys of ``orders`` by one SQL expression that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.catalogue import ORACLES, query, table
from pactlake.functions import builders as B
from pactlake.operators.contract import Contract
from pactlake.plans.catalog import Catalog


def made(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.expr(text).alias("s"))


def texts(name: str, text: str, schema: Any, valid: str, *, tier: str = "auto", column: str | None = "s", catalog: Callable[[], Catalog] = Catalog) -> None:
    """Registers the validity of a JSON text (or, without a column, of rows with a text s) made from a key k."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = made(text)(spark, sf_dir)
        own = catalog()
        return df.select("k", Contract(schema(own) if callable(schema) else schema, own, tier=tier).is_valid(df, column).alias("valid"))

    query(name, f"select k, {valid} valid from (select k, {text} s from (select o_orderkey k from orders))")(run)


def two(n: str) -> str:
    return f"lpad(cast({n} as string), 2, '0')"


def of(n: str) -> str:
    return f"cast({n} as string)"


def cases(*texts_: str) -> str:
    """One of several texts, by the key."""
    whens = " ".join(f"when {i} then {t}" for i, t in enumerate(texts_))
    return f"case k % {len(texts_)} {whens} end"


def is_case(n: int, *good: int) -> str:
    return f"k % {n} in ({', '.join(map(str, good))})"


_DATE = f"'20' || {two('k % 30')} || '-' || {two('1 + k % 13')} || '-' || {two('1 + k % 31')}"
_TIME = f"{two('k % 26')} || ':' || {two('k % 61')} || ':' || {two('k % 62')} || case k % 3 when 0 then 'Z' when 1 then '+00:00' else '' end"
_FORMATS: dict[str, tuple[str, str]] = {
    "date": (_DATE, "try_cast(s as date) is not null"),
    "time": (_TIME, "k % 3 < 2 and k % 26 < 24 and k % 61 < 60 and (k % 62 < 60 or k % 62 = 60 and k % 26 = 23 and k % 61 = 59)"),
    "date-time": (f"{_DATE} || 'T10:20:30' || case when k % 7 = 0 then '' else '-01:30' end", "k % 7 <> 0 and try_cast(substr(s, 1, 10) as date) is not null"),
    "duration": (cases(f"'P' || {of('k')} || 'D'", f"'PT' || {of('k')} || 'M'", f"'P' || {of('k')}", f"'P1Y' || {of('k')} || 'D'", f"'P' || {of('k')} || 'W'", "'PT'"), is_case(6, 0, 1, 4)),
    "period": (cases("'2024-01-01T00:00:00Z/P1D'", f"'2024-01-01T00:00:00Z/2024-02-' || {two('1 + k % 28')} || 'T00:00:00Z'", "'P1M/2024-01-01T00:00:00Z'", "'2024-01-01T00:00:00Z'", "'P1D/P1D'"), is_case(5, 0, 1, 2)),
    "hostname": (cases(f"'host-' || {of('k')} || '.example'", f"'-h' || {of('k')}", f"'h' || {of('k')} || '-.x'", f"'a_' || {of('k')}", f"'h' || {of('k')} || '.'", "repeat('a', 64)"), is_case(6, 0, 4)),
    "email": (cases(f"'u' || {of('k')} || '@example.com'", f"'u ' || {of('k')} || '@example.com'", f"'u' || {of('k')}", f"'u' || {of('k')} || '@[127.0.0.1]'", f"'u' || {of('k')} || '@-x'"), is_case(5, 0, 3)),
    "ipv4": (f"{of('k % 300')} || '.0.' || {of('k % 7')} || '.' || case when k % 11 = 0 then '07' else '1' end", "k % 300 < 256 and k % 11 <> 0"),
    "ipv6": (cases("'2001:db8::' || lower(hex(k % 65536))", "'::ffff:10.0.0.1'", "'12345::' || lower(hex(k % 65536))", "'fe80::1%eth0'", "'1.2.3.4'"), is_case(5, 0, 1)),
    "uri": (cases(f"'http://h/' || {of('k')}", f"'/p/' || {of('k')}", f"'urn:x:' || {of('k')}", "'http://h/a b'"), is_case(4, 0, 2)),
    "iri": (cases(f"'http://h/' || {of('k')}", f"'p/' || {of('k')}", "'mailto:a@b'"), is_case(3, 0, 2)),
    "uri-reference": (cases(f"'/p/' || {of('k')}", f"chr(92) || 'p' || {of('k')}", f"'http://h/' || {of('k')}", "'a b'"), is_case(4, 0, 2)),
    "iri-reference": (cases(f"'#f' || {of('k')}", "chr(92) || chr(92) || 'h'", f"'p?q=' || {of('k')}"), is_case(3, 0, 2)),
    "uri-template": (cases(f"'/p/{{id}}/' || {of('k')}", "'/p/{id'", "'/p/id}'", "'/p/{{id}}'"), is_case(4, 0)),
    "json-pointer": (cases(f"'/a/' || {of('k')}", f"'a' || {of('k')}", "'/a~'", "''", "'/a~1b~0'", "'/~2'"), is_case(6, 0, 3, 4)),
    "relative-json-pointer": (cases(f"{of('k')} || '/a'", f"{of('k')} || '#'", "'-1/a'", f"'0' || {of('1 + k')}", "'0'", "'/a'"), "k % 6 in (0, 1, 4)"),
    "uuid": (cases("lpad(lower(hex(k)), 8, '0') || '-0000-4000-8000-' || lpad(hex(k), 12, '0')", "lpad(lower(hex(k)), 8, '0') || '00004000-8000-' || lpad(hex(k), 12, '0')", "'g0000000-0000-4000-8000-000000000000'"), is_case(3, 0)),
    "regex": (cases(f"'^a{{' || {of('1 + k % 9')} || '}}$'", "'(a'", "'a(?=b)'", "'[a-z]+'", "'*'"), is_case(5, 0, 3)),
    "unknown": (of("k"), "true"),
}
_FORMATS["regex"] = (_FORMATS["regex"][0].replace("{{", "{").replace("}}", "}"), _FORMATS["regex"][1])
for _name, (_text, _valid) in _FORMATS.items():
    texts("format_" + _name.replace("-", "_"), _text, {"properties": {"s": {"format": _name}}}, _valid, column=None, catalog=lambda: Catalog(assert_format=True))
texts("format_annotation", "'no date'", {"properties": {"s": {"format": "date"}}}, "true", column=None)
texts("format_unregistered", of("k"), {"properties": {"s": {"format": "no-such-format"}}}, "false", column=None, catalog=lambda: Catalog(assert_format=True))


def _own_format() -> Catalog:
    own = Catalog(assert_format=True)
    own.register_format("even", lambda v: int(v) % 2 == 0, "string")
    own.register_format("date", lambda v: v.endswith("7"), "string")  # in place of the built-in
    own.register_format("gone", lambda v: False)
    own.unregister_format("gone")
    return own


texts("format_custom", of("k"), {"properties": {"s": {"anyOf": [{"format": "even"}, {"format": "date"}]}}}, "k % 2 = 0 or k % 10 = 7", column=None, catalog=_own_format)


@query("format_convenience", " union all ".join(f"select '{n}' name, (select count(*) from ({ORACLES['format_' + n.replace('-', '_')]}) where valid) n" for n in ("email", "date-time", "date", "time", "uri", "uri-reference", "uuid", "hostname", "ipv4", "ipv6", "iri", "iri-reference", "uri-template", "json-pointer", "relative-json-pointer", "duration", "regex")) + " union all select 'idn-email', 0 union all select 'idn-hostname', 0")
def format_convenience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each format's texts its convenience schema takes."""
    made_by = {"email": B.email, "date-time": B.date_time, "date": B.date, "time": B.time, "uri": B.uri, "uri-reference": B.uri_ref, "uuid": B.uuid, "hostname": B.hostname, "ipv4": B.ipv4, "ipv6": B.ipv6, "iri": B.iri, "iri-reference": B.iri_ref, "uri-template": B.uri_template, "json-pointer": B.json_pointer, "relative-json-pointer": B.relative_json_pointer, "duration": B.duration, "regex": B.regex, "idn-email": B.idn_email, "idn-hostname": B.idn_hostname}
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(*[F.expr(_FORMATS.get(n, _FORMATS["email"])[0]).alias(n) for n in made_by])
    schemas = {n: Contract(B.object_(B.prop(n, f())), Catalog(assert_format=True)) for n, f in made_by.items()}
    counts = df.agg(*[F.count_if(c.is_valid(df)).alias(n) for n, c in schemas.items()])
    return counts.unpivot([], [F.col(f"`{n}`") for n in made_by], "name", "n")


@query("builder_integers", "select l_orderkey, l_linenumber, l_quantity - 25 >= 1 positive, l_quantity - 25 >= 0 non_negative, l_quantity - 25 <= -1 negative, l_quantity - 25 <= 0 non_positive from lineitem")
def builder_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("n"))
    made_by = {"positive": B.positive_int, "non_negative": B.non_negative_int, "negative": B.negative_int, "non_positive": B.non_positive_int}
    return df.select("l_orderkey", "l_linenumber", *[Contract(B.object_(B.prop("n", f())), tier="native").is_valid(df).alias(n) for n, f in made_by.items()])


# Numbers beyond doubles and 38 digits

_BIG = cases(f"'{{\"n\": ' || {of('1 + k')} || repeat('0', 40) || '}}'", "'{\"n\": -0.0000000000001}'", "'{\"n\": 1e30}'", "'{\"n\": 0.00000000000000000001}'", f"'{{\"n\": ' || {of('k % 9')} || '}}'").replace("}}", "}").replace("{{", "{")
texts("kw_big_numbers", _BIG, {"properties": {"n": {"type": "integer", "minimum": 0, "multipleOf": 2}}}, "case k % 5 when 0 then true when 2 then true when 4 then k % 9 % 2 = 0 else false end")
texts("kw_big_constants", _BIG, {"properties": {"n": {"enum": [10**30, -1e-13, 4]}}}, "k % 5 in (1, 2) or k % 5 = 4 and k % 9 = 4")

# Equality, nested constants, uniqueness

_NESTED = cases(f"'{{\"a\": [1.0, {{\"x\": null}}], \"b\": ' || {of('k % 3')} || '}}'", "'{\"b\": 0, \"a\": [1, {\"x\": null}]}'", "'{\"a\": [1]}'").replace("}}", "}").replace("{{", "{")
texts("kw_nested_constant", _NESTED, {"const": {"a": [1, {"x": None}], "b": 0}}, "k % 3 in (0, 1)")
texts("kw_nested_unique", cases("'[{\"a\": 1}, {\"a\": 1.0}]'", "'[[1, 2], [2, 1]]'", "'[\"1\", 1, null, true]'", "'[0, false, 0.0]'"), {"uniqueItems": True}, is_case(4, 1, 2))

# Content

_HEX = "lower(hex(k))"


def _codecs() -> Catalog:
    own = Catalog()
    own.register_decoder("hex", bytes.fromhex)
    own.register_media_type("text/count", lambda raw: len(raw))
    return own


texts("content_decoder", f"lpad({_HEX}, case when k % 5 = 0 then 3 else 8 end, '0')", {"properties": {"s": {"contentEncoding": "hex", "contentMediaType": "text/count", "contentSchema": {"const": 4}}}}, "length(s) = 8", column=None, catalog=_codecs)
texts("content_unsupported", of("k"), {"properties": {"s": {"contentEncoding": "base32"}}}, "false", column=None)
texts("content_xml", cases(f"'<a>' || {of('k')} || '</a>'", f"'<a>' || {of('k')}", "'<a/>'"), {"properties": {"s": {"contentMediaType": "application/xml"}}}, is_case(3, 0, 2), column=None)
texts("content_yaml", cases(f"'a: ' || {of('k % 50')}", "'a: [1'", f"'{{a: ' || {of('k % 50')} || '}}'").replace("{{", "{").replace("}}", "}"), {"properties": {"s": {"contentMediaType": "application/yaml", "contentSchema": {"required": ["a"], "properties": {"a": {"maximum": 20}}}}}}, "k % 3 <> 1 and k % 50 <= 20", column=None)

# Recursion, dynamic scope, identifiers, documents that load others

_CHAIN = "'{\"k\": ' || cast(k % 100 as string) || ', \"next\": {\"k\": ' || cast(k * 7 % 100 as string) || ', \"next\": {\"k\": ' || cast(k * 13 % 100 as string) || '}}}'"
_LINK = {"properties": {"k": {"minimum": 5}, "next": {"$ref": "#/$defs/node"}}}
texts("ref_recursive", _CHAIN, {"$ref": "#/$defs/node", "$defs": {"node": _LINK}}, "k % 100 >= 5 and k * 7 % 100 >= 5 and k * 13 % 100 >= 5")
_BASE = {"$id": "urn:base", "$dynamicAnchor": "n", "properties": {"k": {"minimum": 0}, "next": {"$dynamicRef": "#n"}}}
texts("ref_dynamic", _CHAIN, {"$id": "urn:outer", "$dynamicAnchor": "n", "$ref": "urn:base", "properties": {"k": {"maximum": 60}}, "$defs": {"base": _BASE}}, "k % 100 <= 60 and k * 7 % 100 <= 60 and k * 13 % 100 <= 60")
texts("ref_static_scope", _CHAIN, {"$id": "urn:outer", "$ref": "urn:base", "properties": {"k": {"maximum": 60}}, "$defs": {"base": _BASE}}, "k % 100 <= 60")
_OLD = "https://json-schema.org/draft/2019-09/schema"
texts("ref_recursive_anchor", _CHAIN, {"$schema": _OLD, "$id": "urn:outer", "$recursiveAnchor": True, "$ref": "urn:base", "properties": {"k": {"maximum": 60}}, "$defs": {"base": {"$id": "urn:base", "$recursiveAnchor": True, "properties": {"next": {"$recursiveRef": "#"}}}}}, "k % 100 <= 60 and k * 7 % 100 <= 60 and k * 13 % 100 <= 60")
texts("ref_cycle", _CHAIN, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"k": {"minimum": 5}}, "allOf": [{"$ref": "#/$defs/b"}]}, "b": {"anyOf": [{"$ref": "#/$defs/a"}]}}}, "k % 100 >= 5")
texts("ref_anchor", _CHAIN, {"$id": "http://h/root", "properties": {"k": {"$ref": "#low"}, "next": {"$ref": "part"}}, "$defs": {"l": {"$anchor": "low", "maximum": 50}, "p": {"$id": "part", "properties": {"k": {"$ref": "root#/$defs/l"}}}}}, "k % 100 <= 50 and k * 7 % 100 <= 50")


def _loaded(own: Catalog) -> Any:
    own.register_loader("mem", lambda uri: {"mem:low": '{"properties": {"k": {"$ref": "mem:bound"}}}', "mem:bound": '{"maximum": 50}'}[uri])
    return {"$ref": "mem:low"}


def _batch(own: Catalog) -> Any:
    compiled = own.compile_batch({"urn:a": {"properties": {"k": {"$ref": "urn:b#/$defs/low"}}}, "urn:b": {"$defs": {"low": {"maximum": 50}}}})
    return compiled["urn:a"]


def _late(own: Catalog) -> Any:
    first = own.compile({"properties": {"k": {"$ref": "urn:late"}}}, "urn:first")
    assert own.unresolved_references() == ["urn:late"]
    own.compile({"maximum": 50}, "urn:late")
    return own.schema("urn:first") if first is own.schema("urn:first") else False


def _set(own: Catalog) -> Any:
    own.set_schema("urn:mine", own.compile({"maximum": 50}))
    return {"properties": {"k": {"$ref": "urn:mine"}}}


for _name, _schema in (("catalog_loader", _loaded), ("catalog_batch", _batch), ("catalog_late", _late), ("catalog_set_schema", _set)):
    texts(_name, _CHAIN, _schema, "k % 100 <= 50")
texts("catalog_base_uri", _CHAIN, lambda own: own.compile({"properties": {"k": {"$ref": "low"}}, "$defs": {"l": {"$id": "low", "maximum": 50}}}), "k % 100 <= 50", catalog=lambda: Catalog(base_uri="http://h/x/", preserve_extra=True))
texts("dialect_draft4", _CHAIN, {"properties": {"k": {"minimum": 10, "exclusiveMinimum": True}}}, "k % 100 > 10", catalog=lambda: Catalog(default_dialect="http://json-schema.org/draft-04/schema"))
texts("dialect_ref_siblings", _CHAIN, {"$schema": "http://json-schema.org/draft-07/schema#", "properties": {"k": {"$ref": "#/definitions/low", "minimum": 20}}, "definitions": {"low": {"maximum": 50}}}, "k % 100 <= 50")
texts("dialect_dependencies", _CHAIN, {"$schema": "http://json-schema.org/draft-07/schema#", "dependencies": {"k": ["next"], "next": {"properties": {"k": {"maximum": 50}}}}}, "k % 100 <= 50")
_LIST = "'[' || cast(k % 9 as string) || ', ' || cast(k % 7 as string) || ', ' || cast(k % 5 as string) || ']'"
texts("dialect_item_lists", _LIST, {"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"maximum": 4}], "additionalItems": {"minimum": 1}}, "k % 9 <= 4 and k % 7 >= 1 and k % 5 >= 1")
texts("kw_unevaluated_items", _LIST, {"prefixItems": [{"maximum": 6}], "unevaluatedItems": {"minimum": 2}}, "k % 9 <= 6 and k % 7 >= 2 and k % 5 >= 2")
texts("general_unevaluated_items", _LIST, {"anyOf": [{"prefixItems": [{"maximum": 3}]}, {"prefixItems": [True, {"maximum": 2}]}], "unevaluatedItems": {"minimum": 2}}, "(k % 9 <= 3 or k % 7 <= 2) and (k % 7 <= 2 or k % 7 >= 2) and k % 5 >= 2")
texts("general_unevaluated_contains", _LIST, {"contains": {"minimum": 4}, "unevaluatedItems": False}, "k % 9 >= 4 and k % 7 >= 4 and k % 5 >= 4")
texts("kw_contains_none", _LIST, {"contains": {"minimum": 4}, "minContains": 0, "maxContains": 1}, "cast(k % 9 >= 4 as int) + cast(k % 7 >= 4 as int) + cast(k % 5 >= 4 as int) <= 1")
texts("kw_closed_items", _LIST, {"prefixItems": [True, {"type": "integer"}], "items": {"not": {"const": 3}}}, "k % 5 <> 3")

_TREE = "'{\"a\": ' || cast(k % 10 as string) || case when k % 3 = 0 then ', \"b1\": ' || cast(k % 4 as string) else '' end || case when k % 4 = 0 then ', \"c\": null' else '' end || '}'"
texts("kw_pattern_props", _TREE, {"patternProperties": {"^b": {"minimum": 2}, "c$": {"type": "null"}}}, "k % 3 <> 0 or k % 4 >= 2")
texts("kw_false_property", _TREE, {"properties": {"b1": False, "a": True}}, "k % 3 <> 0")
texts("kw_null_value", _TREE, {"properties": {"c": {"const": None}}, "required": ["c"]}, "k % 4 = 0")
texts("kw_additional_schema", _TREE, {"properties": {"a": {}}, "additionalProperties": {"type": ["integer", "null"], "maximum": 2}}, "k % 3 <> 0 or k % 4 <= 2")
texts("kw_malformed", cases(_TREE, "'{\"a\": 1'", "'{\"a\": 1, \"a\": 2}'", "'{\"a\": 1} x'", "''", "'NaN'"), {"properties": {"a": {"minimum": 3}}}, "k % 6 = 0 and k % 10 >= 3")

# Builders

texts("builder_object", _TREE, B.object_(B.prop("a", B.integer(B.min_(1), B.max_(8), B.exclusive_min(0), B.exclusive_max(9), B.multiple_of(1))), B.required("a"), B.min_props(1), B.max_props(2), B.pattern_props({"^b": B.number(B.max_(2))}), B.property_names(B.string(B.max_length(2), B.min_length(1), B.pattern("^[a-c]"))), B.dependent_required({"c": ["a"]}), B.dependent_schemas({"b1": {"not": {"required": ["c"]}}}), B.additional_props_schema(B.null()), B.title("t"), B.description("d"), B.examples(1), B.deprecated(False), B.read_only(False), B.write_only(False)), "k % 10 between 1 and 8 and (k % 3 <> 0 or k % 4 <= 2) and not (k % 3 = 0 and k % 4 = 0)")
texts("builder_array", _LIST, B.array(B.items(B.integer()), B.min_items(3), B.max_items(3), B.unique_items(True), B.contains(B.number(B.min_(3))), B.min_contains(1), B.max_contains(2), B.prefix_items(B.any_(), B.not_(B.const(2))), B.unevaluated_items(False)), "k % 9 <> k % 7 and k % 9 <> k % 5 and k % 7 <> k % 5 and cast(k % 9 >= 3 as int) + cast(k % 7 >= 3 as int) + cast(k % 5 >= 3 as int) between 1 and 2 and k % 7 <> 2")
texts("builder_combined", _TREE, B.all_of(B.any_of(B.object_(B.prop("a", B.enum(1, 2, 3))), B.object_(B.required("c"))), B.one_of(B.object_(B.required("b1")), B.object_(B.prop("a", B.integer(B.min_(5))))), B.if_(B.object_(B.required("c"))).then(B.ref("#/allOf/0")).else_(B.any_(B.unevaluated_props(B.any_())))), "(k % 10 in (1, 2, 3) or k % 4 = 0) and ((k % 3 = 0) <> (k % 10 >= 5))")
texts("builder_identified", _TREE, {**B.any_(B.schema_uri("https://json-schema.org/draft/2020-12/schema"), B.id_("http://h/b"), B.defs({"low": B.any_(B.anchor("low"), B.max_(4)), "dyn": B.any_(B.dynamic_anchor("dyn"), B.min_(1))})), **B.object_(B.prop("a", B.all_of(B.ref("#low"), B.ref("#dyn"))), B.prop("b1", B.boolean()), B.additional_props(True), B.unevaluated_props(False), B.default(0))}, "k % 10 between 1 and 4 and k % 3 <> 0")
texts("builder_content", "'{\"a\": \"[' || cast(k % 10 as string) || ']\"}'", B.object_(B.prop("a", B.string(B.content_media_type("application/json"), B.content_schema(B.array(B.items(B.non_negative_int()), B.contains(B.number(B.min_(5)))))))), "k % 10 >= 5")
texts("builder_encoding", "'QUJD' || case when k % 3 = 0 then '%' else '' end", B.object_(B.prop("s", B.string(B.content_encoding("base64"), B.format_("uuid")))), "k % 3 <> 0", column=None)
