"""Queries of results, typed rows, defaults, inference, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.catalogue import query, table
from pactlake.catalogue_values import made
from pactlake.functions.inference import from_struct_type, to_struct_type
from pactlake.operators.contract import Contract
from pactlake.plans.catalog import Catalog
from pactlake.streaming.contracts import quarantine, scratch

_K = "cast(json_extract(props, '$.k') as int)"
_LINE = ("l_orderkey", "l_linenumber")
_QUANTITY = "cast(cast(l_quantity as bigint) as varchar)"


@query("out_messages", f"select l_orderkey, l_linenumber, '/l_quantity' path, 'minimum' keyword, {_QUANTITY} || ' should be at least 10' message from lineitem where l_quantity < 10 union all select l_orderkey, l_linenumber, '/l_quantity', 'maximum', {_QUANTITY} || ' should be at most 40' from lineitem where l_quantity > 40 union all select l_orderkey, l_linenumber, '/l_returnflag', 'enum', 'Value ' || l_returnflag || ' should be one of the allowed values: [\"A\",\"R\"]' from lineitem where l_returnflag not in ('A', 'R') union all select l_orderkey, l_linenumber, '', 'properties', case when l_returnflag in ('A', 'R') then 'Property l_quantity does not match the schema' when l_quantity between 10 and 40 then 'Property l_returnflag does not match the schema' else 'Properties l_quantity, l_returnflag do not match their schemas' end from lineitem where l_returnflag not in ('A', 'R') or l_quantity not between 10 and 40")
def out_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract({"properties": {"l_quantity": {"minimum": 10, "maximum": 40}, "l_returnflag": {"enum": ["A", "R"]}}}, tier="native")
    return contract.error_rows(table(spark, sf_dir, "lineitem"), keys=[*_LINE]).drop("code")


@query("out_nested_errors", f"select event_id, '/k' path, 'value_below_minimum' code, cast({_K} as varchar) || ' should be at least 50' message from events where {_K} < 50 union all select event_id, '', 'property_mismatch', 'Property k does not match the schema' from events where {_K} < 50 union all select event_id, '', 'one_of_item_mismatch', 'Value does not match the oneOf schema' from events where {_K} >= 60 and {_K} % 2 = 1 union all select event_id, '', 'one_of_multiple_matches', 'Value should match exactly one schema but matches multiple at indexes 0, 1' from events where {_K} < 60 and {_K} % 2 = 0 union all select event_id, '/k', 'value_above_maximum', cast({_K} as varchar) || ' should be less than 60' from events where {_K} >= 60 and {_K} % 2 = 1 and false")
def out_nested_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors below the root and of oneOf, natively decided; what failed inside the branches is left out here."""
    schema = {"properties": {"k": {"minimum": 50}}, "oneOf": [{"properties": {"k": {"exclusiveMaximum": 60}}}, {"properties": {"k": {"multipleOf": 2}}}]}
    rows = Contract(schema, tier="native").error_rows(table(spark, sf_dir, "events"), "props", keys=["event_id"])
    branch = F.col("code").isin("exclusive_maximum_mismatch", "not_multiple_of") | (F.col("code") == "property_mismatch") & (F.get_json_object("props", "$.k").cast("int") >= 50)
    own = rows.join(table(spark, sf_dir, "events").select("event_id", "props"), "event_id").where(~branch)
    return own.select("event_id", "path", "code", "message").distinct()


@query("out_one_of_codes", "select k, case when k % 9 >= 4 and k % 7 >= 4 then null when k % 9 >= 4 or k % 7 >= 4 then '' else 'x' end is null many, not (k % 9 >= 4 or k % 7 >= 4) none from (select o_orderkey k from orders)")
def out_one_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).selectExpr("k", "k % 9 a", "k % 7 b")
    codes = F.transform(Contract({"oneOf": [{"properties": {"a": {"minimum": 4}}}, {"properties": {"b": {"minimum": 4}}}]}, tier="native").errors(df), lambda e: e["code"])
    return df.select("k", F.array_contains(codes, "one_of_multiple_matches").alias("many"), F.array_contains(codes, "one_of_item_mismatch").alias("none"))


@query("out_detailed", f"select event_id, '/k/minimum' place, cast({_K} as varchar) || ' should be at least 50' message from events where {_K} < 50 union all select event_id, '/properties', 'Property k does not match the schema' from events where {_K} < 50")
def out_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.explode(Contract({"properties": {"k": {"minimum": 50}}}).detailed_errors(df, "props")).alias("place", "message"))


@query("out_last_wins", "select k, case when k % 7 >= 4 then 'pattern_property_mismatch' else 'property_mismatch' end code from (select o_orderkey k from orders) where k % 9 >= 4 or k % 7 >= 4")
def out_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keywords that report as ``properties``: the later one's error stays."""
    df = made("'{\"a\": ' || cast(k % 9 as string) || ', \"b\": ' || cast(k % 7 as string) || '}'")(spark, sf_dir)
    schema = {"properties": {"a": {"exclusiveMaximum": 4}}, "patternProperties": {"^b": {"exclusiveMaximum": 4}}}
    return Contract(schema).error_rows(df, "s", keys=["k"]).where("keyword = 'properties'").select("k", "code")


@query("out_translated", f"select event_id, 'zu klein: ' || cast({_K} as varchar) message from events where {_K} < 50")
def out_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by a translator; codes that it does not know stay English."""
    contract = Contract({"properties": {"k": {"minimum": 50}}}, translate=lambda code, params: f"zu klein: {params['value']}" if code == "value_below_minimum" else None)
    return contract.error_rows(table(spark, sf_dir, "events"), "props", keys=["event_id"]).where("keyword = 'minimum'").select("event_id", "message")


@query("out_hierarchy", f"select event_id, {_K} >= 50 valid, case when {_K} >= 50 then 'low' end title, case when {_K} < 50 then cast({_K} as varchar) || ' should be at least 50' end message from events")
def out_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested list, with annotations where a part is valid and messages where it is not."""
    df = table(spark, sf_dir, "events")
    listing = Contract({"properties": {"k": {"minimum": 50, "title": "low"}}}).listing(df, "props")
    node = "valid boolean, errors map<string,string>, annotations struct<title:string>"
    got = df.select("event_id", F.from_json(listing, f"{node}, details array<struct<{node.replace(' ', ':', 1).replace(', errors ', ',errors:').replace(', annotations ', ',annotations:')}>>").alias("o"))
    return got.select("event_id", "o.valid", F.get("o.details", F.lit(0))["annotations"]["title"].alias("title"), F.get("o.details", F.lit(0))["errors"]["minimum"].alias("message"))


@query("src_binary", f"select event_id, event_id % 5 <> 0 and {_K} >= 20 valid, event_id % 5 = 0 malformed from events")
def src_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.unhex(F.lit("FF7B"))).otherwise(F.col("props").cast("binary")).alias("b"))
    checked = Contract({"properties": {"k": {"minimum": 20}}}).validate(df, "b")
    return checked.select("event_id", "valid", F.exists("errors", lambda e: e["code"] == "invalid_json").alias("malformed"))


@query("src_map", "select o_orderkey, o_orderkey % 7 <= 4 and o_custkey % 5 <= 4 and o_orderkey % 3 <> 0 valid from orders")
def src_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Z")).otherwise(F.lit("b"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("a"), F.col("o_orderkey") % 7, named, F.col("o_custkey") % 5).alias("m"))
    schema = {"additionalProperties": {"maximum": 4}, "minProperties": 2, "propertyNames": {"pattern": "^[a-z]$"}, "required": ["a"]}
    return df.select("o_orderkey", Contract(schema, tier="native").is_valid(df, "m").alias("valid"))


@query("src_variant", f"select event_id, {_K} between 20 and 60 valid from events")
def src_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    return df.select("event_id", Contract({"properties": {"k": {"type": "integer", "minimum": 20, "maximum": 60}}}, tier="native").is_valid(df, "v").alias("valid"))


@query("src_codec", f"select event_id, {_K} <= 30 valid from events")
def src_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder of one's own: lines of key=value."""
    own = Catalog(decode=lambda t: {k: int(v) for k, v in (p.split("=") for p in (t.decode() if isinstance(t, bytes) else t).split(";"))})
    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("s"))
    return df.select("event_id", Contract({"properties": {"k": {"maximum": 30}}}, own, tier="general").is_valid(df, "s").alias("valid"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows with missing, empty and filled fields."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "case o_orderkey % 3 when 0 then '' when 1 then 'x' end s", "case when o_orderkey % 4 < 2 then o_orderkey % 4 end n", "case o_orderkey % 5 when 0 then array() when 1 then array(1) end c")


_S, _N, _C = "(k % 3 = 1)", "(k % 4 < 2)", "(k % 5 = 1)"
_STRUCT = "from (select o_orderkey k from orders)"


@query("struct_required", f"select k, {_S} and {_N} and {_C} valid, cast({_S} as int) + cast({_N} as int) + cast({_C} as int) < 2 several {_STRUCT}")
def struct_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = Contract({"required": ["s", "n", "c"]}, struct_mode=True).validate(_rows(spark, sf_dir))
    return checked.select("k", "valid", F.exists("errors", lambda e: e["message"].startswith("Required properties ")).alias("several"))


@query("struct_rules", f"select k, cast({_S} as int) + cast({_N} as int) + cast({_C} as int) + 1 >= 3 counted, not {_S} or {_N} dependent, k % 3 = 2 and k % 5 > 1 additional, k % 4 > 1 named, not {_N} or k % 4 >= 1 patterned {_STRUCT}")
def struct_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows(spark, sf_dir)
    schemas = {"counted": {"minProperties": 3}, "dependent": {"dependentRequired": {"s": ["n"]}}, "additional": {"properties": {"k": True, "n": True}, "additionalProperties": False}, "named": {"propertyNames": {"enum": ["k", "s", "c"]}}, "patterned": {"patternProperties": {"^n": {"minimum": 1}}}}
    return df.select("k", *[Contract(s, struct_mode=True).is_valid(df).alias(n) for n, s in schemas.items()])


@query("null_fields", f"select k, {_N} as_null, true as_absent {_STRUCT}")
def null_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows(spark, sf_dir)
    flag = lambda how: Contract({"properties": {"n": {"type": "integer"}}}, null_means=how, tier="native").is_valid(df)
    return df.select("k", flag("null").alias("as_null"), flag("absent").alias("as_absent"))


@query("unmarshal", f"select event_id, {_K} k, 'none' tag, 7 as depth from events")
def unmarshal(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"type": "object", "properties": {"k": {"type": "integer"}, "tag": {"type": "string", "default": "none"}, "inner": {"type": "object", "default": {}, "properties": {"depth": {"type": "integer", "default": 7}}}}}
    made_ = Contract(schema).unmarshal(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return made_.select("event_id", "props.k", "props.tag", "props.inner.depth")


@query("defaults_nested", "select k, coalesce(case when k % 3 = 0 then k % 7 end, 5) a, 'u' b, case when k % 4 = 0 then 1 else 2 end c from (select o_orderkey k from orders)")
def defaults_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through references, inside objects and arrays, and anyOf defaults in place of null."""
    text = "'{\"o\": {' || case when k % 3 = 0 then '\"a\": ' || cast(k % 7 as string) else '' end || '}, \"l\": [{}], \"n\": ' || case when k % 4 = 0 then '1' else 'null' end || '}'"
    schema = {"properties": {"o": {"properties": {"a": {"$ref": "#/$defs/five"}}}, "l": {"items": {"properties": {"b": {"default": "u"}}}}, "n": {"anyOf": [{"default": 2}, {"type": "null"}]}}, "$defs": {"five": {"default": 5}}}
    filled = Contract(schema).with_defaults(made(text)(spark, sf_dir), "s")
    return filled.select("k", *[F.get_json_object("s", p).cast(t).alias(n) for p, t, n in (("$.o.a", "int", "a"), ("$.l[0].b", "string", "b"), ("$.n", "int", "c"))])


@query("defaults_functions", "select count(*) n, count(*) distinct_ids, count(*) tagged from orders")
def defaults_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of each row, and one that is a column expression."""
    own = Catalog()
    own.register_default_function("uuid", lambda: str(uuid.uuid4()))
    own.register_default_function("tag", lambda kind: F.concat(F.lit(kind), F.col("o_orderstatus")))
    schema = own.compile({"properties": {"id": {"default": "uuid()"}, "tag": {"default": "tag(s-)"}}})
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("tag"))
    return Contract(schema).with_defaults(df).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct_ids"), F.count_if(F.col("tag") == F.concat(F.lit("s-"), "o_orderstatus")).alias("tagged"))


@query("inferred_rules", "select c_custkey, length(c_name) <= 18 and regexp_matches(c_name, '^Customer') and c_mktsegment in ('BUILDING', 'AUTOMOBILE', 'MACHINERY') and c_nationkey between 2 and 20 and c_nationkey % 2 = 0 and c_acctbal > 0 valid from customer")
def inferred_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"c_name": "required,minLength=5,maxLength=18,pattern=^Customer", "c_mktsegment": "enum=BUILDING|AUTOMOBILE|MACHINERY,title=segment", "c_nationkey": "minimum=2,maximum=20,multipleOf=2", "c_acctbal": "exclusiveMinimum=0,even"}
    df = table(spark, sf_dir, "customer")
    tagged = df.withColumns({c: F.col(c).alias(c, metadata={"rules": r}) for c, r in rules.items()})
    document = from_struct_type(tagged.schema, custom={"even": lambda kind, parameters: {"description": "a rule of one's own"}})
    return df.select("c_custkey", Contract(document, tier="native").is_valid(df).alias("valid"))


@query("inferred_combinators", "select c_custkey, (c_nationkey = 3 or c_nationkey >= 10) and c_nationkey <> 12 and (c_mktsegment <> 'BUILDING' or c_acctbal >= 0) valid from customer")
def inferred_combinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"c_nationkey": 'anyOf=3,{"minimum": 10},not=12', "c_mktsegment": "title=segment", "c_acctbal": "title=balance"}
    df = table(spark, sf_dir, "customer")
    tagged = df.withColumns({c: F.col(c).alias(c, metadata={"rules": r}) for c, r in rules.items()})
    extra = {"if": {"properties": {"c_mktsegment": {"const": "BUILDING"}}}, "then": {"properties": {"c_acctbal": {"minimum": 0}}}}
    return df.select("c_custkey", Contract(from_struct_type(tagged.schema, extra=extra), tier="native").is_valid(df).alias("valid"))


@query("schema_types", "select * from (values ('a', 'bigint'), ('b', 'double'), ('c', 'array<boolean>'), ('d', 'map<string,string>'), ('e', 'struct<x:timestamp>'), ('f', 'date')) t(name, type)")
def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the objects that a schema describes."""
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": ["number", "null"]}, "c": {"type": "array", "items": {"type": "boolean"}}, "d": {"type": "object", "additionalProperties": {"type": "string"}}, "e": {"$ref": "#/$defs/e"}, "f": {"type": "string", "format": "date"}}, "$defs": {"e": {"type": "object", "properties": {"x": {"type": "string", "format": "date-time"}}}}}
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in to_struct_type(Catalog().compile(schema))], "name string, type string")


@query("metaschema_documents", "select k, case k % 6 when 0 then true when 2 then true when 4 then true else false end valid from (select o_orderkey k from orders)")
def metaschema_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactlake.operators.contract import metaschema_errors

    draft = '{"$schema": "http://json-schema.org/draft-04/schema#", '
    texts = ['{"type": "string"}', '{"type": "text"}', draft + '"exclusiveMinimum": true, "minimum": 1}', draft + '"exclusiveMinimum": 1}', "true", '{"required": "a"}']
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.get(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % 6).cast("int")).alias("doc"))
    return metaschema_errors(spark, df, "doc").select("k", "valid")


@query("stream_quarantine", "select o_orderkey, o_orderstatus = 'F' kept from orders")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the table's files, valid and invalid rows apart."""
    at = f"{scratch(spark)}/quarantine-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")
    run = quarantine(stream, Contract({"properties": {"o_orderstatus": {"const": "F"}}}), None, valid_path=f"{at}/good", invalid_path=f"{at}/bad", checkpoint=f"{at}/checkpoint", available_now=True)
    run.awaitTermination()
    read = lambda d, kept: spark.read.schema("o_orderkey long").parquet(f"{at}/{d}").select("o_orderkey", F.lit(kept).alias("kept"))
    return read("good", True).union(read("bad", False))
