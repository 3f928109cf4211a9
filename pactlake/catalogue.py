"""Queries over the driver tables, one for each operator, and their SQL for another engine.

Every query compiles a contract and applies it; the SQL says the same by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.functions import builders as B
from pactlake.functions.inference import from_struct_type
from pactlake.operators.contract import Contract, validate_by_contract
from pactlake.plans.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(q: Query) -> Query:
        QUERIES[name] = q
        if sql:
            ORACLES[name] = sql
        return q

    return add


def flags(name: str, source: Callable[[SparkSession, str], DataFrame], keys: list[str], schema: Any, sql: str, column: str | None = None, **options: Any) -> None:
    """Registers keys and validity of each row under a contract."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog(assert_format=options.get("assert_format", False))
        df = source(spark, sf_dir)
        contract = Contract(schema, catalog, tier=options.get("tier", "native"))
        return df.select(*keys, contract.is_valid(df, column).alias("valid"))

    query(name, sql)(run)


def _of(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name).select(*columns) if columns else table(spark, d, name)


def _props(**schemas: Any) -> dict:
    return {"type": "object", "properties": schemas}


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each order's lines as an array."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("s")).select("l_orderkey", F.transform("s", lambda s: s["l_quantity"]).alias("q"))


_BASKETS = "(select l_orderkey, list(l_quantity order by l_linenumber, l_partkey, l_quantity) q from lineitem group by l_orderkey)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object for each document, with properties that are there or not."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    row = F.struct(d.doc_id.alias("doc_id"), F.when(d.lang == "en", d.source).alias("en_src"), l.quality.alias("quality"), F.nullif(l.toxic, F.lit(0)).alias("x-toxic"))
    return d.join(l, d.doc_id == l.doc_id, "left").select(d.doc_id, F.to_json(row).alias("j"))


_TAGGED = "(select d.doc_id, list_filter(['doc_id', case when d.lang='en' and d.source is not null then 'en_src' end, case when l.quality is not null then 'quality' end, case when nullif(l.toxic,0) is not null then 'x-toxic' end], lambda z: z is not null) k from documents d left join labels l on d.doc_id=l.doc_id)"
_LINE = ("l_orderkey", "l_linenumber")

flags("kw_type", _of("events"), ["event_id"], _props(value={"type": "integer"}), "select event_id, value=floor(value) valid from events")
flags("kw_enum", _of("lineitem"), [*_LINE], _props(l_returnflag={"enum": ["A", "R"]}), "select l_orderkey, l_linenumber, l_returnflag in ('A','R') valid from lineitem")
flags("kw_const", _of("orders"), ["o_orderkey"], _props(o_orderstatus={"const": "O"}), "select o_orderkey, o_orderstatus is not distinct from 'O' valid from orders")
flags("kw_bounds", _of("lineitem"), [*_LINE], _props(l_quantity={"minimum": 10, "maximum": 40}, l_discount={"exclusiveMinimum": 0}, l_tax={"exclusiveMaximum": 0.08}), "select l_orderkey, l_linenumber, l_quantity>=10 and l_quantity<=40 and l_discount>0 and l_tax<0.08 valid from lineitem")
flags("kw_multiple_of", _of("events"), ["event_id"], _props(value={"multipleOf": 0.05}), "select event_id, cast(cast(value as varchar) as decimal(28,10)) % cast(0.05 as decimal(28,10)) = 0 valid from events")
flags("kw_length", _of("documents"), ["doc_id"], _props(text={"minLength": 50, "maxLength": 5000}), "select doc_id, length(text) between 50 and 5000 valid from documents")
flags("kw_pattern", _of("part"), ["p_partkey"], _props(p_brand={"pattern": "^Brand#[1-3]"}), "select p_partkey, regexp_matches(p_brand,'^Brand#[1-3]') valid from part")
flags("kw_item_count", _baskets, ["l_orderkey"], _props(q={"minItems": 2, "maxItems": 5}), f"select l_orderkey, len(q) between 2 and 5 valid from {_BASKETS}")
flags("kw_unique_items", _baskets, ["l_orderkey"], _props(q={"uniqueItems": True}), f"select l_orderkey, len(list_distinct(q))=len(q) valid from {_BASKETS}")
flags("kw_contains", _baskets, ["l_orderkey"], _props(q={"contains": {"minimum": 30}, "minContains": 1, "maxContains": 3}), f"select l_orderkey, len(list_filter(q, lambda x: x>=30)) between 1 and 3 valid from {_BASKETS}")
flags("kw_prefix_items", _baskets, ["l_orderkey"], _props(q={"prefixItems": [{"minimum": 5}, {"maximum": 45}]}), f"select l_orderkey, coalesce(q[1]>=5,true) and coalesce(q[2]<=45,true) valid from {_BASKETS}")
flags("kw_items", _of("embeddings"), ["vec_id"], _props(embedding={"items": {"exclusiveMinimum": -0.25}}), "select vec_id, len(list_filter(embedding, lambda x: not (x > -0.25)))=0 valid from embeddings")
flags("kw_required", _tagged, ["doc_id"], {"required": ["quality"]}, f"select doc_id, list_contains(k,'quality') valid from {_TAGGED}", "j")
flags("kw_property_count", _tagged, ["doc_id"], {"minProperties": 2, "maxProperties": 3}, f"select doc_id, len(k) between 2 and 3 valid from {_TAGGED}", "j")
flags("kw_property_names", _tagged, ["doc_id"], {"propertyNames": {"maxLength": 6}}, f"select doc_id, len(list_filter(k, lambda x: length(x)>6))=0 valid from {_TAGGED}", "j")
flags("kw_properties", _of("events"), ["event_id"], _props(k={"exclusiveMaximum": 50}), "select event_id, coalesce(cast(json_extract(props,'$.k') as int)<50,true) valid from events", "props")
_ADDITIONAL = f"select doc_id, len(list_filter(k, lambda x: not (x in ('doc_id','en_src') or regexp_matches(x,'^x-'))))=0 valid from {_TAGGED}"
flags("kw_additional_props", _tagged, ["doc_id"], {"properties": {"doc_id": True, "en_src": True}, "patternProperties": {"^x-": True}, "additionalProperties": False}, _ADDITIONAL, "j")
flags("kw_unevaluated_props", _tagged, ["doc_id"], {"properties": {"doc_id": True, "en_src": True}, "patternProperties": {"^x-": True}, "unevaluatedProperties": False}, _ADDITIONAL, "j")
_DEPENDENT = f"select doc_id, not list_contains(k,'en_src') or list_contains(k,'quality') valid from {_TAGGED}"
flags("kw_dependent", _tagged, ["doc_id"], {"dependentRequired": {"en_src": ["quality"]}}, _DEPENDENT, "j")
flags("kw_dependent_schemas", _tagged, ["doc_id"], {"dependentSchemas": {"en_src": {"required": ["quality"]}}}, _DEPENDENT, "j")
_A, _B, _C = _props(l_quantity={"minimum": 5}), _props(l_discount={"maximum": 0.05}), _props(l_tax={"maximum": 0.02})
flags("kw_all_of", _of("lineitem"), [*_LINE], {"allOf": [_A, _B]}, "select l_orderkey, l_linenumber, l_quantity>=5 and l_discount<=0.05 valid from lineitem")
flags("kw_any_of", _of("lineitem"), [*_LINE], {"anyOf": [_props(l_quantity={"minimum": 45}), _props(l_discount={"maximum": 0.01})]}, "select l_orderkey, l_linenumber, l_quantity>=45 or l_discount<=0.01 valid from lineitem")
flags("kw_one_of", _of("lineitem"), [*_LINE], {"oneOf": [_props(l_quantity={"minimum": 25}), _B, _C]}, "select l_orderkey, l_linenumber, (l_quantity>=25)::int+(l_discount<=0.05)::int+(l_tax<=0.02)::int=1 valid from lineitem")
flags("kw_not", _of("orders"), ["o_orderkey"], {"not": _props(o_orderpriority={"const": "1-URGENT"})}, "select o_orderkey, not (o_orderpriority='1-URGENT') valid from orders")
flags("kw_if_then_else", _of("events"), ["event_id"], {"if": _props(event_type={"const": "purchase"}), "then": _props(value={"exclusiveMinimum": 10}), "else": _props(value={"minimum": 0})}, "select event_id, case when event_type='purchase' then value>10 else value>=0 end valid from events")
flags("kw_ref", _of("lineitem"), [*_LINE], {"$defs": {"some": {"minimum": 10, "maximum": 40}}, "properties": {"l_quantity": {"$ref": "#/$defs/some"}}}, "select l_orderkey, l_linenumber, l_quantity between 10 and 40 valid from lineitem")
flags("kw_boolean_schema", _of("orders"), ["o_orderkey"], {"properties": {"o_orderkey": True, "o_comment": False}}, "select o_orderkey, true valid from orders")
flags("kw_content", lambda s, d: table(s, d, "events").select("event_id", F.base64(F.col("props").cast("binary")).alias("b")), ["event_id"], _props(b={"contentEncoding": "base64", "contentMediaType": "application/json", "contentSchema": {"required": ["k"], "properties": {"k": {"minimum": 10}}}}), "select event_id, coalesce(cast(json_extract(cast(decode(from_base64(b)) as varchar),'$.k') as int)>=10,false) valid from (select event_id, to_base64(encode(props)) b from events)")
_URIS = lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("s")).union(table(s, d, "documents").select(F.col("doc_id") + 1000000, "source"))
flags("fmt_uri", _URIS, ["id"], _props(s={"type": "string", "format": "uri"}), "select id, regexp_full_match(s,'[A-Za-z][A-Za-z0-9+.-]*:[^ ]+') valid from (select page_id id, url s from pages union all select 1000000+doc_id, source from documents)", assert_format=True, tier="auto")
flags("fmt_date_time", _of("orders", "o_orderkey", "o_orderdate"), ["o_orderkey"], _props(o_orderdate={"type": "string", "format": "date-time", "pattern": "^199[5-9]"}), "select o_orderkey, year(o_orderdate) between 1995 and 1999 valid from orders", assert_format=True)
flags("general_bounds", _of("lineitem", *_LINE, "l_quantity", "l_discount", "l_tax"), [*_LINE], _props(l_quantity={"minimum": 10, "maximum": 40}, l_discount={"exclusiveMinimum": 0}, l_tax={"exclusiveMaximum": 0.08}), ORACLES["kw_bounds"], tier="general")
flags("general_additional_props", _tagged, ["doc_id"], {"properties": {"doc_id": True, "en_src": True}, "patternProperties": {"^x-": True}, "unevaluatedProperties": False}, _ADDITIONAL, "j", tier="general")
flags("general_recursive_ref", _of("events"), ["event_id"], {"$ref": "#/$defs/node", "$defs": {"node": {"properties": {"k": {"type": "integer", "minimum": 10}, "next": {"$ref": "#/$defs/node"}}}}}, "select event_id, cast(json_extract(props,'$.k') as int)>=10 valid from events", "props", tier="auto")
flags("general_dynamic_ref", _of("events"), ["event_id"], {"$id": "urn:outer", "$dynamicAnchor": "n", "$ref": "#/$defs/base", "properties": {"k": {"maximum": 60}}, "$defs": {"base": {"properties": {"next": {"$dynamicRef": "#n"}}}}}, "select event_id, cast(json_extract(props,'$.k') as int)<=60 valid from events", "props", tier="auto")
flags("general_unevaluated_branches", _tagged, ["doc_id"], {"anyOf": [{"properties": {"doc_id": True, "en_src": True}, "required": ["en_src"]}, {"properties": {"doc_id": True, "quality": True}, "required": ["quality"]}], "unevaluatedProperties": False}, f"select doc_id, (list_contains(k,'en_src') or list_contains(k,'quality')) and not list_contains(k,'x-toxic') valid from {_TAGGED}", "j", tier="auto")


_LINEITEM = {"type": "object", "required": ["l_quantity"], "properties": {"l_quantity": {"minimum": 10, "maximum": 40}, "l_returnflag": {"enum": ["A", "R"]}}}
_LINEITEM_ERRORS = "from (select l_orderkey, l_linenumber, 'value_below_minimum' code from lineitem where l_quantity<10 union all select l_orderkey, l_linenumber, 'value_above_maximum' from lineitem where l_quantity>40 union all select l_orderkey, l_linenumber, 'value_not_in_enum' from lineitem where l_returnflag not in ('A','R'))"


@query("contract_lineitem", "select l_orderkey, l_linenumber, l_quantity between 10 and 40 and l_returnflag in ('A','R') valid, (case when l_quantity between 10 and 40 then 0 else 1 end) + (case when l_returnflag in ('A','R') then 0 else 1 end) + (case when l_quantity between 10 and 40 and l_returnflag in ('A','R') then 0 else 1 end) n_errors from lineitem")
def contract_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: validity and number of errors of each line."""
    made = Contract(_LINEITEM, tier="native").validate(table(spark, sf_dir, "lineitem"))
    return made.select(*_LINE, "valid", F.size("errors").alias("n_errors"))


@query("out_flag", "select valid, count(*) n from (select l_quantity>=10 valid from lineitem) group by valid")
def out_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Contract(_props(l_quantity={"minimum": 10}), tier="native").validate(table(spark, sf_dir, "lineitem"), with_errors=False)
    return made.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("out_errors", f"select l_orderkey, l_linenumber, code {_LINEITEM_ERRORS}")
def out_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Contract(_LINEITEM, tier="native").error_rows(table(spark, sf_dir, "lineitem"), keys=[*_LINE])
    return rows.where("keyword <> 'properties'").select(*_LINE, "code")


@query("out_errors_general", f"select l_orderkey, l_linenumber, code {_LINEITEM_ERRORS}")
def out_errors_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*_LINE, "l_quantity", "l_returnflag")
    return Contract(_LINEITEM, tier="general").error_rows(df, keys=[*_LINE]).where("keyword <> 'properties'").select(*_LINE, "code")


@query("out_report", f"select code, count(*) n {_LINEITEM_ERRORS} group by code")
def out_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Contract(_LINEITEM, tier="native").report(table(spark, sf_dir, "lineitem")).where("keyword <> 'properties'").select("code", "n")


@query("out_list", "select event_id, cast(json_extract(props,'$.k') as int)>=50 valid, case when cast(json_extract(props,'$.k') as int)>=50 then null else cast(json_extract(props,'$.k') as varchar) || ' should be at least 50' end message from events")
def out_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    listing = Contract(_props(k={"minimum": 50})).listing(df, "props", hierarchy=False)
    made = df.select("event_id", F.from_json(listing, "valid boolean, details array<struct<instanceLocation:string, errors:map<string,string>>>").alias("o"))
    return made.select("event_id", "o.valid", F.get("o.details", F.lit(0))["errors"]["minimum"].alias("message"))


@query("out_quarantine", "select o_orderkey, o_orderstatus='F' kept from orders")
def out_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = Contract(_props(o_orderstatus={"const": "F"}), tier="native").split(table(spark, sf_dir, "orders"))
    return good.select("o_orderkey", F.lit(True).alias("kept")).union(bad.select("o_orderkey", F.lit(False)))


@query("contract_by_column", "select event_id, case event_type when 'purchase' then value>=20 when 'click' then value<80 else false end valid from events")
def contract_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = {"purchase": Contract(_props(value={"minimum": 20})), "click": Contract(_props(value={"exclusiveMaximum": 80}))}
    return validate_by_contract(table(spark, sf_dir, "events"), contracts, "event_type").select("event_id", "valid")


@query("defaults_apply", "select d.doc_id, coalesce(l.quality,0) quality, coalesce(l.toxic,0) toxic from documents d left join labels l on d.doc_id=l.doc_id")
def defaults_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return Contract(_props(quality={"default": 0}, toxic={"default": 0})).with_defaults(df)


@query("defaults_json", "select doc_id, list_contains(k,'quality') given, true filled from " + _TAGGED)
def defaults_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _tagged(spark, sf_dir).withColumn("own", F.col("j"))
    made = Contract(_props(quality={"default": 0})).with_defaults(df, "j")
    has = lambda c: F.array_contains(F.json_object_keys(c), "quality")
    return made.select("doc_id", has("own").alias("given"), has("j").alias("filled"))


@query("builder_contract", "select o_orderkey, o_totalprice>=1000 and o_orderstatus in ('F','O') valid from orders")
def builder_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = B.object_(B.prop("o_totalprice", B.number(B.min_(1000))), B.prop("o_orderstatus", B.enum("F", "O")), B.required("o_totalprice"))
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", Contract(schema, tier="native").is_valid(df).alias("valid"))


@query("inferred_contract", "select c_custkey, c_acctbal>=0 valid from customer")
def inferred_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    tagged = df.withColumn("c_acctbal", F.col("c_acctbal").alias("c_acctbal", metadata={"rules": "minimum=0"}))
    return df.select("c_custkey", Contract(from_struct_type(tagged.schema), tier="native").is_valid(df).alias("valid"))


@query("metaschema_check", "select event_id, cast(json_extract(props,'$.k') as int)>=0 valid from events")
def metaschema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactlake.operators.contract import metaschema_errors

    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"minLength":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("doc"))
    return metaschema_errors(spark, df, "doc").select("event_id", "valid")


from pactlake import catalogue_results, catalogue_values  # noqa: E402, F401  # they register their queries here
