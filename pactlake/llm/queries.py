"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import fingerprints, jaccard_join, language_id, license_scan, metric_join, packing, sentencepiece_codec, token_files, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


#: The rules of op4's contract.
URL_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.Rule.parse(r) for r in URL_RULES])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.transform("matches", lambda m: m["license"])), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"), best.alias("containment"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), token_files.fresh_folder(spark), end=2)
    return token_files.read(manifest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op8_metric_join": op8_metric_join,
    "op7_packing": op7_packing,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
}
#: Components by reachability over links(a, b), both ways.
_REACHED = "reached(node, component_id) as (select {key}, {key} from {rows} union select l.b, r.component_id from reached r join links l on l.a = r.node)"

OP6_SQL = rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x20\x09-\x0D]+') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) end h from words),
sizes as (select doc_id, len(h) n from sets),
shingles as (select doc_id, unnest(h) g from sets),
common as (select x.doc_id a, y.doc_id b, count(*) c from shingles x join shingles y using (g) where x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
{_REACHED.format(key="doc_id", rows="sizes")}
select s.doc_id, s.n n_shingles, (select min(r.component_id) from reached r where r.node = s.doc_id) component_id, (select count(*) from links l where l.a = s.doc_id) n_links from sizes s"""

OP8_SQL = f"""
with recursive vectors as (select vec_id, label, cast(embedding as double[]) v from embeddings),
links as (select x.vec_id a, y.vec_id b from vectors x join vectors y on x.label = y.label and x.vec_id <> y.vec_id where list_cosine_similarity(x.v, y.v) >= 0.93),
{_REACHED.format(key="vec_id", rows="vectors")},
found as (select v.vec_id, (select count(*) from links l where l.a = v.vec_id) n_links, (select min(r.component_id) from reached r where r.node = v.vec_id) component_id from vectors v)
select vec_id, n_links, component_id, vec_id = component_id kept from found"""

ORACLES: dict[str, str] = {"op5_license_scan": license_scan.oracle(), "op6_jaccard_join": OP6_SQL, "op8_metric_join": OP8_SQL}
