"""A corpus pipeline of four stages over ``documents``; each stage rereads what the last one wrote.

Toxicity drops what its model rejects, language identification what has no language to tell, the
Jaccard join all but one of each group of near-duplicates; packing tokenises the rest and gives them their
batches, which ``packing.padded`` puts together.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pactlake.llm import jaccard_join, language_id, packing, toxicity
from pactlake.llm._batches import remove, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.learn(docs, labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, its bucket and batch; workers keep few words beside the other stages' models."""
    return packing.pack(packing.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True, memo=150_000), carry=("ids",))


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language), ("jaccard_join", drop_near_duplicates), ("packing", pack_batches)]

#: The learned stages are no SQL; tests hold the pipeline against its stages run by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``; a stage's table goes when the next is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
