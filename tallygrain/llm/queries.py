"""Named queries of the training-text operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallygrain.llm import audit, cells, chat, language, manifest, packing, quality, repeats, shards, simhash, templates, tokencount, toxicity
from tallygrain.llm.oracles import ORACLES as ORACLES
from tallygrain.llm.shared import documents, table
from tallygrain.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir))


@query
def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("source")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir))


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.rendered_turns(turns.unionByName(chat.probe(spark))))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(documents(spark, sf_dir))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
