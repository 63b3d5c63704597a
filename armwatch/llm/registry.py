"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from armwatch.llm import (
    byte_bpe, conversation_repair, embedding_dedup, hilbert_sharding, periodic_runs, pii,
    quality_qda, quality_rules, relative_lz, simhash, source_mixing, suffix_dedup, toxicity)
from armwatch.llm.common import bounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function
    return add


@query("op1_embedding_near_dedup", embedding_dedup.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)


@query("op4_quality_rules", quality_rules.sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "labels"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


@query("op7_source_mixing", source_mixing.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.taken(table(spark, sf_dir, "documents"))


@query("op10_hilbert_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_pii_crf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.reported(table(spark, sf_dir, "documents"))


@query("op8_suffix_array_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query("op9_relative_lz_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.deduplicated(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.reported(table(spark, sf_dir, "conversations"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.reported(
        periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))


@query("op13_quality_qda")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
