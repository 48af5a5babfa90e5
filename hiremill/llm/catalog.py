"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hiremill.llm import (
    boilerplate,
    capfilters,
    decontam,
    fim,
    kdtree,
    language,
    licenses,
    mixing,
    repair,
    secrets,
    simhash,
    tokenfiles,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_secret_scan")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query("op2_decontamination")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_token_files")
def _(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.token_ids(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query("op4_language")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op5_cap_filters")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, folder, "embeddings"))


@query("op6_simhash")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op8_toxicity")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_boilerplate_lines", boilerplate.oracle())
def _(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.drop_boilerplate(table(spark, folder, "pages"))


@query("op9_source_mix")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, folder, "documents"))


@query("op10_kd_shards")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return kdtree.shard_documents(table(spark, folder, "documents"))


@query("op11_license_scan", licenses.oracle())
def _(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op12_fill_in_middle", fim.ORACLE)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return fim.transform_digests(table(spark, folder, "documents"))


@query("op13_conversation_repair")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_conversations(table(spark, folder, "conversations"))
