"""The registered queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import ann, chat, decontam, langid, linededup, mixing, pii, secrets, sharding, simhash


def _over(table: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _over("documents", pii.digest),
    "op2_langid": _langid,
    "op3_mixing": _over("documents", mixing.digest),
    "op4_sharding": _over("documents", sharding.digest),
    "op5_ann": _over("embeddings", ann.digest),
    "op6_line_dedup": _over("documents", linededup.digest),
    "op7_decontam": _decontam,
    "op8_simhash": _over("documents", simhash.digest),
    "op9_chat": _over("conversations", chat.digest),
    "op10_secrets": _over("documents", secrets.digest),
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.SQL,
    "op6_line_dedup": linededup.SQL,
    "op7_decontam": decontam.SQL,
    "op9_chat": chat.SQL,
    "op10_secrets": secrets.SQL,
}
