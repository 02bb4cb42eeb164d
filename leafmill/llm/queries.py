"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import ann, chat, decontam, jaccard, langid, license, lines, mixing, quality, warc
from leafmill.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_ann": op2_ann,
        "op3_decontam": op3_decontam,
        "op4_lines": op4_lines,
        "op5_mixing": op5_mixing,
        "op6_langid": op6_langid,
        "op7_license": op7_license,
        "op8_warc": op8_warc,
        "op9_jaccard": op9_jaccard,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.chat_sql(),
        "op2_ann": ann.nearest_sql(),
        "op3_decontam": decontam.overlaps_sql(),
        "op4_lines": lines.counts_sql(),
        "op5_mixing": mixing.mix_sql(),
        "op7_license": license.scan_sql(),
        "op8_warc": warc.warc_sql(),
        "op9_jaccard": jaccard.linked_sql(),
    }
