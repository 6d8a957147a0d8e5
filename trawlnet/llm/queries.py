"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawlnet.llm import boilerplate, copies, encodings, leakage, personal, tokens
from trawlnet.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return copies.request_records(table(spark, d, "requests")).unionByName(copies.normalize_url_records(table(spark, d, "normalize_url")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_records(spark, d))


def p1_representatives(spark: SparkSession, d: str) -> DataFrame:
    return copies.representatives(_records(spark, d))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return encodings.records(table(spark, d, "responses"), table(spark, d, "charset_prescan"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.damaged(_bodies(spark, d))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restored(_bodies(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_content(table(spark, d, "responses"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_representatives": p1_representatives, "p2_found": p2_found, "p2_restored": p2_restored, "p4_found": p4_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_reparameterised": p8_reparameterised, "p9_found": p9_found, "p9_redacted": p9_redacted}


def oracle_sql() -> dict[str, str]:
    return {}
