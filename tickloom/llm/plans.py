"""Queries of the text operators (p6 to p8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import encoding, mixing, spam
from tickloom.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents", "doc_id", "text"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids don't decode to their text: none."""
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("was", F.coalesce("text", F.lit("")))
    back = encoding.decoded(encoding.token_ids(docs, ("doc_id", "was")), ("doc_id", "was"))
    return back.where(F.col("text") != F.col("was")).select("doc_id")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mixed(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents", "doc_id", "text", "lang")).select(F.col("row_key").alias("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p6_ids, p6_round_trip, p7_mix, p7_report, p8_found)}

SQL: dict[str, str] = {"p6_round_trip": "SELECT doc_id FROM documents WHERE false"}
