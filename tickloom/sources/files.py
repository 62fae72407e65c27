"""File sources and sinks: CSV by day and contract, prediction files, JSON lines, hashed payloads, manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.raw_lines import CLOCKS, COLUMNS, DOUBLES, INTS

RAW_SCHEMA = ", ".join(f"`{c}` " + ("timestamp_ntz" if c in CLOCKS else "double" if c in DOUBLES else "int" if c in INTS else "long") for c in COLUMNS)


def write_day_csv(df: DataFrame, root: str, day: str = "day", contract: str = "contract") -> None:
    """One folder per day and contract under ``root``; hidden partition columns ``p_day`` and ``p_contract``."""
    kept = df.select(*[c for c in df.columns if c not in (day, contract)], F.col(day).cast("string").alias("p_day"), F.col(contract).alias("p_contract"))
    kept.repartition("p_day", "p_contract").write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").partitionBy("p_day", "p_contract").csv(root)


def read_day_csv(spark: SparkSession, root: str, schema: str = RAW_SCHEMA, days: Sequence[str] | None = None) -> DataFrame:
    """The files under ``root`` with day and contract taken from the path; only some days where they are named (other
    folders are not read)."""
    df = spark.read.schema(schema + ", p_day string, p_contract string").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(root)
    if days is not None:
        df = df.where(F.col("p_day").isin(list(days)))
    return df.withColumnsRenamed({"p_day": "day", "p_contract": "contract"})


def read_predictions(spark: SparkSession, pattern: str, universe: Sequence[str]) -> DataFrame:
    """(contract, ts, pred, available_day) of files named ``<word>_<contract>.csv``; an undeclared contract or two files of one
    contract are an error. The prediction is for the trading day that begins six hours before midnight."""
    rows = spark.read.schema("ts timestamp_ntz, pred double").option("header", True).csv(pattern).withColumn("_file", F.col("_metadata.file_name"))
    rows = rows.withColumn("contract", F.regexp_extract("_file", r"^[^_]*_([^_.]+)", 1))
    files = rows.select("contract", "_file").distinct().limit(len(universe) + 1).collect()
    seen = [f.contract for f in files]
    if set(seen) - set(universe) or len(seen) != len(set(seen)):
        raise ValueError(f"undeclared or repeated prediction files: {sorted(f._file for f in files)}")
    return rows.select("contract", "ts", "pred", F.to_date(F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("available_day"))


def missing_coverage(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without a row."""
    return expected.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


JSON_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with whole microseconds and explicit nulls."""
    df.write.mode("overwrite").options(**JSON_TIME).option("ignoreNullFields", False).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that don't (``line``)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **JSON_TIME}
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema + ", _corrupt string", options).alias("r"))
    fits = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    return rows.where(fits).select("r.*").drop("_corrupt"), rows.where(~fits).select(F.col("value").alias("line"))


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of whole files, from the same bytes that are read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def payload_store(df: DataFrame, digest: str, payload: Sequence[str]) -> DataFrame:
    """One row per digest and payload; a digest with several payloads is there several times (a collision)."""
    return df.where(F.col(digest).isNotNull()).select(digest, *payload).distinct()


def collisions(store: DataFrame, digest: str) -> DataFrame:
    return store.groupBy(digest).agg(F.count("*").alias("n_payloads")).where("n_payloads > 1")


def manifest(artifacts: dict[str, bytes]) -> str:
    """Canonical JSON of the artifacts' digests and their own: small files on the driver, not tables."""
    digests = {k: hashlib.sha256(v).hexdigest() for k, v in sorted(artifacts.items())}
    whole = hashlib.sha256(json.dumps(digests, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return json.dumps({"artifacts": digests, "sha256": whole}, sort_keys=True, separators=(",", ":"))
