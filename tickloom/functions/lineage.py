"""Cutting a plan's lineage so that lost executors cost a read, not a recomputation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: that of ``spark.checkpoint.dir``, or of the context. Without either, a session on one machine
    gets a temporary one; on a cluster this is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    context = spark.sparkContext

    def delete() -> None:
        try:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: S110 - the session is gone, and with it the way to the folder
            pass

    atexit.register(delete)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *parts: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, split into folders by ``parts``: later reads take only the columns and parts they need."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
