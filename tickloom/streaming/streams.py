"""Structured Streaming forms of the event-time operators: sealed batches, bounded deduplication, late rows, stateful positions.

A stream that is to be read back as a table runs over what is there (``availableNow``) into Parquet in the shared folder
that ``spark.checkpoint.dir`` names; the sink and its checkpoint live together, so a restart goes on exactly once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.lineage import scratch
from tickloom.kernel.lifecycle import FINAL
from tickloom.kernel.positions import Position


def table_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    path = f"{directory}/{name}.parquet"
    # A stream reads folders: a table of one file is named by a glob.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path if os.path.isdir(path) else f"{directory}/{name}.parque[t]")


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs the stream over what is there and returns what it wrote."""
    spark = stream.sparkSession
    out = f"{folder}/{uuid.uuid4().hex}" if folder else scratch(spark)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def sealed(stream: DataFrame, time: str, product: str, width: str = "1 minute", delay: str = "10 minutes", members: int = 2) -> DataFrame:
    """Batches of event time with their rows and products, each emitted once the watermark has passed it; ``complete`` (all ``members`` there) is
    what a consumer that fails closed asks for. The state holds a batch's products, a bounded set. Rows that
    come after their batch was emitted are dropped; Spark judges them by the watermark that the micro-batch before began with."""
    rows = stream.where(F.col(time).isNotNull()).withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", delay)
    out = rows.groupBy(F.window("_ts", width)).agg(F.count("*").alias("n_rows"), F.collect_set(product).alias("_products"))
    n = F.size("_products").cast("long")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("batch_ts"), "n_rows", n.alias("n_products"), (n >= members).alias("complete"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first of equal keys within the watermark's delay."""
    return stream.where(F.col(time).isNotNull()).withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(keys).drop("_ts")


def late_rows(batch: DataFrame, time: str, arrival: str, delay_s: int) -> DataFrame:
    """Rows that arrived more than the delay after their time: the side output of a stream whose watermark drops them."""
    return batch.where(F.timestamp_diff("MICROSECOND", F.col(time), F.col(arrival)) > delay_s * 1_000_000)


POSITIONS = T.StructType([T.StructField("product", T.StringType()), T.StructField("n", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("gross", T.DoubleType())])
STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("qty", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("gross", T.DoubleType())])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, qty, cost, gross = state.get if state.exists else (0, 0, 0.0, 0.0)
    p = Position(qty=int(qty), cost=cost, gross=gross)
    rows = pd.concat(list(batches)).sort_values(["at", "key"])
    for px, q in zip(rows["px"], rows["qty"], strict=True):
        p.fill(float(px), int(q))
    n += len(rows)
    state.update((int(n), p.qty, float(p.cost), float(p.gross)))
    yield pd.DataFrame({"product": [key[0]], "n": [n], "pos": [p.qty], "gross": [p.gross]})


def positions(stream: DataFrame) -> DataFrame:
    """Running position and PnL per product over (product, at, key, px, qty); a row per product and micro-batch. The state
    is four numbers; rows of one micro-batch are taken in order of time and key."""
    return stream.groupBy("product").applyInPandasWithState(_advance, POSITIONS, STATE, "append", GroupStateTimeout.NoTimeout)


ENDS = T.StructType([T.StructField("order_id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("n", T.LongType()), T.StructField("filled", T.LongType())])
OPEN_ORDER = T.StructType([T.StructField("n", T.LongType()), T.StructField("filled", T.LongType())])


def order_ends(stream: DataFrame, time: str = "occurred_at", delay: str = "10 minutes", patience_s: int = 1800) -> DataFrame:
    """(order_id, state, n, filled) once per order: at its first final state, or as ``timed_out`` when the watermark has passed its latest record by
    ``patience_s``. The state of an order (two numbers and a timer) is dropped there, so it is bounded by the orders that are open; records
    of an order that come after its end in the same micro-batch are ignored, in later ones they begin a new order.

    ``stream``: order_id, row_id, lifecycle_state, filled_qty and the time. Rows of one micro-batch are taken in order of time and row_id; rows
    without order or time are left out."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, filled = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"order_id": [key[0]], "state": ["timed_out"], "n": [n], "filled": [filled]})
            return
        rows = pd.concat(list(batches)).sort_values(["_ts", "row_id"])
        for what, q in zip(rows["lifecycle_state"], rows["filled_qty"], strict=True):
            n += 1
            filled = max(filled, 0 if pd.isna(q) else int(q))
            if what in FINAL:
                if state.exists:
                    state.remove()
                yield pd.DataFrame({"order_id": [key[0]], "state": [what], "n": [n], "filled": [filled]})
                return
        state.update((int(n), int(filled)))
        state.setTimeoutTimestamp(max(int(rows["_ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + patience_s * 1000)

    rows = stream.where(F.col("order_id").isNotNull() & F.col(time).isNotNull()).withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", delay)
    return rows.select("order_id", "row_id", "lifecycle_state", "filled_qty", "_ts").groupBy("order_id").applyInPandasWithState(advance, ENDS, OPEN_ORDER, "append", GroupStateTimeout.EventTimeTimeout)
