"""Stress scenarios as columns over a small scenario table, and hedge arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scenarios(spark, rows: list[tuple[str, float, float, float, int]]) -> DataFrame:
    """(scenario, fee_factor, mid_shift_ticks, participation_factor, delay_ms); the participation's factor lies in (0, 1]."""
    if any(not 0 < r[3] <= 1 for r in rows) or any(r[1] < 0 or r[4] < 0 for r in rows):
        raise ValueError("a factor is out of its range")
    return spark.createDataFrame(rows, "scenario string, fee_factor double, mid_shift_ticks double, participation_factor double, delay_ms int")


def stressed_models(models: DataFrame, table: DataFrame) -> DataFrame:
    """Every execution model (model_id, participation) under every scenario: both tables are small dimensions."""
    return models.crossJoin(F.broadcast(table)).select(
        F.concat_ws("+", "model_id", "scenario").alias("model_id"), "scenario", (F.col("participation") * F.col("participation_factor")).alias("participation"), "fee_factor", "mid_shift_ticks", "delay_ms",
    )


def hedge_target(quoted: Column, quoted_weight: Column, hedge_weight: Column) -> Column:
    return -quoted * quoted_weight / hedge_weight


def residual_risk(quoted: Column, hedge: Column, quoted_weight: Column, hedge_weight: Column) -> Column:
    return quoted * quoted_weight + hedge * hedge_weight
