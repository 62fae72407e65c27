"""Cycles (closing fills with the position that they close) and the reports over them. Amounts are whole units, so sums are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cycles(costs: DataFrame, key: str, order: Sequence[str], px: str, qty: str) -> DataFrame:
    """One row per fill that closes some of a position: the key and order columns, ``direction`` and ``open_cost`` of what it closes, ``closed``
    (its quantity), ``exit_px`` and ``points`` (quantity times price difference in the position's favour).

    ``costs``: fills with ``pos`` and ``cost`` after each (carried over midnight), one row per fill. The position before a fill is the one after it
    less its quantity; its mean cost is that of the fill before, which a window over the key's day and the last row of the day before give.
    A fill through zero closes what was there. Rows without key, price or quantity are left out."""
    rows = costs.where(F.col(key).isNotNull() & F.col(px).isNotNull() & F.col(qty).isNotNull()).withColumn("_day", F.to_date(order[0]))
    within = Window.partitionBy(key, "_day").orderBy(*order)
    rows = rows.withColumn("_in_day", F.lag("cost").over(within)).withColumn("_first", F.row_number().over(within) == 1)
    ends = rows.groupBy(key, "_day").agg(F.max_by("cost", F.struct(*order)).alias("_last"))
    ends = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_day"))).select(F.col(key).alias("_k"), F.col("_day").alias("_d"), "_carried")
    rows = rows.join(ends, (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")))
    before = F.col("pos") - F.col(qty)
    rows = rows.withColumns({"_before": before, "open_cost": F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_in_day"))}).where(F.col("_before") * F.col(qty) < 0)
    side = F.signum(F.col("_before").cast("double")).cast("int")
    closed = F.least(F.abs("_before"), F.abs(qty))
    return rows.select(key, *order, side.alias("direction"), "open_cost", closed.alias("closed"), F.col(px).alias("exit_px"), (closed * side * (F.col(px) - F.col("open_cost"))).alias("points"))


def share(part: Column, whole: Column) -> Column:
    """Rows of ``part`` among those of ``whole``; null if there are none of these."""
    return F.try_divide(F.count_if(part & whole), F.count_if(whole))


def exit_rates(df: DataFrame, by: str, reason: str, converged: Sequence[str], hedges: Sequence[str], pnl: str) -> DataFrame:
    """Per group the share of exits by convergence, and of hedging exits that lost."""
    every = F.col(reason).isNotNull()
    return df.groupBy(by).agg(share(F.col(reason).isin(*converged), every).alias("convergence_rate"), share(F.col(pnl) < 0, F.col(reason).isin(*hedges)).alias("failed_hedges"))


def divergence(df: DataFrame, by: str, value: str, unit: int) -> DataFrame:
    """Mean and median size of a deviation in ``unit``s."""
    size = F.abs(value) / unit
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(size), 6).alias("mean_units"), F.round(F.median(size), 6).alias("median_units"))


def taker_costs(df: DataFrame, cost: str, lots: str, gross: str, hedge: Column) -> DataFrame:
    """One row: total cost, per lot, as a share of gross PnL, and per lot on the hedging route alone."""
    on = lambda c: F.sum(F.when(hedge, F.col(c)))
    return df.agg(F.sum(cost).alias("total"), F.try_divide(F.sum(cost), F.sum(lots)).alias("per_lot"), F.try_divide(F.sum(cost), F.sum(gross)).alias("of_gross"), F.try_divide(on(cost), on(lots)).alias("hedge_per_lot"))


def routes(df: DataFrame, by: str, route: str, values: Sequence[str], lots: str, pnl: str) -> DataFrame:
    """Per group the lots, trades and PnL of each route, and whether it used more than one."""
    out = []
    for i, v in enumerate(values):
        on = F.col(route) == v
        out += [F.coalesce(F.sum(F.when(on, F.col(lots))), F.lit(0)).alias(f"lots_{i}"), F.count_if(on).alias(f"n_{i}"), F.coalesce(F.sum(F.when(on, F.col(pnl))), F.lit(0)).alias(f"net_{i}")]
    return df.groupBy(by).agg(*out, (F.size(F.collect_set(route)) > 1).alias("mixed"))


def capacity_use(df: DataFrame, by: str, held: str, cap: int) -> DataFrame:
    """Mean and greatest holding, and the share of rows at the cap."""
    size = F.abs(held)
    return df.groupBy(by).agg(F.round(F.avg(size), 6).alias("mean_held"), F.max(size).alias("peak"), F.try_divide(F.count_if(size >= cap), F.count(held)).alias("bind_rate"))


def cycle_statistics(df: DataFrame, by: Sequence[str], pnl: str) -> DataFrame:
    """Count, wins, rates and averages, rounded to three decimals; a mean without rows is null."""
    won, lost = F.col(pnl) > 0, F.col(pnl) < 0
    return df.groupBy(*by).agg(
        F.count(pnl).alias("n"), F.round(F.avg(pnl), 3).alias("mean"), F.round(share(won, F.col(pnl).isNotNull()), 3).alias("win_rate"), F.round(F.avg(F.when(won, F.col(pnl))), 3).alias("mean_win"),
        F.round(F.avg(F.when(lost, F.col(pnl))), 3).alias("mean_loss"), F.max(pnl).alias("best"), F.min(pnl).alias("worst"),
    )
