"""Trade and PnL reports. Amounts are whole units (such as cents) where sums are to be exact.

Windows without a partition key below run over rows that were aggregated to days or tiers first; they
hold a row per day, combination or tier, never one per trade.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _everything():
    return Window.partitionBy(F.lit(1))


def bucket_pnl(df: DataFrame, key: str, pnl: str) -> DataFrame:
    """Count and sum per key; rows with a null key are in no bucket."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(pnl).alias("net_pnl"))


def reason_mix(df: DataFrame, reason: str, pnl: str) -> DataFrame:
    """Count, sum and share of all trades per reason."""
    out = df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"), F.sum(pnl).alias("net_pnl"))
    return out.withColumn("share", F.try_divide("n", F.sum("n").over(_everything())))


def monthly_pivot(df: DataFrame, time: str, direction: str, pnl: str, values: Sequence[str]) -> DataFrame:
    """Sum per month and direction, 0 where there is none, and their total."""
    out = df.where(F.col(time).isNotNull()).groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(*[F.coalesce(F.sum(F.when(F.col(direction) == v, F.col(pnl))), F.lit(0)).alias(f"d_{i}") for i, v in enumerate(values)])
    total = F.lit(0)
    for i in range(len(values)):
        total = total + F.col(f"d_{i}")
    return out.withColumn("total", total)


def time_of_day(df: DataFrame, time: str, width_min: int, pnl: str, qty: str) -> DataFrame:
    """Trades by time of day: count, sum, and mean PnL per unit (null quantity or 0: left out of the mean)."""
    minute = F.hour(time) * 60 + F.minute(time)
    per = F.try_divide(F.col(pnl), F.when(F.col(qty) != 0, F.col(qty)))
    return df.where(F.col(time).isNotNull()).groupBy((F.floor(minute / width_min) * width_min).alias("bucket")).agg(F.count("*").alias("n"), F.sum(pnl).alias("net_pnl"), F.round(F.avg(per), 6).alias("mean_per_unit"))


def quantile_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles with linear interpolation, exact."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("_q")).select(*by, "n", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"))


def quantile_buckets(df: DataFrame, value: str, pnl: str, parts: int = 5) -> DataFrame:
    """Trades by quantile of a value: right-closed buckets between percentile edges (equal edges are one), the lowest value included.

    The edges are one row."""
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / parts) for i in range(parts + 1)]))).alias("edges"))
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    place = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(value))), F.lit(1))
    return rows.groupBy(place.alias("bucket")).agg(F.count("*").alias("n"), F.sum(pnl).alias("net_pnl"), F.min(value).alias("low"), F.max(value).alias("high"))


def daily_summary(df: DataFrame, time: str, gross: str, fees: str, rebate_share: float) -> DataFrame:
    """Per day: gross, fees, rebate (a share of the fees, whole units), net, the running net and its five-day mean (from the fifth day on)."""
    day = df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"), F.sum(gross).alias("gross"), F.sum(fees).alias("fees"))
    day = day.withColumn("rebate", F.floor(F.col("fees") * rebate_share)).withColumn("net", F.col("gross") - F.col("fees") + F.col("rebate"))
    w = _everything().orderBy("day")
    last5 = w.rowsBetween(-4, 0)
    return day.withColumns({"cum": F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0)), "mean5": F.when(F.count("*").over(last5) == 5, F.sum("net").over(last5) / 5)})


def regimes(summary: DataFrame, drop_pct: float = 15.0) -> DataFrame:
    """``regime`` of each day: before and after the (first) peak of the running net if the end is over ``drop_pct`` below it
    and the peak is not the last day, else thirds of the days."""
    everything = _everything()
    w = everything.orderBy("day")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = summary.withColumns({
        "_peak": F.max("cum").over(everything), "_final": F.last("cum").over(full), "_last": F.max("day").over(everything), "_n": F.count("*").over(everything), "_i": F.row_number().over(w),
    })
    out = out.withColumn("_peak_day", F.min(F.when(F.col("cum") == F.col("_peak"), F.col("day"))).over(everything))
    drop = F.when(F.col("_peak") != 0, (F.col("_peak") - F.col("_final")) / F.abs("_peak") * 100).otherwise(0.0)
    third = F.floor(F.col("_n") / 3)
    split = (drop > drop_pct) & (F.col("_peak_day") != F.col("_last"))
    name = F.when(split, F.when(F.col("day") <= F.col("_peak_day"), "profitable").otherwise("declining")).otherwise(F.when(F.col("_i") <= third, "early").when(F.col("_i") <= 2 * third, "middle").otherwise("late"))
    return out.withColumn("regime", name).drop("_peak", "_final", "_last", "_n", "_i", "_peak_day")


def order_limits(df: DataFrame, contract: str, day: str, limit: int) -> DataFrame:
    """Messages per contract and day, throttled from the limit on and in breach above it."""
    return df.groupBy(contract, day).agg(F.count("*").alias("n_msgs")).withColumns({"throttled": F.col("n_msgs") >= limit, "breached": F.col("n_msgs") > limit})


def order_limit_days(limits: DataFrame, day: str) -> DataFrame:
    return limits.groupBy(day).agg(F.max("n_msgs").alias("msg_max"), F.count_if("breached").alias("n_breached"), F.count_if("throttled").alias("n_throttled"))


def order_to_trade(messages: Column, traded: Column) -> Column:
    """Messages per traded order (none counting as one), less one."""
    return F.greatest(messages, F.lit(0)) / F.greatest(traded, F.lit(1)) - 1.0


def tier_fee(volume: Column, otr: Column, tiers: Sequence[tuple[int | None, float, float]], threshold: float) -> Column:
    """Progressive fee: each tier (upper bound, rate at or under the threshold, rate above it) charges its part of the volume."""
    fee, lower = F.lit(0.0), 0
    for upper, cheap, dear in tiers:
        top = volume if upper is None else F.least(volume, F.lit(upper))
        part = F.greatest(F.lit(0), top - lower)
        fee = fee + part * F.when(otr <= threshold, cheap).otherwise(dear)
        lower = upper if upper is not None else lower
    return fee


def pnl_layers(gross: Column, trade_fee: Column, message_fee: Column, rebate: Column) -> dict[str, Column]:
    """The five layers of PnL and the share of fees in a positive gross."""
    after = gross - trade_fee
    return {
        "gross": gross, "after_trade_fee": after, "after_message_fee": after - message_fee, "after_rebate": after + rebate, "net": after - message_fee + rebate,
        "trade_fee_ratio": F.when(gross > 0, trade_fee / gross), "message_fee_ratio": F.when(gross > 0, message_fee / gross),
    }


def waterfall(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Non-overlapping effects summed: capture, quoted and hedge marks, fees, rebates and the total, with what is left over
    against an independent view of it (``view``)."""
    parts = ("capture", "quoted_mark", "hedge_mark", "shortfall", "fees", "rebates")
    out = df.groupBy(*by).agg(*[F.sum(p).alias(p) for p in parts], F.sum("view").alias("view"))
    total = F.col("capture") + F.col("quoted_mark") + F.col("hedge_mark") - F.col("shortfall") - F.col("fees") + F.col("rebates")
    return out.withColumn("total", total).withColumn("residual", F.col("total") - F.col("view"))


def concentration(df: DataFrame, by: str, day: str, pnl: str) -> DataFrame:
    """Net of each group, without its best trade, and without its best day."""
    days = df.groupBy(by, day).agg(F.sum(pnl).alias("_d"), F.max(pnl).alias("_b"))
    return days.groupBy(by).agg(F.sum("_d").alias("net"), (F.sum("_d") - F.max("_b")).alias("net_less_best_trade"), (F.sum("_d") - F.max("_d")).alias("net_less_best_day"))


def best_of(df: DataFrame, metric: str, *ties: str) -> DataFrame:
    """Rows ranked by a metric, descending; ties by the given columns."""
    return df.withColumn("rank", F.row_number().over(_everything().orderBy(F.col(metric).desc(), *ties)))


def trade_statistics(df: DataFrame, by: str, pnl: str) -> DataFrame:
    """Count, sum, win rate, profit factor, best and worst per group."""
    gain, loss = F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum(pnl).alias("net"), (F.count_if(F.col(pnl) > 0) / F.count("*")).alias("win_rate"), F.try_divide(gain, loss).alias("profit_factor"), F.max(pnl).alias("best"), F.min(pnl).alias("worst"))
