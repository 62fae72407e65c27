"""Aligning series in time: as-of joins, paired legs, previous batches.

As-of joins are a union of both sides and a window that carries the last right row, never a range join: partitioned
by key and day, with what a key carries into a day taken from the last right row of the days before (one row per
key and day), so that a key's whole history is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import seconds_between


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: tuple[str, ...], order: str) -> DataFrame:
    """``left`` with the values of the key's latest right row at or before the left time (null if none).

    Right rows of equal times are ordered by ``order``, the last counting. Rows with a null key or time: left ones find
    nothing, right ones are left out."""
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    payload = F.struct(F.col(right_time).alias("_rt"), F.col(order).alias("_ro"), *values)
    both = left.select(F.struct("*").alias("_left"), F.col(key).alias("_key"), F.col(left_time).alias("_t"), F.to_date(left_time).alias("_day"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema[order].dataType).alias("_ord"))
    both = both.withColumn("_right", F.lit(None).cast(r.select(payload.alias("p")).schema["p"].dataType))
    rights = r.select(F.lit(None).cast(both.schema["_left"].dataType).alias("_left"), F.col(key).alias("_key"), F.col(right_time).alias("_t"), F.to_date(right_time).alias("_day"), F.lit(0).alias("_side"), F.col(order).alias("_ord"), payload.alias("_right"))
    w = Window.partitionBy("_key", "_day").orderBy("_t", "_side", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    within = both.unionByName(rights).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    # The right row that each day with left rows begins with.
    lasts = r.groupBy(F.col(key).alias("_key"), F.to_date(right_time).alias("_day")).agg(F.max(payload).alias("_right"))
    days = lasts.unionByName(left.select(F.col(key).alias("_key"), F.to_date(left_time).alias("_day")).distinct(), allowMissingColumns=True).groupBy("_key", "_day").agg(F.max("_right").alias("_right"))
    carried = days.select("_key", "_day", F.last("_right", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = within.join(carried.select(F.col("_key").alias("_k2"), F.col("_day").alias("_d2"), "_carry"), (F.col("_key") == F.col("_k2")) & (F.col("_day") == F.col("_d2")), "left")
    found = F.coalesce("_last", "_carry")
    return out.select("_left.*", found["_rt"].alias(f"asof_{right_time}"), *[found[v].alias(f"asof_{v}") for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, by: tuple[str, ...], time: str, values: tuple[str, ...], order: str, tolerance_s: float) -> DataFrame:
    """``left`` with the values of the right row nearest in time within the tolerance; of two as near the earlier.
    Both sides have the columns ``by`` (a day among them, so that a group is bounded) and ``time``."""
    payload = F.struct(F.col(time).alias("_rt"), *values)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    a = left.select(F.struct("*").alias("_left"), *by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.col(order).alias("_ord"), F.lit(None).cast(kind).alias("_right"))
    b = right.select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_ord"), payload.alias("_right"))
    w = Window.partitionBy(*by)
    both = a.unionByName(b).withColumns({
        "_before": F.last("_right", ignorenulls=True).over(w.orderBy("_t", "_side", "_ord").rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.last("_right", ignorenulls=True).over(w.orderBy(F.col("_t").desc(), "_side", "_ord").rowsBetween(Window.unboundedPreceding, 0)),
    }).where("_side = 1")
    back, ahead = seconds_between(F.col("_before._rt"), F.col("_t")), seconds_between(F.col("_t"), F.col("_after._rt"))
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    near = F.when(F.least(back, ahead) <= tolerance_s, pick)
    return both.withColumn("_near", near).select("_left.*", F.col("_near._rt").alias(f"near_{time}"), *[F.col(f"_near.{v}").alias(f"near_{v}") for v in values])


def paired(df: DataFrame, legs: tuple[str, str], by: tuple[str, ...], time: str, values: tuple[str, ...]) -> DataFrame:
    """One row per group and time of either leg, with each leg's values carried forward: ``<leg>_<value>``, and
    whether the leg has a row of its own (``<leg>_is_real``). At most one row per leg and time goes in."""
    parts = [F.max(F.when(F.col("leg") == leg, F.struct(*values))).alias(leg) for leg in legs]
    merged = df.groupBy(*by, time).agg(*parts)
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    out = merged
    for leg in legs:
        out = out.withColumns({f"{leg}_is_real": F.col(leg).isNotNull(), f"_{leg}": F.last(leg, ignorenulls=True).over(w)})
    return out.select(*by, time, *[f"{leg}_is_real" for leg in legs], *[F.col(f"_{leg}.{v}").alias(f"{leg}_{v}") for leg in legs for v in values])


def reconciled(left: DataFrame, right: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Exact cover both ways: keys of one side only and pairs whose fields differ (null-safe); nothing if the two agree."""
    a = left.select(*[F.col(k).alias(f"l_{k}") for k in keys], *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(True).alias("_l"))
    b = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("_r"))
    on: Column = F.lit(True)
    differ: Column = F.lit(False)
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    for f in fields:
        differ = differ | ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))
    kind = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(differ, "differs")
    return a.join(b, on, "full").withColumn("kind", kind).where("kind is not null").select(*[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys], "kind", *[c for f in fields for c in (f"l_{f}", f"r_{f}")])
