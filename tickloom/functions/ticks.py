"""Columns over prices, ticks and five-level books."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 5


def snapped(px: Column, tick: Column | float) -> Column:
    """The price on the tick grid, half up in decimal; the price itself where it is over a tenth of a tick off
    or too large for the grid."""
    t = F.lit(tick) if isinstance(tick, float) else tick
    steps = F.round(F.try_divide(px.try_cast("decimal(18,6)"), t.cast("decimal(18,6)")).try_cast("decimal(28,8)"), 0)
    on = (steps.try_cast("decimal(20,0)") * t.cast("decimal(18,6)")).cast("double")
    return F.when(F.abs(on - px) <= t / 10, on).otherwise(px)


def in_ticks(px: Column, tick: Column) -> Column:
    """Whole ticks of a price under 1e11 in size, else null."""
    return F.when(F.abs(px) < 1e11, F.floor(px / tick + 0.5))


def marketable(side: Column, limit: Column, touch: Column) -> Column:
    """Whether a limit reaches the other side's touch (all in ticks)."""
    return F.when(side == "buy", limit >= touch).otherwise(limit <= touch)


def levels(side: str, df_columns: list[str] | None = None, zero: bool = False, count: int = LEVELS) -> Column:
    """The book side as an array of (price, quantity), best first, without levels of no quantity."""
    all_levels = F.array(*[F.struct(F.col(f"{side}px{i}").alias("price"), F.col(f"{side}vol{i}").alias("quantity")) for i in range(count)])
    return all_levels if zero else F.filter(all_levels, lambda x: x["quantity"] > 0)


def sweep(book: Column, qty: Column, limit: Column, buy: Column, participation: float) -> Column:
    """What a single order takes from a book side: struct(filled, notional, levels), as a fold over its levels.

    A level gives floor(quantity x participation) at most; the fold stops at the first level beyond the limit."""
    start = F.struct(qty.cast("long").alias("left"), F.lit(0).cast("long").alias("filled"), F.lit(0.0).alias("notional"), F.lit(0).alias("used"), F.lit(True).alias("on"))

    def take(s: Column, x: Column) -> Column:
        within = s["on"] & F.when(buy, x["price"] <= limit).otherwise(x["price"] >= limit)
        n = F.when(within, F.least(s["left"], F.floor(x["quantity"] * participation))).otherwise(F.lit(0)).cast("long")
        return F.struct(
            (s["left"] - n).alias("left"), (s["filled"] + n).alias("filled"), (s["notional"] + n * x["price"]).alias("notional"),
            (s["used"] + F.when(n > 0, 1).otherwise(0)).alias("used"), F.coalesce(within, F.lit(False)).alias("on"),
        )

    return F.aggregate(book, start, take, lambda s: F.struct(s["filled"].alias("filled"), s["notional"].alias("notional"), s["used"].alias("used")))


def depth_within(side: str, ticks: int, tick: Column, count: int = LEVELS) -> Column:
    """Quantity within ``ticks - 1`` ticks of the touch, up to the first level outside."""
    sign = 1 if side == "ask" else -1
    total, inside = F.lit(0).cast("long"), F.lit(True)
    for i in range(count):
        near = (F.col(f"{side}px{i}") - F.col(f"{side}px0")) * sign <= (ticks - 1) * tick + tick / 10
        inside = inside & F.coalesce(near, F.lit(False))
        total = total + F.when(inside, F.coalesce(F.col(f"{side}vol{i}"), F.lit(0))).otherwise(0)
    return total
