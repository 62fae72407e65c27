"""Cleaning of five-level snapshots and the columns derived from cumulative totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.ticks import LEVELS

BY_TIME = ("exchtime", "row_id")


def keep_last(df: DataFrame, keys: tuple[str, ...] = ("contract", "exchtime"), order: str = "row_id") -> DataFrame:
    """The last row per keys by delivery; rows with a null key are left out."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    there = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        there = there & F.col(k).isNotNull()
    return df.where(there).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with a positive best bid and total, after ``keep_last`` (the copy that is last decides)."""
    return keep_last(df).where((F.col("bidpx0") > 0) & (F.col("totalvol") > 0))


def repaired(df: DataFrame) -> DataFrame:
    """Prices of levels without quantity replaced in cascade: the best bid by the best ask, further bids by the level before,
    then the best ask by the (repaired) best bid, further asks by the level before."""
    out = df
    for side, other in (("bid", "ask"), ("ask", "bid")):
        for i in range(LEVELS):
            source = f"{other}px0" if i == 0 else f"{side}px{i - 1}"
            out = out.withColumn(f"{side}px{i}", F.when(F.col(f"{side}vol{i}") <= 0, F.col(source)).otherwise(F.col(f"{side}px{i}")))
    return out


def increments(df: DataFrame, columns: tuple[str, ...] = ("totalvol", "totalvalue"), by: tuple[str, ...] = ("contract",), order: tuple[str, ...] = BY_TIME) -> DataFrame:
    """``d_<column>``: the change of a running total since the row before; on the first row the total itself."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"d_{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.when(F.lag("row_id").over(w).isNull(), F.col(c))) for c in columns})


def interval_price(d_value: Column, d_volume: Column, multiplier: Column) -> Column:
    """Mean traded price of an interval; null without volume."""
    return F.when(d_volume > 0, d_value / d_volume / multiplier)


def two_tick_split(df: DataFrame, price: str, volume: str, tick: str, rounding: str = "even") -> DataFrame:
    """p1, p2 (ticks around the price) and v1, v2 (the volume on each). ``even``: half to even, not clamped;
    ``up``: half up, clamped to the volume."""
    lower = F.floor(F.col(price) / F.col(tick))
    p1 = lower * F.col(tick)
    raw = (F.col(price) - p1) * F.col(volume) / F.col(tick)
    v2 = F.bround(raw, 0) + 0.0 if rounding == "even" else F.greatest(F.lit(0.0), F.least(F.floor(raw + 0.5).cast("double"), F.col(volume).cast("double")))
    return df.withColumns({"p1": p1, "p2": p1 + F.col(tick), "v2": v2}).withColumn("v1", F.bround(F.col(volume) - F.col("v2"), 0) if rounding == "even" else F.col(volume) - F.col("v2"))


def forward_filled(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("contract",), order: tuple[str, ...] = BY_TIME) -> DataFrame:
    """Nulls replaced by the last value before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def epochs(df: DataFrame, by: tuple[str, ...] = ("contract", "day"), order: tuple[str, ...] = BY_TIME) -> DataFrame:
    """``epoch``: number of restarts (a total below the row before) so far; ``d_vol``, ``d_value`` within an epoch, null on its first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    reset = (F.col("totalvol") < F.lag("totalvol").over(w)) | (F.col("totalvalue") < F.lag("totalvalue").over(w))
    out = df.withColumn("_reset", F.coalesce(reset.cast("int"), F.lit(0)))
    out = out.withColumn("epoch", F.sum("_reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumns({
        "d_vol": F.when(F.col("_reset") == 0, F.col("totalvol") - F.lag("totalvol").over(w)), "d_value": F.when(F.col("_reset") == 0, F.col("totalvalue") - F.lag("totalvalue").over(w)),
    }).drop("_reset")


def interval_buckets(df: DataFrame, tick: str, multiplier: str) -> DataFrame:
    """``buckets``: the interval's volume on the two ticks around its mean price, empty ones left out (quantity is conserved);
    null without volume. Needs d_vol and d_value."""
    vwap = F.col("d_value") / F.col("d_vol") / F.col(multiplier)
    lower = F.floor(vwap / F.col(tick) + 1e-12)
    upper_q = F.greatest(F.lit(0), F.least(F.floor((vwap / F.col(tick) - lower) * F.col("d_vol") + 0.5), F.col("d_vol"))).cast("long")
    buckets = F.filter(
        F.array(F.struct(lower.cast("long").alias("ticks"), (F.col("d_vol") - upper_q).alias("quantity")), F.struct((lower + 1).cast("long").alias("ticks"), upper_q.alias("quantity"))),
        lambda b: b["quantity"] > 0,
    )
    ok = (F.col("d_vol") > 0) & (F.col("d_value") > 0) & (vwap / F.col(tick) < 1e15)
    return df.withColumn("buckets", F.when(ok, buckets))


def depth_envelope(df: DataFrame) -> DataFrame:
    """``low``, ``high``: lowest bid and highest ask among levels with quantity."""
    bids = F.filter(F.array(*[F.struct(F.col(f"bidpx{i}").alias("p"), F.col(f"bidvol{i}").alias("q")) for i in range(LEVELS)]), lambda x: x["q"] > 0)
    asks = F.filter(F.array(*[F.struct(F.col(f"askpx{i}").alias("p"), F.col(f"askvol{i}").alias("q")) for i in range(LEVELS)]), lambda x: x["q"] > 0)
    return df.withColumns({"low": F.array_min(F.transform(bids, lambda x: x["p"])), "high": F.array_max(F.transform(asks, lambda x: x["p"]))})


def book_changes(df: DataFrame, order: tuple[str, ...] = BY_TIME) -> DataFrame:
    """Level changes against the contract's row before on the same day: side, ticks, action (add, cancel, modify), quantity change.
    Needs ``bid`` and ``ask`` arrays of (ticks, quantity) without null ticks; of equal ticks quantities add up."""
    w = Window.partitionBy("contract", "day").orderBy(*order)
    now = df.select("contract", "day", "row_id", *order[:1], "bid", "ask", F.lag("bid").over(w).alias("bid_was"), F.lag("ask").over(w).alias("ask_was"), F.row_number().over(w).alias("n")).where("n > 1")
    none = F.lit(0).cast("long")

    def changed(side: str) -> Column:
        # Within the row: two books of five levels; a shuffle of exploded levels would cost more than comparing them.
        book = F.col(side)
        before = F.coalesce(F.col(f"{side}_was"), F.filter(book, lambda x: F.lit(False)))
        total = lambda levels, t: F.aggregate(levels, none, lambda n, x: n + F.when(x["ticks"] == t, x["quantity"]).otherwise(none))
        every = F.array_distinct(F.concat(F.transform(book, lambda x: x["ticks"]), F.transform(before, lambda x: x["ticks"])))
        found = F.transform(every, lambda t: F.struct(F.lit(side).alias("side"), t.alias("ticks"), total(before, t).alias("was"), total(book, t).alias("now")))
        return F.filter(found, lambda x: x["was"] != x["now"])

    out = now.select("row_id", F.inline(F.concat(changed("bid"), changed("ask"))))
    action = F.when(F.col("was") == 0, "add").when(F.col("now") == 0, "cancel").otherwise("modify")
    return out.select("row_id", "side", "ticks", action.alias("action"), (F.col("now") - F.col("was")).alias("qty_delta"))
