"""Causal statistics of a series and what is made of them. Windows are per contract and day.

Means and deviations come from sums of whole ticks and their squares, which are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BY, ORDER = ("contract", "day"), ("exchtime", "row_id")


def _z(x: Column, n: Column, s: Column, q: Column) -> Column:
    spread = F.sqrt((n * q - s * s).cast("double")) / n
    return F.try_divide(x - s / n, F.when(spread != 0, spread))


def rolling_z(x: str, rows: int, by: tuple[str, ...] = BY, order: tuple[str, ...] = ORDER) -> Column:
    """Deviation from the mean of the ``rows`` rows before (without this one, all of which must be there) in population
    standard deviations; null if these are 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1)
    c = F.col(x).cast("long")
    n = F.count(c).over(w)
    return F.when(n == rows, _z(c, n, F.sum(c).over(w), F.sum(c * c).over(w)))


def expanding_z(x: str, by: tuple[str, ...] = BY, order: tuple[str, ...] = ORDER) -> Column:
    """As ``rolling_z`` over all rows up to this one, at least two; 0 where there is no deviation."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(x).cast("long")
    n = F.count(c).over(w)
    return F.when(n >= 2, F.coalesce(_z(c, n, F.sum(c).over(w), F.sum((c * c).cast("decimal(20,0)")).over(w).cast("decimal(28,0)")), F.lit(0.0))).otherwise(0.0)


def targets(z: str, enter: float, leave: float, w: WindowSpec) -> Column:
    """-1 above the entry band, 1 below it, else the last of these; 0 inside the exit band."""
    raw = F.when(F.col(z) > enter, -1).when(F.col(z) < -enter, 1)
    return F.when(F.abs(F.col(z)) <= leave, 0).otherwise(F.coalesce(F.last(raw, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def crossings(z: str, level: float, w: WindowSpec) -> Column:
    """``up`` where the series rises above the level, ``down`` where it falls below minus the level, by the last two rows."""
    one, two = F.lag(z, 1).over(w), F.lag(z, 2).over(w)
    return F.when((one > level) & (two <= level), "up").when((one < -level) & (two >= -level), "down")


def gaps(time: str, over_s: int, w: WindowSpec) -> Column:
    """Seconds since the row before where they are over the limit, else null."""
    step = F.timestamp_diff("MICROSECOND", F.lag(time).over(w), F.col(time)) / 1e6
    return F.when(step > over_s, step)


def compressed_time(time: str, over_s: int, stand_in_s: int, w: WindowSpec) -> tuple[Column, Column]:
    """(step, expression name) of a time axis on which gaps over the limit last ``stand_in_s``, in microseconds."""
    step = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag(time).over(w), F.col(time)), F.lit(0))
    return F.when(step > over_s * 1_000_000, stand_in_s * 1_000_000).otherwise(step), F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))


def step_corners(value: str, w: WindowSpec) -> Column:
    """Rows that differ from the one before or after, or have none: all that a step plot needs."""
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return first | last | ~F.col(value).eqNullSafe(before) | ~F.col(value).eqNullSafe(after)


def downsampled(df: DataFrame, value: str, size: int, by: tuple[str, ...] = BY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Of every ``size`` consecutive rows the first, the last, the (first) lowest and highest, and those without a value."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_b", F.floor((F.row_number().over(w) - 1) / size))
    b = Window.partitionBy(*by, "_b")
    o = b.orderBy(*order)
    rows = rows.withColumns({"_i": F.row_number().over(o), "_n": F.count("*").over(b), "_lo": F.min(value).over(b), "_hi": F.max(value).over(b)})
    rows = rows.withColumns({"_li": F.min(F.when(F.col(value) == F.col("_lo"), F.col("_i"))).over(b), "_ui": F.min(F.when(F.col(value) == F.col("_hi"), F.col("_i"))).over(b)})
    keep = (F.col("_i") == 1) | (F.col("_i") == F.col("_n")) | (F.col("_i") == F.col("_li")) | (F.col("_i") == F.col("_ui")) | F.col(value).isNull()
    return rows.where(keep).drop("_b", "_i", "_n", "_lo", "_hi", "_li", "_ui")


def open_time(position: str, time: str, w: WindowSpec) -> Column:
    """Microseconds to the next row where the position is open."""
    return F.when(F.col(position) != 0, F.coalesce(F.timestamp_diff("MICROSECOND", F.col(time), F.lead(time).over(w)), F.lit(0))).otherwise(0)


def carried_sums(rows: DataFrame, key: str, time: str, order: tuple[str, ...], columns: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums over a key's whole history, per name: ``<name>`` up to and with the row, ``<name>_begin`` what the row's
    ``_day`` begins with (null if nothing was summed yet). A null key is a key of its own; rows need a time.

    Windows are over one key's day; what it begins with is summed over the days before, one row per key and day."""
    rows = rows.withColumns({f"_v_{n}": c for n, c in columns.items()}).withColumn("_day", F.to_date(time))
    w = Window.partitionBy(key, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    days = rows.groupBy(F.col(key).alias("_key"), F.col("_day").alias("_d")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in columns])
    before = Window.partitionBy("_key").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_key", "_d", *[F.sum(f"_s_{n}").over(before).alias(f"{n}_begin") for n in columns])
    out = rows.withColumns({n: F.sum(f"_v_{n}").over(w) for n in columns}).join(days, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_day") == F.col("_d")))
    return out.withColumns({n: F.coalesce(F.col(n) + F.col(f"{n}_begin"), n, f"{n}_begin") for n in columns}).drop("_key", "_d", *[f"_v_{n}" for n in columns])


def carried_next(rows: DataFrame, key: str, time: str, order: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` (with ``_day``) and the time of the key's next row, on whatever day it is; null on its last row."""
    days = rows.groupBy(F.col(key).alias("_key"), F.col("_day").alias("_d")).agg(F.min(time).alias("_first"))
    days = days.select("_key", "_d", F.lead("_first").over(Window.partitionBy("_key").orderBy("_d")).alias("_after"))
    out = rows.withColumn(name, F.lead(time).over(Window.partitionBy(key, "_day").orderBy(*order))).join(days, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_day") == F.col("_d")))
    return out.withColumn(name, F.coalesce(name, "_after")).drop("_key", "_d", "_after")
