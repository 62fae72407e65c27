"""Irregular readings onto a regular grid, with the gaps marked and filled.

Every recorded stretch of a source (a session window of a day) becomes a series of equal slots from its first
row's to its last row's. A slot's reading is the last of its rows. Slots without one are predicted by a
regression on harmonics of the time of day with a linear trend, fitted to the source's plausible readings, and the prediction is shifted so that it meets
the observed readings at both ends of the gap (the residuals there are joined by a line).

The regression is fitted by normal equations: each (source, field, day) sums its products of features in the map
side, a fixed number of sums however many rows there are; the days of a source are then moved to one
origin and solved. Only slots (never rows) are sorted, by stretch, whose length the clock bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_S = 86_400


@dataclass(frozen=True)
class Grid:
    """``slot_s`` divides a day; ``harmonics`` of the day; ``ridge``: weight of the penalty on all but the mean."""

    slot_s: int = 10
    harmonics: int = 2
    ridge: float = 1e-3


def second_of_day(time: Column) -> Column:
    return F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def _clock(text: str) -> int:
    h, m, s = (int(x) for x in text.split(":"))
    return h * 3600 + m * 60 + s


def window_of(time: Column, windows: list[tuple[int, str, str]]) -> Column:
    """The first window (order, opens_at, closes_at) that holds the time; the close is outside. Else null."""
    out, at = F.lit(None).cast("int"), second_of_day(time)
    for order, opens, closes in sorted(windows, reverse=True):
        out = F.when((at >= _clock(opens)) & (at < _clock(closes)), F.lit(order)).otherwise(out)
    return out


def session_windows(table: DataFrame, most: int = 100) -> list[tuple[int, str, str]]:
    """The rows of a table of session windows, which is fixed; more than ``most`` rows are an error."""
    rows = table.select("window_order", "opens_at", "closes_at").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} session windows")
    return [tuple(r) for r in rows]


def slot_readings(df: DataFrame, fields: tuple[str, ...], windows: list[tuple[int, str, str]], grid: Grid, source: str, time: str, key: str) -> DataFrame:
    """One row per stretch and slot that holds a row: of, day, win, slot, and each field's last reading."""
    t = F.col(time)
    rows = df.where(t.isNotNull()).select(
        F.col(source).cast("string").alias("of"), F.to_date(t).alias("day"), window_of(t, windows).alias("win"),
        F.expr(f"cast({grid.slot_s} as int)").alias("_s"), second_of_day(t).alias("_sec"), t.alias("_t"), F.col(key).alias("_k"), *fields,
    ).where(F.col("win").isNotNull()).withColumn("slot", F.expr("_sec div _s").cast("int"))
    when = F.struct("_t", "_k")
    return rows.groupBy("of", "day", "win", "slot").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), when)).cast("double").alias(f) for f in fields])


def _features(grid: Grid, slot: Column) -> list[Column]:
    """Within a day: 1, the time in days, and the harmonics."""
    tau = (slot * grid.slot_s + grid.slot_s / 2) / DAY_S
    out = [F.lit(1.0), tau]
    for k in range(1, grid.harmonics + 1):
        out += [F.cos(tau * (2 * math.pi * k)), F.sin(tau * (2 * math.pi * k))]
    return out


def _solver(size: int, grid: Grid):
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def solve(group: tuple, table: pa.Table) -> pa.Table:
        days = table.column("day").cast(pa.int32()).to_numpy().astype(float)
        n = table.column("n").to_numpy().astype(float)
        origin = float(np.round((days * n).sum() / n.sum()))
        level = float(np.sum(table.column("y").to_numpy()) / n.sum())
        gram, right = np.zeros((size, size)), np.zeros(size)
        products = np.stack([table.column(f"p{i}_{j}").to_numpy() for i, j in pairs])
        targets = np.stack([table.column(f"t{i}").to_numpy() for i in range(size)])
        for d in range(len(days)):
            own = np.zeros((size, size))
            for (i, j), v in zip(pairs, products[:, d], strict=True):
                own[i, j] = own[j, i] = v
            shift = np.eye(size)
            shift[1, 0] = days[d] - origin  # the trend's time is that of the day plus the days since the origin
            gram += shift @ own @ shift.T
            right += shift @ (targets[:, d] - level * own[:, 0])
        penalty = grid.ridge * n.sum() * np.eye(size)
        penalty[0, 0] = 0
        beta = np.linalg.lstsq(gram + penalty, right, rcond=None)[0]
        return pa.table({
            "m_of": pa.array([group[0].as_py()], pa.string()), "m_field": pa.array([group[1].as_py()], pa.string()), "origin": pa.array([origin]),
            "beta": pa.array([[float(beta[0] + level), *map(float, beta[1:])]], pa.list_(pa.float64())),
        })

    return solve


def seasonal_model(observed: DataFrame, grid: Grid) -> DataFrame:
    """(m_of, m_field, origin, beta): regression of every source and field over observed (of, day, field, slot, value)."""
    x = _features(grid, F.col("slot"))
    size = len(x)
    y = F.col("value")
    sums = [F.count("*").alias("n"), F.sum(y).alias("y")]
    sums += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(x[i] * y).alias(f"t{i}") for i in range(size)]
    by_day = observed.groupBy("of", "field", "day").agg(*sums)
    return by_day.groupBy("of", "field").applyInArrow(_solver(size, grid), "m_of string, m_field string, origin double, beta array<double>")


def plausible(long: DataFrame, reach: float = 10.0, share: float = 0.1) -> DataFrame:
    """Readings near the source's middle, which alone may shape the fit: within ``reach`` interquartile ranges plus
    ``share`` of the median. The quartiles come from mergeable summaries of fixed size."""
    seen = long.where(F.col("value").isNotNull())
    q = seen.groupBy(F.col("of").alias("q_of"), F.col("field").alias("q_field")).agg(F.percentile_approx("value", [0.25, 0.5, 0.75], 1000).alias("q"))
    off = F.abs(F.col("value") - F.col("q")[1])
    near = off <= reach * (F.col("q")[2] - F.col("q")[0]) + share * F.abs(F.col("q")[1])
    return seen.join(q, F.col("of").eqNullSafe(F.col("q_of")) & (F.col("field") == F.col("q_field"))).where(near).select(*long.columns)


def regular_grid(
    df: DataFrame, windows: list[tuple[int, str, str]], fields: tuple[str, ...] = ("lastpx", "openinterest"), grid: Grid = Grid(),
    source: str = "contract", time: str = "exchtime", key: str = "row_id",
) -> DataFrame:
    """(contract, day, win, slot, field, value, mark, predicted, filled) for every slot of every stretch.

    A stretch is a source, calendar day and session window; its slots run from that of its first row to that of
    its last, whatever these hold. ``value`` is the reading of the latest row (then of the highest key) that has
    one; NaN counts as null. ``filled`` is ``value``, or in a gap the prediction plus the residuals of the readings before and
    after it, in proportion to the distance; at an open end, plus the one residual there is; with no reading of the
    field in the stretch, the bare prediction; null if the source has no reading of the field at all. ``mark`` says which of these it
    is: observed, bridged, carried, predicted or unknown. Rows without
    time or outside the windows are left out; a null source is a source of its own; other columns are ignored.
    """
    clean = df.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f)) for f in fields})
    slots = slot_readings(clean, fields, windows, grid, source, time, key)
    long = slots.select("of", "day", "win", "slot", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("r")).select("of", "day", "win", "slot", "r.field", "r.value")
    model = seasonal_model(plausible(long), grid)
    by = Window.partitionBy("of", "day", "win", "field")
    up, down = by.orderBy("slot"), by.orderBy(F.col("slot").desc())
    here = F.when(F.col("value").isNotNull(), F.struct(F.col("slot").alias("s"), F.col("value").alias("v")))
    kept = long.withColumns({"next_row": F.lead("slot").over(up), "before": F.last(here, True).over(up.rowsBetween(Window.unboundedPreceding, 0))})
    kept = kept.withColumn("after", F.last(here, True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    full = kept.select(
        "of", "day", "win", "field", F.col("slot").alias("row_slot"), "value", "before", "after",
        F.explode(F.sequence("slot", F.coalesce(F.col("next_row") - 1, F.col("slot")))).alias("slot"),
    ).withColumn("value", F.when(F.col("slot") == F.col("row_slot"), F.col("value")))
    fit = full.join(model, F.col("of").eqNullSafe(F.col("m_of")) & (F.col("field") == F.col("m_field")), "left")

    def predicted(slot: Column) -> Column:
        x = _features(grid, slot)
        x[1] = x[1] + F.datediff(F.col("day"), F.lit("1970-01-01").cast("date")) - F.col("origin")
        total = F.lit(0.0)
        for i, f in enumerate(x):
            total = total + F.col("beta")[i] * f
        return total

    fit = fit.withColumns({
        "predicted": predicted(F.col("slot")),
        "left_off": F.col("before.v") - predicted(F.col("before.s")), "right_off": F.col("after.v") - predicted(F.col("after.s")),
    })
    share = (F.col("slot") - F.col("before.s")) / (F.col("after.s") - F.col("before.s"))
    bridge = F.when(F.col("before").isNull(), F.coalesce(F.col("right_off"), F.lit(0.0))).when(F.col("after").isNull(), F.col("left_off")).otherwise(F.col("left_off") + (F.col("right_off") - F.col("left_off")) * share)
    filled = F.coalesce(F.col("value"), F.col("predicted") + bridge)
    ends = F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")
    mark = F.when(F.col("value").isNotNull(), "observed").when(filled.isNull(), "unknown").when(ends == 2, "bridged").when(ends == 1, "carried").otherwise("predicted")
    second = F.col("slot") * grid.slot_s
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", pad(F.floor(second / 3600)), pad(F.floor(second / 60) % 60), pad(second % 60))
    return fit.select(
        F.col("of").alias("contract"), "day", "win", F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), clock).alias("slot"), "field", "value",
        mark.alias("mark"), "predicted", filled.alias("filled"),
    )


def missing_slots(gridded: DataFrame) -> DataFrame:
    """(contract, slot, field) of the slots that the model had to fill, or could not."""
    return gridded.where(F.col("mark") != "observed").select("contract", "slot", "field")
