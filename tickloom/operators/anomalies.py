"""Implausible readings: spikes, stuck values and impossible values of a source.

One sort of the rows by source and day gives every field's series of readings, which an undecimated wavelet transform
takes apart: the Haar lifting step with holes, without smoothing, so that an odd value has no part in the details of readings
that are not compared with it. At level j a reading's detail is its difference from the reading 2^(j-1) before. Details are
scaled by a robust measure of the source (the median non-zero detail of level 1). A spike of k readings is searched at the
level of its width (1; 2 and 3; 4 to 7): the details at which it is entered and left must both exceed the threshold there.
Runs of zero details are stuck values, and bounds give the impossible readings. The exact rules are then tested at those
places only.

Scale: one shuffle on (source, day), which both passes (scale, detection) read. A day of a source is bounded
by the clock and the feed's cadence, so a source that holds a third of all rows is cut into its days. The
scale itself is never computed from a collected group: changes are counted by value in the map side, then by ranges of values,
and only the range that holds the middle is sorted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """What counts as implausible. ``jump``: usual steps that a spike exceeds on both sides; ``widest``: most
    readings of a spike; ``levels``: those searched, each for the widths it stands for; ``stuck``: least equal readings;
    ``lively``: least distinct values of every other field."""

    prices: tuple[str, ...] = ("bidpx0", "askpx0", "lastpx")
    totals: tuple[str, ...] = ("totalvol",)
    jump: float = 25.0
    widest: int = 6
    levels: tuple[int, ...] = (1, 2, 3)
    stuck: int = 25
    lively: int = 5

    @property
    def fields(self) -> tuple[str, ...]:
        return self.prices + self.totals


def lifted_details(x: np.ndarray, level: int) -> np.ndarray:
    """The details of one level: each reading less the one 2^(level-1) before; 0 where there is none, and of equal readings."""
    lag, out = 1 << (level - 1), np.zeros(len(x))
    if len(x) > lag:
        with np.errstate(over="ignore", invalid="ignore"):
            now, then = x[lag:], x[:-lag]
            apart = now.astype(np.float64) - then.astype(np.float64)
            out[lag:] = np.where(now == then, 0.0, np.where(apart == 0, np.where(now > then, 1.0, -1.0), apart))  # whole numbers beyond 2^53
    return out


def _widths(rules: Rules) -> list[tuple[int, int]]:
    """(width, level) of the groups searched: a level stands for the widths from 2^(level-1) up to below 2^level."""
    return [(k, k.bit_length()) for k in range(1, rules.widest + 1) if k.bit_length() in rules.levels]


def _edges(x: np.ndarray, details: dict[int, np.ndarray], threshold: float, rules: Rules) -> np.ndarray:
    """Readings of a price that lie in a group of one to ``widest`` which is off both neighbours by more than
    ``threshold``. At the level of its width, the detail that compares a reading of the group with the one before the group is
    large, and so is the detail of the reading after it."""
    hit = np.zeros(len(x), dtype=bool)
    large = {j: np.abs(d) > threshold for j, d in details.items()}
    for k, level in _widths(rules):
        p = np.flatnonzero(large[level]) - (1 << (level - 1)) + 1
        p = p[(p >= 1) & (p + k < len(x))]
        p = p[large[level][p + k]]
        if not len(p):
            continue
        group = x[p[:, None] + np.arange(k)]
        off = (np.abs(group - x[p - 1][:, None]) > threshold) & (np.abs(group - x[p + k][:, None]) > threshold)
        for q in p[off.all(axis=1)]:
            hit[q : q + k] = True
    return hit


def _out_of_order(x: np.ndarray, details: dict[int, np.ndarray], rules: Rules) -> np.ndarray:
    """Readings of a running total that lie in a group all below or all above both neighbours, these being in
    order. At the level of its width, the group is entered (if below) or left (if above) by a negative detail."""
    hit = np.zeros(len(x), dtype=bool)
    for k, level in _widths(rules):
        falls = np.flatnonzero(details[level] < 0)
        p = np.unique(np.concatenate([falls - (1 << (level - 1)) + 1, falls - k]))
        p = p[(p >= 1) & (p + k < len(x))]
        if not len(p):
            continue
        group, before, after = x[p[:, None] + np.arange(k)], x[p - 1], x[p + k]
        bad = (before <= after) & ((group.max(axis=1) < before) | (group.min(axis=1) > after))
        for q in p[bad]:
            hit[q : q + k] = True
    return hit


@dataclass
class _Series:
    """The readings of one field: value, first and last row, and the row's reading (-1: none)."""

    values: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rows: np.ndarray
    reading: np.ndarray


def _series(column: pa.ChunkedArray, times: np.ndarray, order: np.ndarray) -> tuple[_Series, np.ndarray, np.ndarray]:
    values = column.to_numpy(zero_copy_only=False) if column.null_count == 0 else None
    if values is None:
        there = column.is_valid().to_numpy()
        values = column.fill_null(0).to_numpy()
    else:
        there = np.ones(len(values), dtype=bool)
    if values.dtype.kind == "f":
        there = there & ~np.isnan(values)
    values, there = values[order], there[order]
    rows = np.flatnonzero(there)
    t = times[rows]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = t[1:] != t[:-1]
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(rows)) - 1 if len(starts) else starts
    return _Series(values[rows][new], rows[starts], rows[last], rows, np.cumsum(new) - 1), values, there


def _ordered(table: pa.Table, time: str, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    times = table.column(time).cast(pa.int64()).to_numpy()
    keys = table.column(key).fill_null(-1).to_numpy()
    order = np.lexsort((keys, times))
    return times[order], table.column(key).to_numpy(zero_copy_only=False)[order], order


def _changes(rules: Rules, time: str, key: str, source: str):
    def of(group: tuple, table: pa.Table) -> pa.Table:
        times, _, order = _ordered(table, time, key)
        names, sizes, counts = [], [], []
        for f in rules.prices:
            detail = lifted_details(_series(table.column(f), times, order)[0].values, 1)
            change, n = np.unique(np.abs(detail[detail != 0]), return_counts=True)
            names += [f] * len(n)
            sizes.append(change)
            counts.append(n)
        m = len(names)
        return pa.table({
            "source": pa.array([group[0].as_py()] * m, pa.string()), "field": pa.array(names, pa.string()),
            "change": pa.array(np.concatenate(sizes), pa.float64()), "n": pa.array(np.concatenate(counts), pa.int64()),
        })

    return of


def usual_steps(changes: DataFrame) -> DataFrame:
    """(source, field, step): the exact median of counted non-zero changes; the mean of the middle two if even.

    ``changes``: source, field, change, n. Ranges of values (an eighth of an octave) are counted first; the values of the one or two
    ranges that hold the middle are then placed one by one. Empty input gives no rows."""
    counted = changes.groupBy("source", "field", "change").agg(F.sum("n").alias("n")).withColumn("span", F.floor(F.log2("change") * 8))
    by = Window.partitionBy("source", "field")
    upto = lambda c: by.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    spans = counted.groupBy("source", "field", "span").agg(F.sum("n").alias("m"))
    spans = spans.withColumns({"under": F.sum("m").over(upto("span")) - F.col("m"), "total": F.sum("m").over(by)})
    spans = spans.where((F.col("under") + F.col("m") >= low) & (F.col("under") < high)).withColumnsRenamed({"source": "s_source", "field": "s_field", "span": "s_span"})
    here = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("field") == F.col("s_field")) & (F.col("span") == F.col("s_span"))
    within = Window.partitionBy("source", "field", "span").orderBy("change").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(spans, here).withColumn("upto", F.col("under") + F.sum("n").over(within))
    middle = placed.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high))
    return middle.groupBy("source", "field").agg(((F.min("change") + F.max("change")) / 2).alias("step"))


FLAGS = "row_key long, source string, field string, kind string, score double"


def _flags(rules: Rules, time: str, key: str):
    def of(group: tuple, table: pa.Table, steps: pa.Table) -> pa.Table:
        step = dict(zip(steps.column("field").to_pylist(), steps.column("step").to_pylist(), strict=True)) if len(steps) else {}
        times, keys, order = _ordered(table, time, key) if len(table) else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8"))
        series = {f: _series(table.column(f), times, order) for f in rules.fields}
        out: dict[str, list] = {"row_key": [], "field": [], "kind": [], "score": []}

        def emit(f: str, kind: str, s: _Series, hit: np.ndarray, score: np.ndarray | None) -> None:
            at = np.flatnonzero(hit[s.reading]) if len(s.rows) else s.rows
            out["row_key"].append(keys[s.rows[at]])
            out["field"] += [f] * len(at)
            out["kind"] += [kind] * len(at)
            out["score"].append(np.full(len(at), np.nan) if score is None else score[s.reading[at]])

        for f in rules.fields:
            s = series[f][0]
            if not len(s.values):
                continue
            details = {j: lifted_details(s.values, j) for j in {1, *rules.levels}}
            emit(f, "impossible", s, s.values <= 0 if f in rules.prices else s.values < 0, None)
            if f in rules.totals:
                emit(f, "spike", s, _out_of_order(s.values, details, rules), None)
            elif step.get(f):
                with np.errstate(over="ignore"):
                    strongest = np.max(np.abs(np.stack([details[j] for j in rules.levels])), axis=0) / step[f]
                emit(f, "spike", s, _edges(s.values, details, rules.jump * step[f], rules), strongest)
            still = np.zeros(len(s.values), dtype=bool)
            zero = np.concatenate([[False], details[1][1:] == 0, [False]])
            begins = np.flatnonzero(zero[1:] & ~zero[:-1])
            ends = np.flatnonzero(zero[:-1] & ~zero[1:])
            for b, e in zip(begins, ends, strict=True):
                if e - b + 1 < rules.stuck:
                    continue
                stretch = slice(s.first[b], s.last[e] + 1)
                others = [series[g] for g in rules.fields if g != f]
                if all(len(np.unique(v[stretch][there[stretch]])) >= rules.lively for _, v, there in others):
                    still[b + 1 : e + 1] = True
            emit(f, "stuck", s, still, None)
        m = len(out["field"])
        keys_out = np.concatenate(out["row_key"]) if out["row_key"] else np.empty(0, "i8")
        score = np.concatenate(out["score"]) if out["score"] else np.empty(0)
        return pa.table({
            "row_key": pa.array(keys_out, pa.int64()), "source": pa.array([group[0].as_py()] * m, pa.string()),
            "field": pa.array(out["field"], pa.string()), "kind": pa.array(out["kind"], pa.string()),
            "score": pa.array(score, pa.float64(), from_pandas=True),
        })

    return of


def implausible_readings(df: DataFrame, key: str = "row_id", source: str = "contract", time: str = "exchtime", rules: Rules = Rules()) -> DataFrame:
    """Rows of implausible readings: row_key, source, field, kind (impossible, spike, stuck), score.

    ``score`` is the strongest detail of the reading over the levels in usual steps, for a price's spike.
    Readings of a field are the rows of a source and calendar day with time and field, in order of time; rows
    of one time are one reading, whose value is that of the lowest key, and all of them are flagged with it.
    Null or NaN fields are no reading; rows without time are left out; a null source is a source of its own.
    A reading may be flagged by several kinds. Columns beyond those named are ignored, whatever their names.
    Empty input gives an empty result; a field without non-zero changes has no spikes.
    """
    rows = df.where(F.col(time).isNotNull()).select(
        F.col(source).cast("string").alias("_source"), F.to_date(time).alias("_day"), F.col(key).cast("long").alias("_key"),
        F.col(time).cast("timestamp_ntz").alias("_time"), *[F.col(f).cast("double").alias(f) for f in rules.prices],
        *[F.col(f).cast("long").alias(f) for f in rules.totals],
    )
    grouped = rows.groupBy("_source", "_day")
    changes = grouped.applyInArrow(_changes(rules, "_time", "_key", "_source"), "source string, field string, change double, n long")
    steps = usual_steps(changes)
    # The steps of a source go to each of its days, so that both passes read the one shuffle of the rows.
    days = rows.select(F.col("_source").alias("of"), F.col("_day").alias("day")).distinct()
    wanted = days.join(steps, F.col("of").eqNullSafe(F.col("source"))).select("of", "day", "field", "step")
    return grouped.cogroup(wanted.groupBy("of", "day")).applyInArrow(_flags(rules, "_time", "_key"), FLAGS)


def implausible_fields(flags: DataFrame, rules_of: Iterable[str] | None = None) -> DataFrame:
    """Each flagged row and field once: row_id, field; only of the given kinds where some are named."""
    kept = flags if rules_of is None else flags.where(F.col("kind").isin(list(rules_of)))
    return kept.select(F.col("row_key").alias("row_id"), "field").distinct()
