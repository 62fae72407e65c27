import datetime as dt
import math
import random

import numpy as np
import pytest

from tickloom.operators.regular_grid import Grid, missing_slots, regular_grid, session_windows

SCHEMA = "row_id long, contract string, exchtime timestamp_ntz, lastpx double, openinterest long, slot string, value string"
WINDOWS = [(1, "09:00:00", "10:15:00"), (2, "10:30:00", "11:30:00")]


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-25 {text}")


def test_slots_marks_and_fills(spark):
    rows = [
        (1, "A", at("09:00:03"), 100.0, 10), (2, "A", at("09:00:09.9"), 101.0, None), (3, "A", at("09:00:41"), 104.0, None), (4, "A", at("09:00:41"), 105.0, None), (5, "A", at("09:00:55"), None, None),
        (6, "A", at("10:15:00"), 1.0, 1), (7, "A", at("10:29:59"), 1.0, 1), (8, "A", at("10:30:00"), float("nan"), 5), (9, "A", None, 1.0, 1), (10, None, at("09:10:00"), 7.0, 7), (10, None, at("09:10:00"), 7.0, 7),
    ]
    out = regular_grid(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(3), WINDOWS)
    got = {(r.contract, r.slot[11:], r.field): r for r in out.collect()}
    assert len(got) == out.count() == 2 * (6 + 1 + 1)
    assert got["A", "09:00:00", "lastpx"].value == 101.0  # the latest reading
    assert got["A", "09:00:40", "lastpx"].value == 105.0  # of the highest row
    missing = {(r.contract, r.slot[11:], r.field) for r in missing_slots(out).collect()}
    assert missing == {("A", s, "lastpx") for s in ("09:00:10", "09:00:20", "09:00:30", "09:00:50", "10:30:00")} | {("A", f"09:00:{s}0", "openinterest") for s in range(1, 6)}
    fills = [got["A", f"09:00:{s}0", "lastpx"].filled for s in range(6)]
    assert all(a <= b + 1e-6 for a, b in zip(fills, fills[1:])) and math.isclose(fills[0], 101) and math.isclose(fills[4], 105)
    assert got[None, "09:10:00", "openinterest"].filled == 7
    marks = {s: got["A", s, "lastpx"].mark for s in ("09:00:00", "09:00:10", "09:00:50", "10:30:00")}
    assert marks == {"09:00:00": "observed", "09:00:10": "bridged", "09:00:50": "carried", "10:30:00": "predicted"}
    nothing = regular_grid(spark.createDataFrame([(1, "Z", at("09:00:00"), None, 3, "", "")], SCHEMA), WINDOWS).where("field = 'lastpx'").collect()
    assert [(r.mark, r.filled) for r in nothing] == [("unknown", None)]


def features(day, slot, origin, grid=Grid()):
    tau = (slot * grid.slot_s + grid.slot_s / 2) / 86400
    x = [1.0, tau + day - origin]
    for k in range(1, grid.harmonics + 1):
        x += [math.cos(2 * math.pi * k * tau), math.sin(2 * math.pi * k * tau)]
    return x


def test_equals_a_plain_regression_with_bridges(spark):
    """Every prediction and fill against the regression solved at once over all slots, and each gap bridged by hand."""
    rng, rows, i = random.Random(8), [], 0
    for c in ("A", "B"):
        for d in range(3):
            for s in range(9 * 3600, 9 * 3600 + 1800, 10):
                if rng.random() < 0.4:
                    continue
                i += 1
                px = None if rng.random() < 0.2 else 500 + 4 * d + math.sin(s / 3000) * 3 + rng.random()
                rows.append((i, c, dt.datetime(2024, 3, 1) + dt.timedelta(days=d, seconds=s + rng.randrange(10)), px, 5, "", ""))
    got = regular_grid(spark.createDataFrame(rows, SCHEMA), [(1, "09:00:00", "15:00:00")]).where("field = 'lastpx'").collect()
    epoch = dt.date(1970, 1, 1)
    for c in ("A", "B"):
        seen, ends = {}, {}
        for _, k, t, px, *_ in sorted(r for r in rows if r[1] == c):
            day, slot = (t.date() - epoch).days, (t.hour * 3600 + t.minute * 60 + t.second) // 10
            ends.setdefault(day, []).append(slot)
            if px is not None:
                seen[day, slot] = px
        days = [d for d, _ in seen]
        origin = round(sum(days) / len(days))
        x, y = np.array([features(d, s, origin) for d, s in seen]), np.array(list(seen.values()))
        penalty = Grid().ridge * len(y) * np.eye(x.shape[1])
        penalty[0, 0] = 0
        level = y.mean()
        beta = np.linalg.solve(x.T @ x + penalty, x.T @ (y - level))
        fit = lambda d, s: float(np.dot(features(d, s, origin), beta) + level)  # noqa: E731, B023
        mine = {((r.day - epoch).days, (int(r.slot[11:13]) * 3600 + int(r.slot[14:16]) * 60 + int(r.slot[17:])) // 10): r for r in got if r.contract == c}
        assert set(mine) == {(d, s) for d, own in ends.items() for s in range(min(own), max(own) + 1)}
        for (d, s), r in mine.items():
            assert r.value == seen.get((d, s)) and math.isclose(r.predicted, fit(d, s), abs_tol=1e-6)
            if r.value is not None:
                assert r.mark == "observed" and r.filled == r.value
                continue
            a = max((t for e, t in seen if e == d and t < s), default=None)
            b = min((t for e, t in seen if e == d and t > s), default=None)
            off = [None if t is None else seen[d, t] - fit(d, t) for t in (a, b)]
            bridge = off[0] + (off[1] - off[0]) * (s - a) / (b - a) if None not in off else off[0] if off[0] is not None else off[1]
            assert math.isclose(r.filled, fit(d, s) + bridge, abs_tol=1e-6)


def test_season_and_trend_are_learned(spark):
    rows, i = [], 0
    value = lambda d, s: 1000 + 3 * d + 20 * math.sin(2 * math.pi * s / 86400)
    for d in range(6):
        for s in range(9 * 3600, 11 * 3600, 10):
            if d == 3 and 9 * 3600 + 1200 <= s < 9 * 3600 + 3000:
                continue  # half an hour is missing
            i += 1
            rows.append((i, "A", dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=s), value(d, s), 5, "", ""))
    out = regular_grid(spark.createDataFrame(rows, SCHEMA), [(1, "09:00:00", "15:00:00")])
    gaps = [r for r in out.where("mark <> 'observed' and field = 'lastpx'").collect()]
    assert len(gaps) == 180
    for r in gaps:
        s = int(r.slot[11:13]) * 3600 + int(r.slot[14:16]) * 60 + int(r.slot[17:])
        assert abs(r.filled - value(3, s)) < 0.5


def test_empty_and_windows(spark):
    assert regular_grid(spark.createDataFrame([], SCHEMA), WINDOWS).count() == 0
    table = spark.createDataFrame([(i, "09:00:00", "10:00:00") for i in range(5)], "window_order int, opens_at string, closes_at string")
    assert len(session_windows(table)) == 5
    with pytest.raises(ValueError):
        session_windows(table, most=4)
