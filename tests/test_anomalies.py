"""Implausible readings against a plain reading of the rules."""

import datetime as dt
import math
import random
from collections import defaultdict
from statistics import median

import numpy as np
import pytest

from tickloom.operators.anomalies import Rules, implausible_fields, implausible_readings, lifted_details, usual_steps

FIELDS = ("bidpx0", "askpx0", "lastpx", "totalvol")
SCHEMA = "row_id long, contract string, exchtime timestamp_ntz, bidpx0 double, askpx0 double, lastpx double, totalvol long, field string, source string"
DAY = dt.datetime(2024, 1, 25, 9)


def brute(rows, rules=Rules()):
    groups = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            groups[r[1], r[2].date()].append(r)
    series, changes = {}, defaultdict(list)
    for g, own in groups.items():
        own.sort(key=lambda r: (r[2], r[0]))
        for k, f in enumerate(FIELDS):
            readings = []  # time, value, positions
            for at, r in enumerate(own):
                v = r[3 + k]
                if v is None or math.isnan(v):
                    continue
                if readings and readings[-1][0] == r[2]:
                    readings[-1][2].append(at)
                else:
                    readings.append((r[2], v, [at]))
            series[g, f] = readings
            changes[g[0], f] += [abs(b[1] - a[1]) for a, b in zip(readings, readings[1:]) if a[1] != b[1]]
    out = set()
    for (g, f), readings in series.items():
        v = [x[1] for x in readings]
        bad = {i for i, x in enumerate(v) if (x <= 0 if f != "totalvol" else x < 0)}
        step = median(changes[g[0], f]) if changes[g[0], f] else None
        for i in range(1, len(v)):
            for k in range(1, rules.widest + 1):
                if i + k >= len(v):
                    break
                group, a, b = v[i : i + k], v[i - 1], v[i + k]
                if f != "totalvol":
                    hit = step is not None and all(abs(x - a) > rules.jump * step and abs(x - b) > rules.jump * step for x in group)
                else:
                    hit = a <= b and (all(x < a for x in group) or all(x > b for x in group))
                if hit:
                    bad |= set(range(i, i + k))
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if j - i + 1 >= rules.stuck:
                stretch = groups[g][readings[i][2][0] : readings[j][2][-1] + 1]
                others = [{r[3 + k] for r in stretch if r[3 + k] is not None} for k, o in enumerate(FIELDS) if o != f]
                if all(len(o) >= rules.lively for o in others):
                    bad |= set(range(i + 1, j + 1))
            i = j + 1
        out |= {(groups[g][p][0], f) for i in bad for p in readings[i][2]}
    return out


def walk(rng, contract, day, n, first_id):
    px, total, out = 1000.0, 5000, []
    t = DAY + dt.timedelta(days=day)
    freeze = rng.randrange(20, n) if n > 60 else None
    for i in range(n):
        t += dt.timedelta(milliseconds=rng.choice([0, 250, 500, 500, 1000]))
        px += rng.choice([-1, 0, 0, 1]) * 0.5
        total += rng.randrange(0, 9)
        row = [px, px + 0.5, px, total]
        if rng.random() < 0.05:
            k = rng.randrange(4)
            row[k] = rng.choice([None, 0 if k == 3 else 0.0, -5, 10**7, row[k] - 40, row[k] + 13, row[k] + 12.5 if k < 3 else row[k] + 1])
        if freeze and freeze <= i < freeze + 30:
            row[2] = 777.0
        out.append((first_id + i, contract, None if rng.random() < 0.02 else t, *[None if x is None else float(x) if k < 3 else int(x) for k, x in enumerate(row)], "x", "y"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for contract, day, n in [("A", 0, 300), ("A", 1, 150), ("B", 0, 80), (None, 0, 90), ("C", 0, 3), ("D", 0, 1)]:
        rows += walk(rng, contract, day, n, at)
        at += n
    for _ in range(20):  # copies under another id
        r = rng.choice(rows)
        rows.append((at, *r[1:]))
        at += 1
    flags = implausible_readings(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = {(r.row_id, r.field) for r in implausible_fields(flags).collect()}
    assert got == brute(rows) and got


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert implausible_readings(none).count() == 0
    flat = [(i, "A", DAY + dt.timedelta(seconds=i), 5.0, 5.0, 5.0, 7, "", "") for i in range(60)]  # a halt: nothing else moves
    assert implausible_readings(spark.createDataFrame(flat, SCHEMA)).count() == 0
    empty = [(i, "A", DAY, None, float("nan"), None, None, "", "") for i in range(3)]
    assert implausible_readings(spark.createDataFrame(empty, SCHEMA)).count() == 0


def test_usual_step_is_the_exact_median(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 10):
        sizes = [(rng.randrange(1, 9) / 2, rng.randrange(1, 5)) for _ in range(n)]
        df = spark.createDataFrame([("s", "f", float(a), c) for a, c in sizes], "source string, field string, change double, n long")
        assert usual_steps(df).collect()[0].step == median([a for a, c in sizes for _ in range(c)])


def test_details():
    x = np.array([1.0, 1.0, 5.0, 5.0, 5.0])
    assert lifted_details(x, 1).tolist() == [0, 0, 4, 0, 0]
    assert lifted_details(x, 2).tolist() == [0, 0, 4, 4, 0]
    assert lifted_details(x, 3).tolist() == [0, 0, 0, 0, 4]
    assert lifted_details(np.array([]), 1).size == 0
    assert lifted_details(np.array([1e308, -1e308, np.inf, np.inf]), 1).tolist() == [0, -np.inf, np.inf, 0]


@pytest.mark.parametrize("width, level", [(1, 1), (2, 2), (3, 2), (4, 3), (6, 3)])
def test_a_spike_is_found_at_the_level_of_its_width(spark, width, level):
    rows = []
    for i in range(40):
        odd = 20 <= i < 20 + width
        px = 1000.0 + i % 2 + (500 if odd else 0)
        rows.append((i, "A", DAY + dt.timedelta(seconds=i), px, px + 1, px, 10 * i + (5000 if odd else 0), "", ""))
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = {(i, f) for i in range(20, 20 + width) for f in FIELDS}
    assert {tuple(r) for r in implausible_fields(implausible_readings(df)).collect()} == wanted
    without = Rules(levels=tuple(j for j in (1, 2, 3) if j != level))
    assert implausible_readings(df, rules=without).count() == 0


def test_a_spike_beside_another_and_of_both_signs(spark):
    off = {10: 300, 11: 600, 12: -700, 13: 0, 14: 400, 15: -400}
    rows = [(i, "A", DAY + dt.timedelta(seconds=i), 1000.0 + i % 2 + off.get(i, 0), 2000.0 + i % 2, 1000.0 + i % 3, i, "", "") for i in range(40)]
    got = {(r.row_id, r.field) for r in implausible_fields(implausible_readings(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows) and {(i, "bidpx0") for i in (10, 11, 12, 14, 15)} <= got
