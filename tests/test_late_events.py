import datetime as dt
import random

from tickloom.operators.late_events import corrected_aggregates, late_records

T = dt.datetime(2024, 1, 25, 9)
MD = "row_id long, contract string, exchtime timestamp_ntz, `timestamp` timestamp_ntz, lastpx double, src string, k string"
SNAP = "snapshot_id string, feed_seq long, product string, exchange_ts timestamp_ntz, available_at timestamp_ntz, m string"


def brute(records, cutoff=180):
    """records: (src, key, event, arrival, order, row key)"""
    out, mark = {}, {}
    for src, k, ev, arr, _, row in sorted(records, key=lambda r: (r[3], r[4], r[5])):
        m = mark.get((src, k))
        if m is not None and m >= ev.replace(second=0, microsecond=0) + dt.timedelta(minutes=1):
            out[src, row] = "too_late" if (m - ev).total_seconds() > cutoff else "corrects"
        mark[src, k] = ev if m is None else max(m, ev)
    return out


def make(rng, n):
    rows = []
    for i in range(n):
        ev = T + dt.timedelta(seconds=i * 3, milliseconds=rng.randrange(3000))
        delay = rng.choice([0, 0, 0, 0, 1, 30, 90, 200, 400])
        rows.append((i, rng.choice(["A", "A", "B", None]), None if rng.random() < 0.02 else ev, None if rng.random() < 0.02 else ev + dt.timedelta(seconds=delay), rng.choice([None, 1.5, 2.25, 1e300]), "", ""))
    rows += [(n + j, *rng.choice(rows)[1:]) for j in range(20)]
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(7)
    rows = make(rng, 500)
    snaps = [(f"s{r[0]}", r[0], r[1], r[2], r[3], "") for r in make(rng, 200)]
    snaps += snaps[:20]  # exact copies
    m, s = spark.createDataFrame(rows, MD).repartition(4), spark.createDataFrame(snaps, SNAP)
    records = [("market_data", r[1], r[2], r[3], r[0], str(r[0])) for r in rows if r[2] and r[3]]
    records += list({("snapshots", r[2], r[3], r[4], r[1], r[0]) for r in snaps if r[3] and r[4]})
    want = brute(records)
    got = late_records(m, s).collect()
    assert len(got) == len(want) and {(r.src, r.row_key): r.status for r in got} == want
    # every revision holds all that had arrived within the cut-off
    kept = [r for r in records if want.get((r[0], r[5])) != "too_late"]
    minute = lambda t: t.replace(second=0, microsecond=0)
    revisions = corrected_aggregates(m, s).collect()
    for r in revisions:
        assert r.n == sum(1 for x in kept if x[0] == r.src and x[1] == r.k and minute(x[2]) == r.ev_minute and minute(x[3]) <= r.arr_minute)
    final = [r for r in revisions if r.is_final]
    assert sum(r.n for r in final) == len(kept) and len({(r.src, r.k, r.ev_minute) for r in revisions}) == len(final)


def test_empty(spark):
    m, s = spark.createDataFrame([], MD), spark.createDataFrame([], SNAP)
    assert late_records(m, s).count() == 0 and corrected_aggregates(m, s).count() == 0
