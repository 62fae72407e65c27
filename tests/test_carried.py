"""Positions that are carried over midnight, on days of one product (and a null one)."""

import datetime as dt
import random

import duckdb
import pytest

from tests.compare import rows_of_spark, rows_of_sql
from tickloom.kernel.positions import Position
from tickloom.kernel.spark import carried_costs
from tickloom.plans import audit, replay, trading

T = dt.datetime(2024, 1, 25, 23)
FILLS = "fill_id string, order_id string, product string, fill_ts timestamp_ntz, px double, position_delta long, quantity long"


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"f{i:03}", "o", rng.choice(["A", "B"]), T + dt.timedelta(hours=rng.randrange(120), microseconds=i), 100.0 + rng.randrange(20), q := rng.choice([-3, -2, 1, 2, 2, 4]), abs(q)) for i in range(80)]
    rows += [("g0", "o", "C", T, 10.0, 5, 5), ("g1", "o", "C", T + dt.timedelta(hours=2), 14.0, -2, 2), ("g2", "o", "C", T + dt.timedelta(days=9), 15.0, -3, 3), ("n", "o", None, T, 1.0, 1, 1)]
    spark.createDataFrame(rows + rows[:3], FILLS).coalesce(1).write.parquet(f"{tmp_path}/fills.parquet")
    orders = [("r1", "A", "order_declared", 5, None, T), ("r2", "A", "lifecycle", 5, 3, T + dt.timedelta(hours=3)), ("r3", None, "order_declared", 2, None, T), ("r4", None, "lifecycle", 2, 2, T + dt.timedelta(days=2))]
    spark.createDataFrame(orders, "row_id string, product string, record_type string, requested_qty long, filled_qty long, occurred_at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/order_records.parquet")
    spark.createDataFrame([("A", "P", "quoted"), ("B", "P", "hedge"), ("C", "Q", "quoted")], "product string, pair_id string, leg string").coalesce(1).write.parquet(f"{tmp_path}/instruments.parquet")
    return str(tmp_path)


def test_days_begin_with_the_day_before(spark, tables):
    duck = connection_of_folders(tables)
    got = {r.fill_id: r.position for r in trading.inventory(spark, tables).collect()}
    assert [got[k] for k in ("g0", "g1", "g2")] == [5, 3, 0]
    days = {r.day.day: (r.open_us, r.peak, r.last_position) for r in trading.time_in_inventory(spark, tables).where("product = 'C'").collect()}
    assert days == {25: (2 * 3600_000_000, 5, 5), 26: ((9 * 24 - 2) * 3600_000_000, 5, 3), 3: (0, 3, 0)}
    costs = {r.key: (r.pos, r.cost, r.realised) for r in replay.position_cost(spark, tables).collect()}
    assert costs["g1"] == (3, 10.0, round(8 - 2 * 14 * 0.0001, 6)) and costs["g2"] == (0, 10.0, round(15 - 3 * 15 * 0.0001, 6))
    reserved = {r.row_id: r.reserved for r in trading.capacity_running(spark, tables).collect()}
    assert reserved == {"r1": 5, "r2": 2, "r3": 2, "r4": 0}
    for plan, name in ((trading, "inventory"), (trading, "time_in_inventory"), (trading, "capacity_running"), (replay, "position_cost"), (audit, "running_residual")):
        assert rows_of_spark(plan.QUERIES[name](spark, tables)) == rows_of_sql(duck, plan.SQL[name]), name


def connection_of_folders(directory):
    c = duckdb.connect()
    for t in ("fills", "order_records", "instruments"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet/*.parquet'")
    return c


def test_cost_is_that_of_the_whole_history(spark):
    rng = random.Random(9)
    fills = [(f"{i:03}", "A", T + dt.timedelta(hours=7 * i), float(rng.randrange(90, 110)), rng.choice([-4, -1, 0, 1, 3])) for i in range(120)]
    p, want = Position(fee=0.001), []
    for key, _, _, px, q in fills:
        want.append((key, (p.fill(px, q), p.qty, p.cost)))
    df = spark.createDataFrame(fills, "key string, product string, at timestamp_ntz, px double, qty long")
    got = {r.key: (r.realised, r.pos, r.cost) for r in carried_costs(df, "product", ("at", "key"), fee=0.001).collect()}
    for key, w in want:
        assert got[key] == pytest.approx(w)
