"""Snapshots that a policy won't trade on still move what rests."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.compare import DIRECTORY
from tickloom.kernel.spark import replay
from tickloom.operators import cleaning
from tickloom.plans import market
from tickloom.plans.replay import _ticks


def test_volume_of_an_untradable_snapshot_reaches_orders(spark):
    t, lv = dt.datetime(2024, 1, 25, 9), lambda p, q: [{"ticks": p, "quantity": q}]
    rows = [(0, lv(100, 2), lv(101, 2), [], True), (1, lv(100, 2), [], lv(100, 9), False), (2, lv(100, 2), lv(101, 2), [], False)]
    df = spark.createDataFrame(
        [("A", t.date(), t + dt.timedelta(seconds=r[0]), *r) for r in rows],
        "contract string, day date, exchtime timestamp_ntz, row_id long, bids array<struct<ticks:long,quantity:long>>, asks array<struct<ticks:long,quantity:long>>, traded array<struct<ticks:long,quantity:long>>, tradable boolean",
    )
    got = replay(df, [{"combo": 1, "every": 1, "qty": 2, "offset": 0, "patience": 40, "limit": 4000}]).collect()
    assert [(r.row_id, r.side, r.px, r.qty) for r in got] == [(1, 1, 100.0, 2)]


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="the test tables are not there")
def test_every_valid_snapshot_is_played(spark):
    ticks = _ticks(spark, DIRECTORY)
    assert ticks.count() == cleaning.valid_rows(market.md(spark, DIRECTORY)).count()
    assert ticks.where(~F.col("tradable")).count() > 0
