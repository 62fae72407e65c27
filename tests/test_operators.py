"""Small cases with known results for the relational operators."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import clock, ticks
from tickloom.operators import alignment, cleaning, integrity, reports, signals, stress, validation
from tickloom.sources import files

T = dt.datetime(2024, 1, 25, 9)
BOOK = ", ".join(f"{s}px{i} double, {s}vol{i} int" for s in ("bid", "ask") for i in range(5))


def at(s):
    return T + dt.timedelta(seconds=s)


def book(bid=100.0, ask=101.0, vols=(3, 3, 3, 3, 3)):
    return [x for i in range(5) for x in (bid - i, vols[i])] + [x for i in range(5) for x in (ask + i, 3)]


def test_repair_cascades(spark):
    df = spark.createDataFrame([tuple(book(vols=(0, 0, 3, 0, 3)))], BOOK)
    r = cleaning.repaired(df).collect()[0]
    assert [r[f"bidpx{i}"] for i in range(5)] == [101, 101, 98, 98, 96] and r.askpx0 == 101


def test_copy_decides_before_the_price_filter(spark):
    rows = [(1, "A", at(0), 5.0, 1), (2, "A", at(0), 0.0, 1), (3, None, at(0), 5.0, 1), (4, "A", None, 5.0, 1)]
    df = spark.createDataFrame(rows, "row_id long, contract string, exchtime timestamp_ntz, bidpx0 double, totalvol long")
    assert cleaning.valid_rows(df).count() == 0 and cleaning.keep_last(df).collect()[0].row_id == 2


def test_intervals(spark):
    rows = [(1, "A", T.date(), at(0), 10, 1000.0), (2, "A", T.date(), at(1), 13, 1298.0), (3, "A", T.date(), at(2), 2, 200.0), (4, "A", T.date(), at(3), 2, 200.0)]
    df = spark.createDataFrame(rows, "row_id long, contract string, day date, exchtime timestamp_ntz, totalvol long, totalvalue double").withColumns({"tick": F.lit(1.0), "multiplier": F.lit(1.0)})
    out = {r.row_id: r for r in cleaning.interval_buckets(cleaning.epochs(df), "tick", "multiplier").collect()}
    assert [(b.ticks, b.quantity) for b in out[2].buckets] == [(99, 2), (100, 1)]
    assert out[1].buckets is None and out[3].epoch == 1 and out[3].d_vol is None and out[4].buckets is None
    split = spark.createDataFrame([(99.5, 3.0, 1.0)], "p double, v double, t double")
    assert [tuple(cleaning.two_tick_split(split, "p", "v", "t", m).select("p1", "p2", "v1", "v2").collect()[0]) for m in ("even", "up")] == [(99, 100, 1, 2), (99, 100, 1, 2)]


def test_ticks(spark):
    df = spark.createDataFrame([(99.9975, 0.005), (99.9996, 0.005), (100.0004, 0.005), (1e300, 0.005), (None, 0.005)], "p double, t double")
    got = df.select(ticks.in_ticks(F.col("p"), F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [20000, 20000, 20000, None, None]
    near = df.select(ticks.snapped(F.col("p"), F.col("t")).alias("s")).collect()
    assert [r.s for r in near] == [99.9975, 100.0, 100.0, 1e300, None]
    asks = spark.createDataFrame([([(77985.0, 10), (77990.0, 10)],)], "a array<struct<price:double,quantity:int>>")
    s = asks.select(ticks.sweep(F.col("a"), F.lit(9), F.lit(77990.0), F.lit(True), 0.5).alias("s")).collect()[0].s
    assert (s.filled, s.used, s.notional) == (9, 2, 5 * 77985.0 + 4 * 77990.0)


def test_clock(spark):
    times = [dt.datetime(2024, 1, 26, 17, 59, 59), dt.datetime(2024, 1, 26, 18), dt.datetime(2024, 1, 25, 3), dt.datetime(2024, 1, 25, 15, 0, 0, 1), dt.datetime(2024, 1, 25, 15)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    t = F.col("t")
    out = df.select(clock.trading_day(t).alias("d"), clock.session_class(t).alias("s"), clock.within(t, 75_600, 10_800).alias("n"), clock.within(t, 32_400, 54_000).alias("w")).collect()
    assert [r.d.day for r in out] == [26, 27, 25, 25, 25] and [r.s for r in out] == ["other", "other", "other", "other", "other"]
    assert [r.n for r in out] == [False, False, True, False, False] and [r.w for r in out] == [False, False, False, False, True]


def test_row_checks(spark):
    cases = {"ok": book(), "zero_top_depth": book(vols=(0, 1, 1, 1, 1)), "crossed_book": book(bid=101.0), "negative_depth": book(vols=(1, -1, 1, 1, 1)), "missing_book_field": book()[:-1] + [None]}
    bad = book()
    bad[2] = 100.0
    cases["invalid_bid_order"] = bad
    idle = book(vols=(3, 0, 3, 3, 3))
    idle[2] = 500.0  # a level without quantity doesn't count
    cases["idle"] = idle
    rows = [(k, i, "A", at(0), at(0), *b) for i, (k, b) in enumerate(cases.items())] + [("undeclared_contract", 99, "B", None, None, *book()), ("receive_before_exchange", 98, "A", at(1), at(0), *book()), ("invalid_timestamp", 97, "A", None, at(0), *book())]
    df = spark.createDataFrame(rows, "want string, row_id long, contract string, exchtime timestamp_ntz, timestamp timestamp_ntz, " + BOOK)
    got = {r.want: r.code for r in df.withColumn("code", validation.first_failing(validation.row_checks(F.col("contract") == "A"))).collect()}
    assert {k: (None if k in ("ok", "idle") else k) for k in got} == got


def test_totals_are_held_against_the_last_accepted_row(spark):
    rows = [(1, 5, 5.0), (2, 9, 1.0), (3, 6, 6.0), (4, None, 7.0), (5, 6, 7.0)]
    df = spark.createDataFrame([(i, "A", T.date(), at(i), v, w) for i, v, w in rows], "row_id long, contract string, day date, exchtime timestamp_ntz, totalvol long, totalvalue double")
    assert {r.row_id: r.accepted for r in validation.monotone_totals(df).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_asof(spark):
    left = spark.createDataFrame([("l1", "A", at(10)), ("l2", "A", at(10 + 2 * 86400)), ("l3", "B", at(0)), ("l4", None, at(0)), ("l5", "A", at(-1)), ("l1", "A", at(10))], "id string, k string, t timestamp_ntz")
    right = spark.createDataFrame([(1, "A", at(0)), (2, "A", at(10)), (3, "A", at(10)), (4, "A", at(11)), (5, None, at(0)), (6, "A", None)], "n long, k string, u timestamp_ntz")
    got = alignment.asof_backward(left, right, "k", "t", "u", ("n",), "n").collect()
    assert sorted((r.id, r.asof_n) for r in got if r.asof_n) == [("l1", 3), ("l1", 3), ("l2", 4)] and len(got) == 6
    a = spark.createDataFrame([(1, "g", at(0)), (2, "g", at(5)), (3, "g", at(50))], "n long, g string, t timestamp_ntz")
    b = spark.createDataFrame([(10, "g", at(1)), (20, "g", at(4)), (30, "g", at(6))], "n long, g string, t timestamp_ntz")
    assert {r.n: r.near_n for r in alignment.asof_nearest(a, b, ("g",), "t", ("n",), "n", 2).collect()} == {1: 10, 2: 20, 3: None}


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 1), ("z", None)], "k string, v int")
    assert {(r.k, r.kind) for r in alignment.reconciled(a, b, ("k",), ("v",)).collect()} == {("y", "differs"), ("w", "right_only")}


def test_reports(spark):
    tiers = ((100, 0.0, 1.0), (500, 0.5, 2.0), (None, 1.0, 3.0))
    df = spark.createDataFrame([(600, 1.0), (600, 9.0), (50, 9.0)], "v long, o double")
    assert [r.f for r in df.select(reports.tier_fee(F.col("v"), F.col("o"), tiers, 2.0).alias("f")).collect()] == [300.0, 1200.0, 50.0]
    layers = spark.createDataFrame([(100, 10, 2, 1)], "g long, t long, m long, r long").select(*[c.alias(n) for n, c in reports.pnl_layers(*[F.col(x) for x in "gtmr"]).items()]).collect()[0]
    assert (layers.net, layers.after_rebate, layers.trade_fee_ratio) == (89, 91, 0.1)
    w = spark.createDataFrame([("p", 10.0, 10.0, 20.0, 10.0, 1.5, 0.35, 28.85 - 0.0)], "k string, capture double, quoted_mark double, hedge_mark double, shortfall double, fees double, rebates double, view double")
    assert abs(reports.waterfall(w, ("k",)).collect()[0].residual) < 1e-12
    days = spark.createDataFrame([(T.date() + dt.timedelta(days=i), c) for i, c in enumerate((10, 30, 20, 12))], "day date, cum long")
    assert [r.regime for r in reports.regimes(days).orderBy("day").collect()] == ["profitable", "profitable", "declining", "declining"]
    up = days.withColumn("cum", F.datediff("day", F.lit(T.date())))
    assert [r.regime for r in reports.regimes(up).orderBy("day").collect()] == ["early", "middle", "late", "late"]
    c = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, 7)], "k string, d int, p int")
    assert tuple(reports.concentration(c, "k", "d", "p").collect()[0]) == ("a", 17, 10, 7)


def test_signals(spark):
    df = spark.createDataFrame([("A", T.date(), at(i), i, v) for i, v in enumerate([1, 3, 1, 3, 9, 9])], "contract string, day date, exchtime timestamp_ntz, row_id long, x long")
    assert [r.z for r in df.select("row_id", signals.rolling_z("x", 4).alias("z")).orderBy("row_id").collect()][:5] == [None, None, None, None, 7.0]
    w = Window.partitionBy("contract").orderBy("exchtime")
    z = spark.createDataFrame([("A", at(i), v) for i, v in enumerate([0.0, 2.0, 1.0, 0.2, -2.0, None])], "contract string, exchtime timestamp_ntz, z double")
    assert [r.t for r in z.select("exchtime", signals.targets("z", 1.5, 0.5, w).alias("t")).orderBy("exchtime").collect()] == [0, -1, -1, 0, 1, 1]
    assert [r.x for r in df.withColumn("_k", signals.step_corners("x", w)).where("_k").orderBy("row_id").collect()] == [1, 3, 1, 3, 9, 9]
    assert signals.downsampled(df, "x", 3).count() == 6


def test_integrity(spark):
    df = spark.createDataFrame([("a", "quote>fill>eod", 5), ("b", "fill>quote", -5), ("c", "quote>lunch", 0), ("d", "quote>hedge>fill", 3), ("d", "x", 4)], "id string, route string, v int")
    codes = {r.related_id for r in integrity.route_errors(df, "route", "id", "route", ("quote", "fill", "inventory", "hedge", "eod")).collect()}
    assert codes == {"b", "c", "d"}
    assert [r.related_id for r in integrity.repeated(df, "rep", "id").collect()] == ["d"]
    run = integrity.over_capacity(df, "cap", "id", (), ("id", "v"), "v", F.lit(6)).collect()
    assert {r.related_id for r in run} == {"d"}
    s = integrity.summary(integrity.violations(df, "neg", F.col("v") < 0, "id"), ["neg", "none"])
    assert {tuple(r) for r in s.collect()} == {("neg", False, 1), ("none", True, 0)}


def test_stress(spark):
    with pytest.raises(ValueError):
        stress.scenarios(spark, [("x", 1.0, 0.0, 1.5, 0)])
    df = spark.createDataFrame([(3, 5, 10.0, 5.0)], "q long, h long, wq double, wh double")
    r = df.select(stress.hedge_target(F.col("q"), F.col("wq"), F.col("wh")).alias("t"), stress.residual_risk(F.col("q"), F.col("h"), F.col("wq"), F.col("wh")).alias("r")).collect()[0]
    assert (r.t, r.r) == (-6.0, 55.0)


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": "no"\n{"a": 2}\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1
    for c in ("A", "B"):
        (tmp_path / f"pred_{c}.csv").write_text("ts,pred\n2024-01-25 19:00:00,0.5\n")
    p = files.read_predictions(spark, str(tmp_path / "pred_*.csv"), ["A", "B"])
    assert {(r.contract, r.available_day.day) for r in p.collect()} == {("A", 26), ("B", 26)}
    with pytest.raises(ValueError):
        files.read_predictions(spark, str(tmp_path / "pred_*.csv"), ["A"])
    expected = spark.createDataFrame([("A",), ("C",)], "contract string")
    assert [r.contract for r in files.missing_coverage(expected, p, ["contract"]).collect()] == ["C"]
    assert files.file_hashes(spark, str(tmp_path / "pred_A.csv")).count() == 1
    assert files.manifest({"b": b"1", "a": b"2"}) == files.manifest({"a": b"2", "b": b"1"})
    df = spark.createDataFrame([("A", T.date(), 1), ("B", T.date(), 2)], "contract string, day date, x long")
    files.write_day_csv(df, str(tmp_path / "csv"))
    assert {(r.contract, r.x) for r in files.read_day_csv(spark, str(tmp_path / "csv"), "x long", days=[str(T.date())]).collect()} == {("A", 1), ("B", 2)}
    assert files.read_day_csv(spark, str(tmp_path / "csv"), "x long", days=["2000-01-01"]).count() == 0
    store = files.payload_store(spark.createDataFrame([("h", 1), ("h", 1), ("h", 2), (None, 3)], "h string, p int"), "h", ("p",))
    assert store.count() == 2 and files.collisions(store, "h").collect()[0].n_payloads == 2


def test_prints_from_json(spark):
    good = '{"taker_side":"buy","price":5,"quantity":1,"trade_id":"a"}'
    texts = [None, "[]", f"[{good}]", f"[{good},{good}]", f'[{good.replace("buy", "hold")}]', '[{"taker_side":"sell","price":5,"quantity":1},{"taker_side":"sell","price":5,"quantity":1}]', "no list"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.i for r in df.select("n", validation.normalised_trades(F.col("text"))["issue"].alias("i")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "repeated_trade", 4: "invalid_trade", 5: None, 6: "not_a_list"}


def test_books_under_stress(spark):
    rows = [([100, 99], [101, 103], None), ([], [], None), ([100], [100], "crossed"), ([100, 100], [101], "bid_order"), ([99], [103, 102], "ask_order"), ([0], [1], "not_positive")]
    df = spark.createDataFrame([(i, b, a) for i, (b, a, _) in enumerate(rows)], "n int, b array<bigint>, a array<bigint>")
    assert {r.n: r.i for r in df.select("n", validation.book_issue(F.col("b"), F.col("a")).alias("i")).collect()} == {i: w for i, (_, _, w) in enumerate(rows)}
    moved = df.where("n = 0").select(validation.stretched_levels(F.col("b"), F.lit(201), False).alias("b"), validation.stretched_levels(F.col("a"), F.lit(201), True).alias("a")).collect()[0]
    assert moved.b == [99, 98] and moved.a == [102, 104]


def test_calendar(spark):
    windows = [(1, "09:00:00", "10:00:00"), (2, "21:00:00", "23:00:00")]
    times = ["2024-01-25 09:00:00", "2024-01-25 10:00:00", "2024-01-25 21:30:00", "2024-01-26 09:30:00", "2024-01-28 21:30:00", "2024-01-29 09:30:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select("t", F.col("t").cast("timestamp_ntz").alias("at"))
    win = clock.calendar_window(F.col("at"), windows, ("2024-01-29",), {"2024-01-26": "09:15:00"})
    # The evening before a holiday belongs to it; after an early close there is no session.
    assert {r.t: r.w for r in df.select("t", win.alias("w")).collect()} == dict(zip(times, [1, None, 2, None, None, None], strict=True))
