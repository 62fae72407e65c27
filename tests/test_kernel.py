import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.kernel.depth import DepthBook, take_at_touch
from tickloom.kernel.lifecycle import Lifecycle
from tickloom.kernel.pair import Book, PairReplay, Terms
from tickloom.kernel.passive import Maker, PassiveMatcher
from tickloom.kernel.policies import Hysteresis, TakeSignal
from tickloom.kernel.positions import Position
from tickloom.kernel.queue import Fill, QueueMarket, Tick
from tickloom.kernel.quoting import flatten, hedge, requote, unwind
from tickloom.kernel.spark import hysteresis_trades, position_costs, replay
from tickloom.plans.replay import ledger_checks


def test_position():
    p = Position(multiplier=10, fee=0.001)
    assert p.fill(100, 2) == 0 and p.fill(110, 2) == 0 and (p.qty, p.cost) == (4, 105)
    got = p.fill(120, -6)
    assert p.qty == -2 and p.cost == 120 and p.gross == 15 * 4 * 10 and got == 600 - 4 * 120 * 10 * 0.001 and p.opened == 6
    assert Position(fee_lot=2.0).fill(5, 0) == 0
    q = Position(fee_lot=2.0)
    q.fill(5, -3)
    assert q.fill(4, 3) == 3 - 6 and q.qty == 0


@given(st.lists(st.tuples(st.integers(1, 50), st.integers(-5, 5)), max_size=60))
def test_position_conserves_value(fills):
    p = Position()
    cash = 0.0
    for px, q in fills:
        p.fill(px, q)
        cash -= px * q
    assert p.qty == sum(q for _, q in fills)
    mark = fills[-1][0] if fills else 0
    assert abs(cash + p.qty * mark - (p.gross + (mark - p.cost) * p.qty)) < 1e-6


def test_depth_is_consumed_once():
    book = DepthBook([], [(77985, 10), (77990, 10)])
    assert book.execute("buy", 77990, 4, 0.5).levels == ((77985, 4),)
    second = book.execute("buy", 77990, 4, 0.5)  # half of the six that are left, and one of the next level
    assert second.levels == ((77985, 3), (77990, 1)) and second.status == "filled"
    third = book.execute("buy", 77990, 9, 0.5)
    assert third.levels == ((77985, 1), (77990, 4)) and third.status == "partial"
    whole = DepthBook([], [(10, 4)])
    assert whole.execute("buy", 10, 4, 1.0).status == "filled" and whole.execute("buy", 10, 1, 1.0).reason == "no_executable_depth"
    assert book.execute("buy", 77000, 1, 0.5).status == "rejected" and book.execute("sell", 1, 1, 0.5).reason == "empty_book"
    assert DepthBook([(5, 1)], [(5, 1)]).execute("buy", 9, 1, 1).status == "failed"
    assert take_at_touch(5, 5, 5, 9) == 2 and take_at_touch(6, 5, 5, 9) == 0


def market(bid=100, vol=50):
    m = QueueMarket()
    m.step(Tick([(bid, vol), (bid - 1, 7)], [(bid + 1, vol), (bid + 2, 7)]))
    return m


def test_queue():
    m = market()
    a, b = m.place(1, 100, 1), m.place(1, 100, 1)
    assert (a.queue, b.queue) == (51, 52)
    assert m.match() == []
    m.step(Tick([(100, 50)], [(101, 50)], [(100, 51)]))
    assert [(f.order_id, f.qty) for f in m.match()] == [(a.order_id, 1)]
    m.step(Tick([(100, 50)], [(101, 50)], [(100, 5)]))
    assert [(f.order_id, f.mode) for f in m.match()] == [(b.order_id, "passive_queue")]


def test_ladder_shares_the_volume():
    m = market(vol=0)
    m.levels = {1: [], -1: []}
    hi, lo = m.place(1, 100, 5), m.place(1, 99, 5)
    m.step(Tick([], [], [(99, 6)]))
    assert {f.order_id: f.qty for f in m.match()} == {hi.order_id: 5, lo.order_id: 1}


def test_crossing_and_sweep():
    m = market()
    o = m.place(1, 101, 30, aggressive=True)
    f = m.execute(o)
    assert f.qty == 25 and f.px == 101 and o.qty == 5 and not o.aggressive
    m.step(Tick([(99, 1)], [(100, 4), (101, 100)]))
    f = m.match()[0]
    assert f.mode == "crossing_limit" and f.qty == 5 and f.px == (2 * 100 + 3 * 101) / 5
    assert m.books == {1: {}, -1: {}}


def test_cancel_repairs_queues():
    m = market()
    a, b = m.place(1, 100, 4), m.place(1, 100, 1)
    assert m.cancel(1, lambda o: o is a, min_age=1) == 0
    m.step(Tick([(100, 50)], []))
    assert m.cancel(1, lambda o: o is a, min_age=1) == 1 and b.queue == 51 and m.messages == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(98, 103), st.integers(0, 30), st.booleans()), max_size=40))
def test_passive_fills_never_exceed_traded_volume(steps):
    m, rng = QueueMarket(), random.Random(1)
    for px, vol, place in steps:
        m.step(Tick([(97, 5)], [(104, 5)], [(px, vol)]))
        fills = m.match()
        assert sum(f.qty for f in fills if f.side == 1) <= vol and sum(f.qty for f in fills if f.side == -1) <= vol
        if place:
            m.place(rng.choice((1, -1)), rng.randrange(98, 104), rng.randrange(1, 9))
        for side in (1, -1):
            for orders in m.books[side].values():
                assert all(a.born <= b.born for a, b in zip(orders, orders[1:], strict=False))


def test_passive_matcher():
    p = PassiveMatcher()
    for k, px, ahead in (("a", 100, 3), ("b", 100, 5), ("c", 99, 0)):
        p.register(Maker(k, 1, px, 2, ahead, (0, k)))
    assert p.trade("t1", -1, 100, 4) == [("a", 1)]
    assert p.trade("t2", -1, 99, 4) == [("a", 1), ("b", 2), ("c", 1)]
    with pytest.raises(ValueError):
        p.trade("t2", -1, 99, 1)
    q = PassiveMatcher()
    q.register(Maker("bid", 1, 100, 2, 0, (0,)))
    q.register(Maker("ask", -1, 100, 2, 0, (0,)))
    assert q.interval("i", [(100, 3)]) == [("bid", 2), ("ask", 1)]


def test_lifecycle():
    life = Lifecycle(10)
    assert life.submit("a", 6, 0) and not life.submit("b", 5, 0)
    life.move("a", "arrived", 1)
    life.move("a", "partially_filled", 2, 2)
    assert life.reserved == 4 and life.submit("c", 6, 2)
    with pytest.raises(ValueError):
        life.move("a", "arrived", 3)
    with pytest.raises(ValueError):
        life.move("a", "filled", 3, 9)
    with pytest.raises(ValueError):
        life.move("a", "filled", 1, 4)
    life.move("a", "partially_filled", 3, 4)
    assert life.intents["a"].state == "filled" and life.reserved == 6


def test_hysteresis():
    h = Hysteresis(2, 0.5)
    assert [h.next(z) for z in (None, 1, 3, 1, -3, 0.4, -2.5)] == [0, 0, -1, -1, -1, 0, 1]


def test_quoting():
    m = market()
    a, b = m.place(1, 100, 3), m.place(1, 98, 4)
    assert requote(m, 1, [99, 97]) == 7 and {p: sum(o.qty for o in v) for p, v in m.books[1].items()} == {99: 4, 97: 3}
    assert requote(m, 1, [99, 97]) == 0 and requote(m, -1, []) == 0
    unwind(m, Fill(9, 1, 100, 2, "passive_queue", 0))
    unwind(m, Fill(9, 1, 100, 2, "passive_queue", 0))
    assert [o.qty for o in m.books[-1][101]] == [2]
    f = hedge(m, -30, 1)
    assert f.px == (25 * 100 + 4 * 99) / 29 and f.qty == 29 and hedge(m, 0) is None
    p = Position()
    p.fill(90, 2)
    assert flatten(m, p) == 20 and p.qty == 0 and m.books == {1: {}, -1: {}}
    del a, b


def test_pair_replay():
    book = lambda row, px: Book(row, [(px, 4), (px - 1, 9)], [(px + 1, 4), (px + 2, 9)])
    r = PairReplay(Terms(qty=2, patience=50))
    r.step(book(1, 100), book(2, 50), [])  # decides; nothing can match yet
    r.step(book(3, 100), None, [(100, 99)])  # arrives after this interval
    assert r.ledger == []
    r.step(book(4, 100), None, [(100, 6)])  # 4 ahead, then 2 of ours; the hedge follows
    assert [(x[1], x[2], x[4], x[5]) for x in r.ledger] == [("quoted", "maker", 2, 100), ("hedge", "hedge", -2, 50)]
    r.step(book(5, 100), None, [(101, 6)])
    assert r.position == {"quoted": 0, "hedge": 0} and r.ledger[-1][5] == 51
    assert r.finish() == "flat" and r.life.reserved == 0
    s = PairReplay(Terms(qty=9, capacity=8))
    s.step(book(1, 100), book(2, 50), [])
    assert not s.waiting and s.finish() == "flat"  # over the capacity
    t = PairReplay(Terms(qty=6))
    for n in range(2):
        t.step(book(n, 100), book(n, 50), [])
    t.step(book(9, 100), None, [(100, 10)])
    assert t.position == {"quoted": 6, "hedge": -6} and t.ledger[-1][5] == (50 * 2 + 49 * 4) / 6
    t.step(None, None, [])  # carried books don't replenish
    assert t.finish() == "flat"


def test_groups(spark):
    t = dt.datetime(2024, 1, 25, 9)
    fills = [(f"f{i}", "A" if i % 2 else None, t + dt.timedelta(seconds=i // 3), float(100 + i), (-1) ** i * (i % 4)) for i in range(30)] + [("n", "A", t, None, 1)]
    df = spark.createDataFrame(fills, "key string, product string, at timestamp_ntz, px double, qty long")
    one = sorted(map(tuple, position_costs(df, ("product",), ("at", "key")).collect()))
    assert len(one) == 30 and one == sorted(map(tuple, position_costs(df.repartition(7), ("product",), ("at", "key")).collect()))
    lv = lambda p, q: [{"ticks": p, "quantity": q}]
    ticks = spark.createDataFrame(
        [("A", t.date(), t + dt.timedelta(seconds=i), i, lv(100, 2), lv(101, 2), lv(100 + i % 2, 9)) for i in range(40)],
        "contract string, day date, exchtime timestamp_ntz, row_id long, bids array<struct<ticks:long,quantity:long>>, asks array<struct<ticks:long,quantity:long>>, traded array<struct<ticks:long,quantity:long>>",
    )
    combos = [{"combo": n, "every": 10, "qty": 2, "offset": o, "patience": 40, "limit": m} for n, o, m in ((1, 0, 4000), (2, 0, 2), (3, 50, 4000))]
    assert replay(ticks, []).count() == 0
    assert sorted(map(tuple, replay(ticks, combos, per_task=1).collect())) == sorted(map(tuple, replay(ticks.repartition(5), combos).collect()))
    got = replay(ticks, combos).collect()
    assert {c: sum(r.qty for r in got if r.combo == c) for c in (1, 2, 3)} == {1: 16, 2: 4, 3: 0}
    zs = [0, 3, 3, 0, 0, -3, -3]
    rows = spark.createDataFrame([("A", t.date(), t + dt.timedelta(seconds=i), i, 100 + i, float(z)) for i, z in enumerate(zs)], "contract string, day date, exchtime timestamp_ntz, row_id long, x long, z double")
    assert sorted(map(tuple, hysteresis_trades(rows, 2, 0.5).collect())) == [("A", 2, 4, -1, -2)]


def test_a_policy_of_ones_own(spark):
    """Any callable can be replayed: one that takes the touch on a signal, and one that only watches."""
    T0 = dt.datetime(2024, 1, 25, 9)
    rows = [("A", T0.date(), T0 + dt.timedelta(seconds=i), i, [(100, 10)], [(101, 10)], [], s) for i, s in enumerate([None, -3.0, -3.0, 0.1, 0.0])]
    schema = "contract string, day date, exchtime timestamp_ntz, row_id long, bids array<struct<ticks:long,quantity:long>>, asks array<struct<ticks:long,quantity:long>>, traded array<struct<ticks:long,quantity:double>>, signal double"
    df = spark.createDataFrame(rows, schema)
    out = replay(df, [{"combo": 0, "enter": 2.0, "leave": 0.5, "qty": 3}], policy=TakeSignal)
    assert [(r.row_id, r.side, r.px, r.qty, r["mode"]) for r in out.collect()] == [(1, 1, 101.0, 3, "sweep"), (3, -1, 100.0, 3, "sweep")]

    def watcher(every):
        return lambda n, tick, market, position, tradable: market.place(1, 100, every) if n == 0 else None

    assert replay(df, [{"combo": 7, "every": 2}], policy=watcher).count() == 0


def test_ledger_checks_find_what_is_wrong(spark):
    day = dt.date(2024, 1, 25)
    good = [("maker", "quoted", 2, "filled", 2, 0), ("hedge", "hedge", -2, "filled", 2, -2), ("eod", "quoted", -2, "filled", 0, -2), ("eod", "hedge", 2, "filled", 0, 0), ("end", None, 0, "flat", 0, 0)]
    ledgers = {"good": good, "sum": [*good[:1], ("hedge", "hedge", -2, "filled", 2, -1), *good[2:]], "open": good[:4], "not_flat": [*good[:3], ("end", None, 0, "flat", 0, -2)], "strange": [("maker", "hedge", 2, "filled", 0, 2), ("end", None, 0, "incomplete_liquidity", 0, 2)]}
    rows = [(name, day, i, leg, source, delta, status, q, h) for name, led in ledgers.items() for i, (source, leg, delta, status, q, h) in enumerate(led)]
    df = spark.createDataFrame(rows, "pair_id string, day date, seq int, leg string, source string, delta long, status string, quoted_pos long, hedge_pos long")
    got = {(r.code, r.related_id.split(":")[0]) for r in ledger_checks(df).collect()}
    assert got == {("running_position", "sum"), ("one_end", "open"), ("flat_is_flat", "not_flat"), ("source", "strange")}
