"""Runners of the state machines over groups: (combination,) contract and day, which the clock bounds.

A group is ordered inside its function; nothing relies on the order in which rows arrive. Combinations and days run
side by side: the parameters of a combination are a column, so a grid is more groups, not a loop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.kernel.depth import DepthBook
from tickloom.kernel.pair import Book, PairReplay, Terms
from tickloom.kernel.policies import Hysteresis, JoinTouch, Policy
from tickloom.kernel.positions import Position
from tickloom.kernel.queue import QueueMarket, Tick
from tickloom.operators import signals



def _sorted(table: pa.Table, *keys: str) -> list[dict]:
    return table.sort_by([(k, "ascending") for k in keys]).to_pylist()


def _pairs(table: pa.Table, name: str) -> list[list[tuple[int, int]]]:
    """A column of arrays of (ticks, quantity) as lists of pairs; null as an empty one."""
    out: list[list[tuple[int, int]]] = []
    for chunk in table.column(name).chunks:
        flat = chunk.flatten()
        pairs = list(zip(flat.field("ticks").to_pylist(), flat.field("quantity").to_pylist(), strict=True))
        at = 0
        for n in pc.fill_null(pc.list_value_length(chunk), 0).to_pylist():
            out.append(pairs[at : at + n])
            at += n
    return out


COSTS = "key string, pos long, cost double, realised double"


def _after_fills(p: Position, fills: list[dict]) -> pa.Table:
    out = []
    for r in fills:
        got = p.fill(r["px"], r["qty"])
        out.append((r["key"], p.qty, p.cost, got))
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table({"key": pa.array(cols[0], pa.string()), "pos": pa.array(cols[1], pa.int64()), "cost": pa.array(cols[2], pa.float64()), "realised": pa.array(cols[3], pa.float64())})


def position_costs(fills: DataFrame, by: tuple[str, ...], order: tuple[str, ...], fee: float = 0.0, fee_lot: float | None = None, multiplier: float = 1.0) -> DataFrame:
    """(key, pos, cost, realised) after every fill (columns ``key``, ``px``, ``qty``) of a group, in order. Fills without price or
    quantity change nothing and are left out."""

    def run(table: pa.Table) -> pa.Table:
        return _after_fills(Position(multiplier, fee, fee_lot), _sorted(table, *order))

    rows = fills.where(F.col("px").isNotNull() & F.col("qty").isNotNull()).select(*dict.fromkeys([*by, *order, "key", "px", "qty"]))
    return rows.groupBy(*by).applyInArrow(run, COSTS)


def carried_costs(fills: DataFrame, key: str, order: tuple[str, ...], fee: float = 0.0, fee_lot: float | None = None, multiplier: float = 1.0) -> DataFrame:
    """As ``position_costs`` by ``key`` and day, but a day begins with the position and mean cost that the day before ended with.

    Given the quantity that it begins with, a day turns the cost that it begins with into a * cost + b (a is 0 once the position was flat or
    turned), so days are read side by side and only these pairs, one per key and day, are gone through in order."""
    rows = fills.where(F.col("px").isNotNull() & F.col("qty").isNotNull()).select(*dict.fromkeys([key, *order, "key", "px", "qty"]))
    rows = signals.carried_sums(rows, key, order[0], order, {"held": F.col("qty")}).withColumn("held_begin", F.coalesce("held_begin", F.lit(0).cast("long"))).drop("held")
    kind = rows.schema[key].dataType.simpleString()

    def change(group: tuple, table: pa.Table) -> pa.Table:
        pos, a, b = table.column("held_begin")[0].as_py(), 1.0, 0.0
        for r in _sorted(table, *order):
            px, q = r["px"], r["qty"]
            if not q:
                continue
            if pos == 0 or (pos * q < 0 and abs(q) > abs(pos)):
                a, b = 0.0, px
            elif pos * q > 0:
                a, b = pos * a / (pos + q), (pos * b + px * q) / (pos + q)
            pos += q
        return pa.table({"_k": pa.array([group[0].as_py()], table.schema.field(key).type), "_d": pa.array([group[1].as_py()], pa.date32()), "_a": pa.array([a], pa.float64()), "_b": pa.array([b], pa.float64())})

    def begin(table: pa.Table) -> pa.Table:
        table, cost, out = table.sort_by("_d"), 0.0, []
        for a, b in zip(table.column("_a").to_pylist(), table.column("_b").to_pylist(), strict=True):
            out.append(cost)
            cost = a * cost + b if a else b
        return table.select(["_k", "_d"]).append_column("_cost", pa.array(out, pa.float64()))

    def run(table: pa.Table) -> pa.Table:
        p = Position(multiplier, fee, fee_lot, qty=table.column("held_begin")[0].as_py(), cost=table.column("_cost")[0].as_py())
        return _after_fills(p, _sorted(table, *order))

    days = rows.groupBy(key, "_day").applyInArrow(change, f"_k {kind}, _d date, _a double, _b double").groupBy("_k").applyInArrow(begin, f"_k {kind}, _d date, _cost double")
    met = rows.join(days, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_day") == F.col("_d"))).drop("_k", "_d")
    return met.groupBy(key, "_day").applyInArrow(run, COSTS)


EXECUTIONS = "order_key string, status string, reason string, filled long, n_levels int, notional_ticks long, touch long"


def execute_orders(orders: DataFrame, by: tuple[str, ...], participation: float = 0.5) -> DataFrame:
    """Executions of orders against the book each one meets (columns order_key, at, side, qty, limit; book, bids, asks: the
    snapshot's row and its levels as arrays of (ticks, quantity), null if there was none). Orders that meet one snapshot share its
    depth in order of time and key; a later snapshot is whole again."""

    def run(table: pa.Table) -> pa.Table:
        books: dict[int, DepthBook] = {}
        out = []
        for r in _sorted(table, "at", "order_key"):
            if r["book"] is None:
                out.append((r["order_key"], "stale", "missing_book", 0, 0, 0, None))
                continue
            if r["book"] not in books:
                books[r["book"]] = DepthBook([(x["ticks"], x["quantity"]) for x in r["bids"]], [(x["ticks"], x["quantity"]) for x in r["asks"]])
            e = books[r["book"]].execute(r["side"], r["limit"], r["qty"], participation)
            out.append((r["order_key"], e.status, e.reason, e.filled, len(e.levels), sum(p * q for p, q in e.levels), e.touch))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("order_key", "status", "reason", "filled", "n_levels", "notional_ticks", "touch"), cols, kinds, strict=True)})

    return orders.groupBy(*by).applyInArrow(run, EXECUTIONS)


FILLS = "combo int, contract string, day date, order_id long, row_id long, side int, px double, qty long, mode string"


def replay(ticks: DataFrame, combos: Sequence[dict], per_task: int = 16, policy: Callable[..., Policy] = JoinTouch) -> DataFrame:
    """Fills of a policy for every combination of its parameters (``combo``, the others by name) on every contract and day.

    ``policy`` makes, from the parameters, a callable of (number of the snapshot, snapshot, market, position, tradable) that places and cancels
    orders in the market; the snapshot has the row's ``signal``, if there is such a column. Each contract and day has a policy of its own.

    ``ticks``: contract, day, exchtime, row_id, bids and asks (arrays of (ticks, quantity)) and traded (the interval's volume by tick);
    ``tradable``, if there: whether the policy may place orders on the snapshot. Others still age and decay what rests.
    A task reads its day once and plays up to ``per_task`` combinations on it; more of them go to further tasks.
    """
    parts = [list(combos[i : i + per_task]) for i in range(0, len(combos), per_task)]

    def run(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("exchtime", "ascending"), ("row_id", "ascending")])
        ids = table.column("row_id").to_pylist()
        usable = table.column("tradable").to_pylist()
        steps = [Tick(*x) for x in zip(_pairs(table, "bids"), _pairs(table, "asks"), _pairs(table, "traded"), table.column("signal").to_pylist(), strict=True)]
        out = []
        for c in parts[group[0].as_py()]:
            decide, market, position = policy(**{k: v for k, v in c.items() if k != "combo"}), QueueMarket(), 0
            for n, (row, tick, may) in enumerate(zip(ids, steps, usable, strict=True)):
                market.step(tick)
                fills = market.match()
                position += sum(f.side * f.qty for f in fills)
                decide(n, tick, market, position, may)
                taken = market.swept()
                position += sum(f.side * f.qty for f in taken)
                out += [(c["combo"], f.order_id, row, f.side, float(f.px), f.qty, f.mode) for f in fills + taken]
        cols = list(zip(*out, strict=True)) or [[]] * 7
        m = len(out)
        return pa.table({
            "combo": pa.array(cols[0], pa.int32()), "contract": pa.array([group[1].as_py()] * m, pa.string()), "day": pa.array([group[2].as_py()] * m, pa.date32()), "order_id": pa.array(cols[1], pa.int64()),
            "row_id": pa.array(cols[2], pa.int64()), "side": pa.array(cols[3], pa.int32()), "px": pa.array(cols[4], pa.float64()), "qty": pa.array(cols[5], pa.int64()), "mode": pa.array(cols[6], pa.string()),
        })

    given = {"tradable": F.lit(True), "signal": F.lit(None).cast("double")}
    ticks = ticks.withColumns({c: v for c, v in given.items() if c not in ticks.columns})
    picked = ticks.select(F.explode(F.array(*[F.lit(i) for i in range(max(1, len(parts)))])).alias("part"), "contract", "day", "exchtime", "row_id", "bids", "asks", "traded", "tradable", "signal")
    return picked.where(F.lit(bool(parts))).groupBy("part", "contract", "day").applyInArrow(run, FILLS)


def hysteresis_trades(series: DataFrame, enter: float, leave: float) -> DataFrame:
    """Round trips of a signal with an entry and an exit band: columns contract, day, exchtime, row_id, x (price) and z in;
    entry and exit rows, side and PnL in ticks out. A trade is made on the row after its signal; the last row closes what is open."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        rows = _sorted(table, "exchtime", "row_id")
        policy, held, entry, out, wanted = Hysteresis(enter, leave), 0, None, [], 0
        for n, r in enumerate(rows):
            aim = 0 if n == len(rows) - 1 else wanted
            if held and aim != held:
                out.append((entry["row_id"], r["row_id"], held, (r["x"] - entry["x"]) * held))
                held, entry = 0, None
            if aim and not held:
                held, entry = aim, r
            wanted = policy.next(r["z"])
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({"contract": pa.array([group[0].as_py()] * len(out), pa.string()), **{n: pa.array(c, pa.int64()) for n, c in zip(("entry_row", "exit_row", "side", "pnl_ticks"), cols, strict=True)}})

    rows = series.select("contract", "day", "exchtime", "row_id", "x", "z")
    return rows.groupBy("contract", "day").applyInArrow(run, "contract string, entry_row long, exit_row long, side long, pnl_ticks long")


LEDGER = "pair_id string, day date, seq int, batch int, leg string, source string, order_key string, delta long, px double, status string, quoted_pos long, hedge_pos long"


def pair_replay(batches: DataFrame, terms: Terms) -> DataFrame:
    """The ledger of the strict replay of every pair and day, one row per effect in order (``seq``), and a last one of source ``end`` with
    the disposition as its status. ``batches``: pair_id, day, exchtime, and per leg (quoted, hedge) row_id, bids, asks and traded, carried forward;
    with ``quoted_multiplier`` and ``hedge_multiplier``, a hedge offsets the quoted leg's risk in these."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        weights = {f"{leg}_weight": next((w for w in table.column(f"{leg}_multiplier").to_pylist() if w), 1.0) for leg in ("quoted", "hedge") if f"{leg}_multiplier" in table.column_names}
        play, last = PairReplay(replace(terms, **weights)), {}
        table = table.sort_by("exchtime")
        legs = {leg: list(zip(table.column(f"{leg}_row_id").to_pylist(), _pairs(table, f"{leg}_bids"), _pairs(table, f"{leg}_asks"), strict=True)) for leg in ("quoted", "hedge")}
        for n, traded in enumerate(_pairs(table, "quoted_traded")):
            fresh = {}
            for leg, rows in legs.items():
                row, bids, asks = rows[n]
                if row is not None and row != last.get(leg):
                    fresh[leg] = Book(row, bids, asks)
                    last[leg] = row
            play.step(fresh.get("quoted"), fresh.get("hedge"), traded if "quoted" in fresh else [])
        end = play.finish()
        rows = [*play.ledger, (play.batch, None, "end", None, 0, None, end, play.position["quoted"], play.position["hedge"])]
        n = len(rows)
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64())
        names = ("batch", "leg", "source", "order_key", "delta", "px", "status", "quoted_pos", "hedge_pos")
        return pa.table({
            "pair_id": pa.array([group[0].as_py()] * n, pa.string()), "day": pa.array([group[1].as_py()] * n, pa.date32()), "seq": pa.array(range(n), pa.int32()),
            **{c: pa.array(v, k) for c, v, k in zip(names, cols, kinds, strict=True)},
        })

    return batches.groupBy("pair_id", "day").applyInArrow(run, LEDGER)
