"""Ordered row checks with dispositions, and the sealing of event-time batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ticks import LEVELS


def first_failing(checks: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first check that fails (is true), null if none does."""
    return F.coalesce(*[F.when(bad, F.lit(code)) for code, bad in checks])


def book_checks(count: int = LEVELS) -> list[tuple[str, Column]]:
    """Codes of a malformed book over its active levels (those with quantity)."""
    any_of = lambda cs: reduce(lambda a, b: a | b, cs)
    every = [F.col(f"{s}{w}{i}") for s in ("bid", "ask") for w in ("px", "vol") for i in range(count)]
    volumes = [F.col(f"{s}vol{i}") for s in ("bid", "ask") for i in range(count)]

    def unordered(side: str, sign: int) -> Column:
        prices = F.transform(F.filter(F.array(*[F.struct(F.col(f"{side}px{i}").alias("p"), F.col(f"{side}vol{i}").alias("q")) for i in range(count)]), lambda x: x["q"] > 0), lambda x: x["p"])
        n = F.size(prices)
        steps = F.zip_with(F.slice(prices, 2, F.greatest(n, F.lit(1))), F.slice(prices, 1, F.greatest(n - 1, F.lit(1))), lambda a, b: (a - b) * sign)
        return (n > 1) & F.exists(F.slice(steps, 1, F.greatest(n - 1, F.lit(1))), lambda d: d <= 0)

    return [
        ("missing_book_field", any_of([c.isNull() for c in every])), ("negative_depth", any_of([v < 0 for v in volumes])), ("zero_top_depth", (F.col("bidvol0") <= 0) | (F.col("askvol0") <= 0)),
        ("invalid_bid_order", unordered("bid", -1)), ("invalid_ask_order", unordered("ask", 1)), ("crossed_book", F.col("bidpx0") >= F.col("askpx0")),
    ]


def row_checks(universe: Column) -> list[tuple[str, Column]]:
    """Checks of a snapshot row in their order; ``universe`` is true for declared contracts."""
    return [
        ("undeclared_contract", ~F.coalesce(universe, F.lit(False))), ("invalid_timestamp", F.col("exchtime").isNull() | F.col("timestamp").isNull()),
        ("receive_before_exchange", F.col("timestamp") < F.col("exchtime")), ("invalid_source_sequence", F.col("row_id").isNull() | (F.col("row_id") < 0)), *book_checks(),
    ]


def _fold(columns: list[str], order: list[str]):
    def run(table: pa.Table) -> pa.Table:
        keys = [table.column(c).cast(pa.int64()).to_numpy() if pa.types.is_timestamp(table.column(c).type) else table.column(c).to_numpy() for c in order]
        idx = np.lexsort(keys[::-1])
        values = [table.column(c).to_numpy(zero_copy_only=False)[idx].astype(float) for c in columns]
        bars = [-np.inf] * len(columns)
        ok = np.zeros(len(idx), dtype=bool)
        for i in range(len(idx)):
            row = [v[i] for v in values]
            if all(x >= 0 and x >= b for x, b in zip(row, bars, strict=True)):
                ok[i], bars = True, row
        ids = table.column("row_id").to_numpy()[idx]
        return pa.table({"row_id": pa.array(ids, pa.int64()), "accepted": pa.array(ok)})

    return run


def monotone_totals(df: DataFrame, columns: tuple[str, ...] = ("totalvol", "totalvalue"), by: tuple[str, ...] = ("contract", "day"), order: tuple[str, ...] = ("exchtime", "row_id")) -> DataFrame:
    """(row_id, accepted): each row against the last accepted one; a row is refused if some total is negative, null or below.

    With several totals no window says this (a refused row must not raise another total's bar), so each contract and
    day, which the clock bounds, is folded in order."""
    return df.select(*by, "row_id", *[c for c in order if c != "row_id"], *columns).groupBy(*by).applyInArrow(_fold(list(columns), list(order)), "row_id long, accepted boolean")


def sealed_batches(df: DataFrame, batch: tuple[str, ...], time: str, product: str, members: int) -> DataFrame:
    """One row per batch: its time span, distinct products, repeated products and completeness (fail-closed: incomplete ones are marked, not passed on)."""
    out = df.groupBy(*batch).agg(
        F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count("*").alias("n_rows"), F.countDistinct(product).alias("n_products"),
    )
    return out.withColumns({"has_repeats": F.col("n_rows") > F.col("n_products"), "complete": F.col("n_products") == members})


def row_hash(*columns: str) -> Column:
    """Digest of a row's fields; equal within this engine."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns)), 256))


TRADE = "array<struct<taker_side:string,price:long,quantity:long,trade_id:string>>"


def normalised_trades(text: Column) -> Column:
    """(trades, issue) of a JSON list of prints {taker_side, price, quantity, trade_id?}: ``not_a_list`` if it can't be read, ``invalid_trade`` if a side is
    neither buy nor sell or a price or quantity is null or not positive, ``repeated_trade`` if an id is there twice. Null is an empty list."""
    trades = F.from_json(F.coalesce(text, F.lit("[]")), TRADE)
    bad = F.exists(trades, lambda t: ~F.coalesce(t["taker_side"].isin("buy", "sell") & (t["price"] > 0) & (t["quantity"] > 0), F.lit(False)))
    ids = F.filter(F.transform(trades, lambda t: t["trade_id"]), lambda i: i.isNotNull())
    issue = F.when(trades.isNull(), "not_a_list").when(bad, "invalid_trade").when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_trade")
    return F.struct(trades.alias("trades"), issue.alias("issue"))


def stretched_levels(levels: Column, twice_mid: Column, up: bool, fifths: int = 5) -> Column:
    """Prices of a side (an array of whole ticks) moved away from the mid by ``fifths`` quarters of their distance, to the next tick outwards."""
    moved = lambda p: (4 * twice_mid + fifths * (2 * p - twice_mid)) / 8
    return F.transform(levels, lambda p: (F.ceil(moved(p)) if up else F.floor(moved(p))).cast("long"))


def book_issue(bids: Column, asks: Column) -> Column:
    """The first of not_positive, bid_order, ask_order, crossed that holds for a book in ticks, best level first; else null."""
    rising = lambda levels, sign: F.exists(F.zip_with(F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: (a - b) * sign <= 0), lambda x: x)
    return (
        F.when(F.exists(F.concat(bids, asks), lambda p: p <= 0), "not_positive").when(rising(bids, -1), "bid_order").when(rising(asks, 1), "ask_order")
        .when((F.size(bids) > 0) & (F.size(asks) > 0) & (F.try_element_at(bids, F.lit(1)) >= F.try_element_at(asks, F.lit(1))), "crossed")
    )
