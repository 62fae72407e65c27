"""Execution against displayed depth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

Level = tuple[int, int]  # price in ticks, quantity


@dataclass(frozen=True)
class Execution:
    """What became of an order: stale, failed, no_liquidity, rejected, partial or filled."""

    status: str
    reason: str | None
    filled: int
    levels: tuple[Level, ...]
    touch: int | None


class DepthBook:
    """One snapshot of both sides, best level first. An order has floor(quantity x participation) of a level at most, of what the orders
    before have left of it; only a newer snapshot replenishes it."""

    def __init__(self, bids: list[Level], asks: list[Level]):
        self.sides = {"buy": [list(x) for x in asks if x[1] > 0], "sell": [list(x) for x in bids if x[1] > 0]}

    def error(self) -> str | None:
        bids, asks = self.sides["sell"], self.sides["buy"]
        if any(a[0] <= b[0] for a, b in zip(bids, bids[1:], strict=False)):
            return "invalid_bid_order"
        if any(a[0] >= b[0] for a, b in zip(asks, asks[1:], strict=False)):
            return "invalid_ask_order"
        return "crossed_book" if bids and asks and bids[0][0] >= asks[0][0] else None

    def execute(self, side: str, limit: int, qty: int, participation: float, when_empty: str = "no_liquidity") -> Execution:
        bad = self.error()
        if bad:
            return Execution("failed", bad, 0, (), None)
        levels = self.sides[side]
        if not levels:
            return Execution(when_empty, "empty_book", 0, (), None)
        sign = 1 if side == "buy" else -1
        touch = levels[0][0]
        if (limit - touch) * sign < 0:
            return Execution("rejected", "limit_not_marketable", 0, (), touch)
        taken, left = [], qty
        for level in levels:
            px, size = level
            if not left or (limit - px) * sign < 0:
                break
            n = min(left, int(size * participation))
            if n > 0:
                taken.append((px, n))
                left -= n
                level[1] = size - n
        if not taken:
            return Execution(when_empty, "no_executable_depth", 0, (), touch)
        return Execution("partial" if left else "filled", None, qty - left, tuple(taken), touch)


def half_even(x: float) -> int:
    return round(x)


def take_at_touch(limit: int, touch: int, shown: int, qty: int, participation: float = 0.5) -> int:
    """Fill or kill at the touch: up to the rounded share of the displayed quantity, nothing if the price isn't the touch."""
    return min(qty, half_even(shown * participation)) if limit == touch else 0


def sweep_levels(levels: list[list], limit: int, qty: int, sign: int, participation: float, rounding: Callable[[float], int] = half_even) -> list[Level]:
    """Takes from displayed levels (which it lowers) up to the limit; the matching engine's own sweep."""
    out = []
    for level in levels:
        if qty <= 0 or (limit - level[0]) * sign < 0:
            break
        n = min(qty, max(0, rounding(level[1] * participation)))
        if n:
            out.append((level[0], n))
            level[1] = max(0, level[1] - n)
            qty -= n
    return out
