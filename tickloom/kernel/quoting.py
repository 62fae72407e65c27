"""Moves of a quoting policy on a queue market."""

from __future__ import annotations

from tickloom.kernel.positions import Position
from tickloom.kernel.queue import Fill, QueueMarket


def requote(market: QueueMarket, side: int, prices: list[int], min_age: int = 0) -> int:
    """Moves the quantity at prices off the list onto it: orders there are cancelled (if old enough) and what they had is spread over
    the list from its first price on, in shares of the whole rounded away from zero. Returns the quantity moved."""
    wanted, moved = set(prices), 0
    for px in [p for p in market.books[side] if p not in wanted]:
        at_level = {o.order_id: o.qty for o in market.books[side][px] if o.age >= min_age}
        market.cancel(side, lambda o, ids=at_level: o.order_id in ids, min_age)
        moved += sum(at_level.values())
    left, share = moved, -(-moved // len(prices)) if prices else 0
    for px in prices:
        n = min(share, left)
        if n > 0:
            market.place(side, px, n)
            left -= n
    return moved


def unwind(market: QueueMarket, fill: Fill, offset: int = 1) -> None:
    """An opposite order ``offset`` ticks away from a fill, unless one rests there already."""
    px = int(fill.px) + fill.side * offset
    if px not in market.books[-fill.side]:
        market.place(-fill.side, px, fill.qty)


def hedge(market: QueueMarket, size: int, offset: int = 0) -> Fill | None:
    """An aggressive order through the touch, swept at once; nothing without a touch."""
    side = 1 if size > 0 else -1
    if not size or not market.levels[-side]:
        return None
    return market.execute(market.place(side, market.levels[-side][0][0] + side * offset, abs(size), aggressive=True))


def flatten(market: QueueMarket, position: Position) -> float:
    """Cancels everything and closes the position at the touch, whatever its depth (a forced close); the PnL it realises."""
    for side in (1, -1):
        market.cancel(side, lambda o: True)
    side = 1 if position.qty > 0 else -1
    if not position.qty or not market.levels[side]:
        return 0.0
    return position.fill(market.levels[side][0][0], -position.qty)
