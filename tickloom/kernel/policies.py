"""Policies that the replay runs: a callable of the snapshot and the market, which it may place and cancel orders in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tickloom.kernel.queue import QueueMarket, Tick


#: What a replay calls after each snapshot: its number, the snapshot, the market, the position, and whether the book can be traded on.
Policy = Callable[[int, Tick, QueueMarket, int, bool], None]


@dataclass
class JoinTouch:
    """Every ``every`` snapshots an order of ``qty`` at the best bid and ask, ``offset`` ticks back; orders older than ``patience``
    snapshots are cancelled; no new ones at ``limit`` messages or on a book that isn't ``tradable``."""

    every: int = 10
    qty: int = 2
    offset: int = 0
    patience: int = 40
    limit: int = 4000

    def __call__(self, n: int, tick: Tick, market: QueueMarket, position: int, tradable: bool = True) -> None:
        for side in (1, -1):
            market.cancel(side, lambda o: True, min_age=self.patience)
        if n % self.every or not tradable or not tick.bids or not tick.asks or market.messages >= self.limit:
            return
        market.place(1, tick.bids[0][0] - self.offset, self.qty)
        market.place(-1, tick.asks[0][0] + self.offset, self.qty)


@dataclass
class TakeSignal:
    """Holds ``qty`` against a signal while it is outside its bands (see ``Hysteresis``): what the position lacks is taken from the touch at
    once, up to the displayed depth's share, and nothing is left to rest."""

    enter: float = 2.0
    leave: float = 0.5
    qty: int = 2
    limit: int = 4000

    def __post_init__(self) -> None:
        self.bands = Hysteresis(self.enter, self.leave)

    def __call__(self, n: int, tick: Tick, market: QueueMarket, position: int, tradable: bool = True) -> None:
        lacks = self.bands.next(tick.signal) * self.qty - position
        side = 1 if lacks > 0 else -1
        if not lacks or not tradable or not market.levels[-side] or market.messages >= self.limit:
            return
        order = market.place(side, market.levels[-side][0][0], abs(lacks), aggressive=True)
        market.execute(order)
        market.cancel(side, lambda o: o is order)


@dataclass
class Hysteresis:
    """Target of a signal: in above ``enter``, out inside ``leave``; the trade is made on the row after the signal, and
    whatever is open is closed on the last row."""

    enter: float
    leave: float
    target: int = 0

    def next(self, signal: float | None) -> int:
        if signal is not None:
            if self.target == 0 and abs(signal) > self.enter:
                self.target = -1 if signal > 0 else 1
            elif self.target and abs(signal) <= self.leave:
                self.target = 0
        return self.target
