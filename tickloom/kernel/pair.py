"""Strict replay of a pair: makers on the quoted leg, hedges on the other, both against books as they became known.

Per sealed batch, in this order: orders that were decided earlier arrive; the quoted leg's interval volume is matched with the
makers that had arrived before this batch; fills go to the ledger; hedges are executed against the hedge leg's book; then one decision. An order
that is decided in a batch can't match in it. A leg without a row of its own in a batch keeps its book and the depth that is left
of it. At the end makers are cancelled and both positions closed through depth; what depth doesn't give stays open.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tickloom.kernel.depth import DepthBook
from tickloom.kernel.lifecycle import Lifecycle
from tickloom.kernel.passive import Maker, PassiveMatcher


@dataclass
class Terms:
    """``quoted_weight``, ``hedge_weight``: risk per lot; ``qty``: lots of a maker; ``patience``: batches until it is cancelled; ``participation``
    in displayed depth; ``capacity``: most lots reserved at once; ``through``: ticks that a hedge's limit goes through the touch."""

    quoted_weight: float = 1.0
    hedge_weight: float = 1.0
    qty: int = 2
    patience: int = 30
    participation: float = 0.5
    capacity: int = 20
    through: int = 2


@dataclass
class Book:
    row: int
    bids: list
    asks: list
    depth: DepthBook = field(init=False)

    def __post_init__(self) -> None:
        self.depth = DepthBook(self.bids, self.asks)


class PairReplay:
    def __init__(self, terms: Terms):
        self.t, self.life, self.matcher = terms, Lifecycle(terms.capacity), PassiveMatcher()
        self.books: dict[str, Book] = {}
        self.position = {"quoted": 0, "hedge": 0}
        self.waiting: list[Maker] = []
        self.born: dict[str, int] = {}
        self.ledger: list[tuple] = []  # batch, leg, source, key, delta, price in ticks, status
        self.batch = 0

    def _post(self, leg: str, source: str, key: str, delta: int, px: float, status: str) -> None:
        self.position[leg] += delta
        self.ledger.append((self.batch, leg, source, key, delta, px, status, self.position["quoted"], self.position["hedge"]))

    def step(self, quoted: Book | None, hedge: Book | None, buckets: list[tuple[int, int]]) -> None:
        self.batch += 1
        for leg, book in (("quoted", quoted), ("hedge", hedge)):
            if book is not None and (leg not in self.books or book.row != self.books[leg].row):
                self.books[leg] = book
        if quoted is not None and buckets:
            sides = {m.order_id: m for m in self.matcher.makers}
            for key, n in self.matcher.interval(self.batch, buckets):
                m = sides[key]
                self.life.move(key, "partially_filled", self.batch, n)
                self._post("quoted", "maker", key, m.side * n, m.px, self.life.intents[key].state)
        for m in self.waiting:  # decided in an earlier batch: in the queue from now on
            self.life.move(m.order_id, "arrived", self.batch)
            m.ahead = self._queue_at(m)
            self.matcher.register(m)
        self.waiting = []
        self._hedge("hedge")
        self._expire()
        if len(self.books) == 2:
            self._decide()

    def _queue_at(self, m: Maker) -> int:
        """What stands at a maker's price when it arrives: displayed quantity and the own orders there."""
        book = self.books["quoted"]
        shown = sum(q for p, q in (book.bids if m.side > 0 else book.asks) if p == m.px)
        return int(shown) + sum(o.left for o in self.matcher.makers if o.side == m.side and o.px == m.px)

    def _hedge(self, source: str) -> None:
        wanted = -self.position["quoted"] * self.t.quoted_weight / self.t.hedge_weight
        size = int(wanted) - self.position["hedge"]
        if size and "hedge" in self.books:
            self._take("hedge", source, size)

    def _take(self, leg: str, source: str, size: int) -> None:
        book = self.books[leg]
        side = "buy" if size > 0 else "sell"
        levels = book.depth.sides[side]
        limit = levels[0][0] + (self.t.through if size > 0 else -self.t.through) if levels else 0
        e = book.depth.execute(side, limit, abs(size), self.t.participation)
        if e.filled:
            self._post(leg, source, f"{source}-{self.batch}-{leg}", e.filled if size > 0 else -e.filled, sum(p * q for p, q in e.levels) / e.filled, e.status)

    def _expire(self) -> None:
        for m in [m for m in self.matcher.makers if self.batch - self.born[m.order_id] >= self.t.patience or not m.left]:
            if self.life.intents[m.order_id].state != "filled":
                self.life.move(m.order_id, "cancelled", self.batch)
            self.matcher.makers.remove(m)

    def _decide(self) -> None:
        if self.matcher.makers or self.waiting or self.books["quoted"].depth.error():
            return
        q = self.books["quoted"]
        for side, levels in ((1, q.bids), (-1, q.asks)):
            if not levels:
                continue
            key = f"maker-{self.batch}-{side}"
            if self.life.submit(key, self.t.qty, self.batch):
                self.waiting.append(Maker(key, side, levels[0][0], self.t.qty, 0, (self.batch, side)))
                self.born[key] = self.batch

    def finish(self) -> str:
        """Cancels makers and closes both legs; ``flat`` or ``incomplete_liquidity``."""
        self.batch += 1
        for m in [*self.matcher.makers, *self.waiting]:
            if self.life.intents[m.order_id].state not in ("filled", "cancelled"):
                self.life.move(m.order_id, "cancelled", self.batch)
        self.matcher.makers, self.waiting = [], []
        for leg in ("quoted", "hedge"):
            if self.position[leg] and leg in self.books:
                self._take(leg, "eod", -self.position[leg])
        return "flat" if not any(self.position.values()) else "incomplete_liquidity"
