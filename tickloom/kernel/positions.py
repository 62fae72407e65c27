"""Position and cost of a stream of fills."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Position:
    """Weighted mean cost on adding, PnL on closing; a fill through zero opens the rest at its own price.

    Fees are charged on the closing part only: ``fee_lot`` per lot if given, else ``fee`` of the traded value."""

    multiplier: float = 1.0
    fee: float = 0.0
    fee_lot: float | None = None
    qty: int = 0
    cost: float = 0.0
    gross: float = 0.0
    fees: float = 0.0
    opened: int = 0

    def fill(self, px: float, qty: int) -> float:
        """The PnL after fees that the fill realises."""
        if not qty:
            return 0.0
        if self.qty * qty >= 0:  # flat, or adding on the same side
            self.cost = px if self.qty == 0 else (self.qty * self.cost + px * qty) / (self.qty + qty)
            self.qty += qty
            self.opened += abs(qty)
            return 0.0
        side = 1 if self.qty > 0 else -1
        closing = min(abs(self.qty), abs(qty))
        gross = ((px - self.cost) if side > 0 else (self.cost - px)) * closing * self.multiplier
        fees = closing * self.fee_lot if self.fee_lot is not None else closing * px * self.multiplier * self.fee
        self.qty -= side * closing
        self.gross += gross
        self.fees += fees
        rest = abs(qty) - closing
        if rest:
            self.qty, self.cost = -side * rest, px
            self.opened += rest
        return gross - fees
