"""Order life cycle and capacity."""

from __future__ import annotations

from dataclasses import dataclass, field

OPEN = ("submitted", "arrived", "partially_filled")
FINAL = ("filled", "cancelled", "expired", "rejected", "stale", "no_liquidity", "failed")
NEXT = {"submitted": {"arrived", "rejected", "stale", "cancelled", "failed"}, "arrived": {"partially_filled", *FINAL}, "partially_filled": {"partially_filled", "filled", "cancelled", "expired", "stale"}}


@dataclass
class Intent:
    qty: int
    state: str = "submitted"
    filled: int = 0
    reserved: int = 0
    at: object = None


@dataclass
class Lifecycle:
    """Intents against a limit of reserved quantity; every change is an event (intent, state, filled, reserved in all)."""

    capacity: int
    intents: dict[str, Intent] = field(default_factory=dict)
    events: list[tuple] = field(default_factory=list)

    @property
    def reserved(self) -> int:
        return sum(i.reserved for i in self.intents.values())

    def submit(self, key: str, qty: int, at) -> bool:
        """Reserves the quantity; over the capacity the intent is rejected."""
        if key in self.intents:
            raise ValueError("the intent is there already")
        fits = self.reserved + qty <= self.capacity
        self.intents[key] = Intent(qty, "submitted" if fits else "rejected", 0, qty if fits else 0, at)
        self._note(key)
        return fits

    def move(self, key: str, state: str, at, fill: int = 0) -> None:
        """A transition in time order; fills release their part, a final state the rest."""
        i = self.intents[key]
        if i.state not in NEXT or state not in NEXT[i.state]:
            raise ValueError(f"no way from {i.state} to {state}")
        if i.at is not None and at < i.at:
            raise ValueError("time runs backwards")
        if fill < 0 or i.filled + fill > i.qty:
            raise ValueError("more is filled than was asked for")
        i.filled += fill
        if state == "partially_filled" and i.filled == i.qty:
            state = "filled"
        if state == "filled" and i.filled != i.qty:
            raise ValueError("not all is filled")
        i.state, i.at = state, at
        i.reserved = 0 if state in FINAL else i.qty - i.filled
        self._note(key)

    def _note(self, key: str) -> None:
        i = self.intents[key]
        self.events.append((key, i.state, i.filled, self.reserved))
