"""Run configuration, grids and output layout: small things that live on the driver."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Mapping, Sequence
from datetime import datetime

REQUIRED = ("contracts", "tick", "multiplier", "dates")
FEES = ("fee", "fee_lot")
DIAGNOSTICS = ("reconcile", "route", "direction", "monthly", "time_of_day", "microstructure", "order_limit", "regime")


def problems(config: Mapping) -> list[str]:
    """What is wrong with a configuration; nothing is raised."""
    out = [f"missing: {k}" for k in REQUIRED if config.get(k) is None]
    if not any(config.get(k) is not None for k in FEES):
        out.append(f"one of {' or '.join(FEES)} is needed")
    out += [f"not positive: {k}" for k in ("tick", "multiplier") if config.get(k) is not None and not config[k] > 0]
    contracts = config.get("contracts")
    if contracts is not None and len(set(contracts)) != len(contracts):
        out.append("repeated contracts")
    return out


def diagnostics(wanted: str | Sequence[str] | None) -> list[str]:
    """``all``, or the known ones of a list, in their order; unknown ones are dropped."""
    if wanted is None:
        return []
    if wanted == "all":
        return list(DIAGNOSTICS)
    return [d for d in DIAGNOSTICS if d in set([wanted] if isinstance(wanted, str) else wanted)]


def schedule_problems(universe: Sequence[str], schedule: Mapping[str, Sequence[str]]) -> list[str]:
    """A universe has two contracts or more, each once; every date has two different ones of them."""
    out = [] if len(universe) >= 2 and len(set(universe)) == len(universe) else ["the universe needs two contracts or more, each once"]
    return out + [f"{d}: needs two different contracts of the universe" for d, pair in sorted(schedule.items()) if len(pair) != 2 or len(set(pair)) != 2 or not set(pair) <= set(universe)]


def normalised_grid(grid: Mapping) -> dict[str, list]:
    """Scalars as lists of one."""
    return {k: list(v) if isinstance(v, (list, tuple, range, set)) else [v] for k, v in grid.items()}


def combinations(grid: Mapping) -> list[dict]:
    """Every combination of a grid, numbered: rows of the small table that a replay runs over."""
    g = normalised_grid(grid)
    return [{"combo": n, **dict(zip(g, values, strict=True))} for n, values in enumerate(itertools.product(*g.values()))]


def session_tag(start: datetime) -> str:
    """day (9 to 15), night (from 21, and before 3) or other."""
    return "day" if 9 <= start.hour < 15 else "night" if start.hour >= 21 or start.hour < 3 else "other"


def underlying(contract: str) -> str:
    """The leading letters of a contract's name, in upper case."""
    m = re.match(r"[A-Za-z]+", contract)
    return m.group().upper() if m else "UNKNOWN"


def layout(root: str, contract: str, start: datetime, kind: str) -> str:
    """Folder of an artifact by underlying, date and session; as a table, the same names are partition columns."""
    return f"{root}/{kind}/underlying={underlying(contract)}/date={start:%Y-%m-%d}/session={session_tag(start)}"


def run_manifest(config: Mapping, best: Mapping | None = None) -> str:
    """Canonical JSON of a run's configuration and best combination; what JSON doesn't know is written as text."""
    return json.dumps({"config": config, "best": best}, sort_keys=True, default=str, separators=(",", ":"))
