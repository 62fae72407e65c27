"""Trading days, sessions and windows as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def second_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def trading_day(t: Column, rollover_s: int = 64_800) -> Column:
    """The calendar day, or the next one from the rollover on; weekends and holidays are not skipped."""
    return F.when(second_of_day(t) >= rollover_s, F.date_add(F.to_date(t), 1)).otherwise(F.to_date(t))


def shifted_day(t: Column, hours: int = 6) -> Column:
    """The other definition: the day of the time plus some hours."""
    return F.to_date(t + F.expr(f"INTERVAL {int(hours)} HOURS"))


def session_class(t: Column) -> Column:
    """day (9 to 15, the end outside), night (from 21, and before 3) or other."""
    h = F.hour(t)
    return F.when((h >= 9) & (h < 15), "day").when((h >= 21) | (h < 3), "night").otherwise("other")


def within(t: Column, start_s: int, end_s: int) -> Column:
    """Time of day in a window whose both ends belong to it; one that ends before it starts crosses midnight.

    Fractions of a second count: past the end's full second is outside."""
    s = second_of_day(t) + F.date_format(t, "SSSSSS").cast("int") / 1e6
    return (s >= start_s) & (s <= end_s) if start_s <= end_s else (s >= start_s) | (s <= end_s)


def end_of_day(t: Column, eod: str = "15:00:00", early: dict[str, str] | None = None, rollover_s: int = 64_800) -> Column:
    """The closing instant of the time's trading day; days of ``early`` (yyyy-MM-dd) close earlier."""
    day = trading_day(t, rollover_s)
    clock = F.lit(eod)
    for d, c in sorted((early or {}).items()):
        clock = F.when(day == F.lit(d).cast("date"), F.lit(c)).otherwise(clock)
    return F.concat_ws(" ", day.cast("string"), clock).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds, as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def calendar_window(t: Column, windows: list[tuple[int, str, str]], holidays: tuple[str, ...] = (), early: dict[str, str] | None = None, eod: str = "15:00:00") -> Column:
    """The first window (order, opens_at, closes_at) that holds the time (its close is outside); null on a holiday and after the close of
    the time's trading day."""
    at, win = second_of_day(t), F.lit(None).cast("int")
    for order, opens, closes in sorted(windows, reverse=True):
        o, c = (sum(int(x) * k for x, k in zip(w.split(":"), (3600, 60, 1), strict=True)) for w in (opens, closes))
        win = F.when((at >= o) & (at < c), F.lit(order)).otherwise(win)
    day = trading_day(t)
    off = F.lit(False)
    for h in holidays:
        off = off | (day == F.lit(h).cast("date"))
    return F.when(~off & (t <= end_of_day(t, eod, early)), win)


def window_end(day: Column, opens: Column, closes: Column, rollover: str = "18:00:00") -> Column:
    """The instant at which a window of a trading day ends: on the date before for windows that open after the rollover."""
    return F.concat_ws(" ", F.when(opens >= rollover, F.date_sub(day, 1)).otherwise(day).cast("string"), closes).cast("timestamp_ntz")
