import datetime as dt

from tickloom.plans import config as c


def test_configuration():
    good = {"contracts": ["A", "B"], "tick": 1.0, "multiplier": 10, "dates": [], "fee": 0.0}
    assert c.problems(good) == []
    assert c.problems({"contracts": ["A", "A"], "tick": 0, "multiplier": 1, "dates": [], "fee_lot": 1}) == ["not positive: tick", "repeated contracts"]
    assert len(c.problems({})) == 5
    assert c.diagnostics("all") == list(c.DIAGNOSTICS) and c.diagnostics(["regime", "nonsense", "route"]) == ["route", "regime"] and c.diagnostics(None) == [] and c.diagnostics("regime") == ["regime"]
    assert c.schedule_problems(["A", "B"], {"d": ("A", "B")}) == [] and len(c.schedule_problems(["A"], {"d": ("A", "A"), "e": ("A", "C")})) == 3


def test_grid():
    rows = c.combinations({"a": [1, 2], "b": 3, "c": ("x", "y")})
    assert len(rows) == 4 and rows[1] == {"combo": 1, "a": 1, "b": 3, "c": "y"}
    assert c.combinations({}) == [{"combo": 0}]


def test_layout():
    t = dt.datetime(2024, 1, 25, 21)
    assert c.layout("/r", "ag2406", t, "raw") == "/r/raw/underlying=AG/date=2024-01-25/session=night"
    assert c.underlying("24x") == "UNKNOWN" and c.session_tag(dt.datetime(2024, 1, 1, 15)) == "other"
    assert c.run_manifest({"b": 1, "a": t}) == '{"best":null,"config":{"a":"2024-01-25 21:00:00","b":1}}'
