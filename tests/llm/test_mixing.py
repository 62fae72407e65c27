from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.mixing import mixed, schedule, slots_needed

SCHEMA = "doc_id long, source string, text string, slot string"
TARGETS = "source string, target_share double, max_repeats int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_schedule_is_fair(counts):
    q = sum(counts)
    place = schedule([Fraction(c, q) for c in counts], q)
    assert sorted(s for p in place for s in p) == list(range(q))
    for c, p in zip(counts, place, strict=True):
        done = 0
        for slot in range(q):
            done += done < c and p[done] == slot
            assert abs(Fraction(c * (slot + 1), q) - done) < 1


def test_slots():
    assert slots_needed([Fraction("0.5"), Fraction("0.3"), Fraction("0.2")], [900, 540, 360]) == 10
    odd = [Fraction(1, 99_991), Fraction(1, 3)]
    odd.append(1 - sum(odd))
    assert slots_needed(odd, [1, 3, 6]) == 99_991
    assert slots_needed(odd, [0, 3, 6], 1000) == 10  # the whole mix is shorter than a period
    with pytest.raises(ValueError):
        slots_needed(odd, [1, 30_000, 60_000], 1000)
    place = schedule(odd, 500)  # a part of a period, with exact shares
    for w, p in zip(odd, place, strict=True):
        for slot in range(500):
            assert abs(w * (slot + 1) - sum(s <= slot for s in p)) < 1


def test_mix(spark):
    docs = [(i, "big", f"word {i} " * 40, "x") for i in range(300)] + [(1000 + i, "small", f"thing {i} " * 10, None) for i in range(20)]
    docs += [(2000, "none", "text", ""), (2001, None, "text", ""), (2002, "big", None, ""), (2003, "big", "", ""), (2004, "small", "twin", ""), (2004, "small", "twin", "")]
    targets = [("big", 0.75, 1), ("small", 0.15, 3), ("absent", 0.1, 2)]
    mix = mixed(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(targets, TARGETS), block_tokens=64)
    rows, report = mix.rows.collect(), {r.source: r for r in mix.report.collect()}
    assert {r.source for r in rows} == {"big", "small"} and set(report) == {"big", "small", "absent"}
    assert report["absent"].mix_docs == 0 and report["absent"].actual_share == 0
    total = sum(r.n_tokens for r in rows)
    for name, share in (("big", 0.75 / 0.9), ("small", 0.15 / 0.9)):
        own = [r for r in rows if r.source == name]
        size = sum(r.n_tokens for r in own)
        largest = max(r.n_tokens for r in own)
        assert abs(size - share * total) <= 2 * largest
        assert abs(report[name].actual_share - size / total) < 1e-12
        assert report[name].mix_tokens == size
        own.sort(key=lambda r: r.position)
        at = 0
        for r in own:  # passes without a hole
            assert r.position == at
            at += r.n_tokens
    assert report["small"].most_used == 3  # the small source limits the mix and is used up
    assert report["small"].mix_docs == 3 * 22 and report["big"].most_used == 1
    by_slot = {}
    for r in rows:
        assert by_slot.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", None, 1), (None, 0.5, 1), ("c", 0.5, None)], TARGETS)
    mix = mixed(none, targets)
    assert mix.rows.count() == 0 and mix.report.collect()[0].actual_share == 0
    assert mixed(none, targets.limit(0)).rows.count() == 0
