import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.operators.references import Parent, Reference, apply_changes, changes, existence, key_state, orphan_keys, orphan_references, orphan_report, orphans_under, reference_rows, state_of

T = dt.datetime(2024, 1, 25)
CHILD = "id string, ref string, at timestamp_ntz, status string"
PARENT = "key string, at timestamp_ntz, ref_key string"
GONE = "ref_table string, ref_key string, retired_at timestamp_ntz"


def minutes(n):
    return None if n is None else T + dt.timedelta(minutes=n)


def brute(children, parents, gone):
    norm = lambda k: (k or "").strip().lower() or None
    born, lost = {}, {}
    for k, t, _ in parents:
        if norm(k):
            born.setdefault(norm(k), []).append(t)
    for tab, k, t in gone:
        if tab == "p" and norm(k):
            lost.setdefault(norm(k), []).append(t)
    out = set()
    for i, ref, t, _ in children:
        k = norm(ref)
        if k is None:
            continue
        gone_at = min((x for x in lost.get(k, []) if x), default=None)
        born_at = min((x for x in born.get(k, []) if x), default=None)
        if gone_at and t and gone_at <= t:
            out.add((i, "deleted"))
        elif k not in born and k not in lost:
            out.add((i, "missing"))
        elif born_at and t and born_at > t:
            out.add((i, "late"))
    return out


def build(spark, children, parents, gone):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    return [Reference("c.ref", c, "ref", "id", "at", "p")], [Parent("p", p, "key", "at")], spark.createDataFrame(gone, GONE)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    key = lambda: rng.choice([None, "", "  ", *[f"K{i}" for i in range(30)], *[f" k{i} " for i in range(30)], "hot"])
    children = [(f"c{i}", "hot" if i % 3 == 0 else key(), minutes(rng.choice([None, *range(60)])), "") for i in range(400)]
    parents = [(key(), minutes(rng.choice([None, *range(60)])), "") for _ in range(25)] + [("hot", minutes(30), "")]
    gone = [("p", key(), minutes(rng.choice([None, *range(60)]))) for _ in range(10)] + [("q", "hot", minutes(0))]
    children += children[:30]
    refs, pars, removed = build(spark, children, parents, gone)
    found = orphan_references(refs, pars, removed)
    got = [(r.row_key, r.status) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(children, parents, gone)
    assert sum(r.n_refs for r in orphan_report(found).collect()) == len(got)


def test_changes_merge_in_any_order(spark):
    children = [("a", "k1", minutes(5), ""), ("b", "k2", minutes(6), ""), ("c", "K1 ", minutes(1), "")]
    parents = [("k1", minutes(3), ""), ("k3", None, "")]
    refs, pars, removed = build(spark, children, parents, [("p", "k1", minutes(4))])
    all_changes = changes(reference_rows(refs), pars, removed)
    whole = {tuple(r) for r in key_state(all_changes).collect()}
    first = all_changes.where("d_refs = 1")
    rest = all_changes.where("d_refs <> 1")
    assert {tuple(r) for r in apply_changes(key_state(rest), first).collect()} == whole
    now = key_state(all_changes).select("ref_key", "refs", existence(F.lit(minutes(99))).alias("alive"))
    assert {tuple(r) for r in now.collect()} == {("k1", 2, 0), ("k2", 1, 0), ("k3", 0, 1)}


def test_the_count_decides_whatever_is_delivered_how_often(spark):
    """Several records and copies of a removed key leave an existence of 0; a removal before the record never lets it exist."""
    parents = [("k1", minutes(n), "") for n in (1, 1, 2, 3)] + [("k2", minutes(9), ""), ("k3", None, "")]
    children = [("a", "k1", minutes(0), ""), ("b", "k1", minutes(3), ""), ("c", "k1", minutes(5), ""), ("d", "k2", minutes(20), ""), ("e", "k3", minutes(1), ""), ("f", "k4", minutes(1), ""), ("g", "k5", None, "")]
    refs, pars, removed = build(spark, children, parents, [("p", "k1", minutes(5)), ("p", "k1", minutes(6)), ("p", "k2", minutes(7)), ("p", "k4", minutes(2))])
    state = state_of(refs, pars, removed)
    end = state.select("ref_key", existence(F.lit(minutes(99))).alias("n"), existence(F.lit(minutes(4))).alias("four"))
    assert {tuple(r) for r in end.collect()} == {("k1", 0, 1), ("k2", 0, 0), ("k3", 1, 1), ("k4", 0, 0), ("k5", 0, 0)}
    assert {(r.row_key, r.status) for r in orphans_under(state, refs).collect()} == {("a", "late"), ("c", "deleted"), ("d", "deleted"), ("g", "missing")}
    assert {r.ref_key for r in orphan_keys(state).collect()} == {"k1", "k2", "k5"}


def test_empty(spark):
    refs, pars, removed = build(spark, [], [], [])
    assert orphan_references(refs, pars, removed).count() == 0
