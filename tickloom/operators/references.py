"""References to records that do not exist, from signed counts per key.

A reference adds one to its key's reference count. A key's existence count moves by +1 when the key first appears and by -1 when its
removal takes effect, however many copies or records of it are delivered, so it is 1 while the key exists and else 0. The state of a key
holds the counts and the times of its two moves; these are sums, minima and maxima, so changes merge into a stored state in any order
(``apply_changes``). A reference is an orphan if its key's existence count is 0 at its time. A key can have orphans only if the
count is 0 at its first or last reference, as it rises and falls once; only the children of such keys are read again for the report.

Scale: changes are summed in the map side, so a key that a third of all rows name is one row per task. The way
back is a join of the children with the suspicious keys only; its children side may be skewed, which adaptive
execution splits, the key side being unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ["ref_table", "ref_key", "refs", "parents", "removals", "parent_time", "removed_at", "last_ref", "first_ref"]
#: Before every reference: the appearance of a key whose record has no time, or of which only the removal is known.
ALWAYS = "0001-01-01 00:00:00"


@dataclass(frozen=True)
class Reference:
    """A column that names rows of another table: ``name`` for the report, the child's key and time."""

    name: str
    child: DataFrame
    column: str
    row_key: str
    time: str
    parent: str


@dataclass(frozen=True)
class Parent:
    """A table that is referred to; the time of a key is the earliest ``time`` of its rows."""

    name: str
    rows: DataFrame
    key: str
    time: str


def normal_key(c: Column) -> Column:
    """Without surrounding blanks and case; null if nothing is left."""
    text = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(text != "", text)


def reference_rows(references: Sequence[Reference]) -> DataFrame:
    """(ref_field, row_key, ref_table, ref_key, child_time) of every delivered row with a reference, copies included."""
    out = None
    for r in references:
        rows = r.child.select(
            F.lit(r.name).alias("ref_field"), F.col(r.row_key).cast("string").alias("row_key"), F.lit(r.parent).alias("ref_table"),
            normal_key(F.col(r.column)).alias("ref_key"), F.col(r.time).cast("timestamp_ntz").alias("child_time"),
        ).where(F.col("ref_key").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def changes(references: DataFrame, parents: Sequence[Parent], removed: DataFrame) -> DataFrame:
    """Signed changes: (ref_table, ref_key, d_refs, d_parents, d_removals, and the times)."""
    none = F.lit(None).cast("timestamp_ntz")

    def shape(df: DataFrame, refs: int, parent: int, removal: int, child: Column, born: Column, gone: Column) -> DataFrame:
        return df.select(
            "ref_table", "ref_key", F.lit(refs).cast("long").alias("d_refs"), F.lit(parent).cast("long").alias("d_parents"), F.lit(removal).cast("long").alias("d_removals"),
            child.alias("child_time"), born.alias("parent_time"), gone.alias("removed_at"),
        )

    out = shape(references, 1, 0, 0, F.col("child_time"), none, none)
    for p in parents:
        rows = p.rows.select(F.lit(p.name).alias("ref_table"), normal_key(F.col(p.key)).alias("ref_key"), F.col(p.time).cast("timestamp_ntz").alias("_t"))
        out = out.unionByName(shape(rows.where(F.col("ref_key").isNotNull()), 0, 1, 0, none, F.col("_t"), none))
    gone = removed.select("ref_table", normal_key(F.col("ref_key")).alias("ref_key"), F.col("retired_at").cast("timestamp_ntz").alias("_t"))
    return out.unionByName(shape(gone.where(F.col("ref_key").isNotNull()), 0, 0, 1, none, none, F.col("_t")))


def key_state(deltas: DataFrame) -> DataFrame:
    """The counts and times per key."""
    return deltas.groupBy("ref_table", "ref_key").agg(
        F.sum("d_refs").alias("refs"), F.sum("d_parents").alias("parents"), F.sum("d_removals").alias("removals"), F.min("parent_time").alias("parent_time"),
        F.min("removed_at").alias("removed_at"), F.max("child_time").alias("last_ref"), F.min("child_time").alias("first_ref"),
    )


def apply_changes(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state after further changes; equal to ``key_state`` of all changes together."""
    both = state.select(*STATE).unionByName(key_state(deltas))
    return both.groupBy("ref_table", "ref_key").agg(
        F.sum("refs").alias("refs"), F.sum("parents").alias("parents"), F.sum("removals").alias("removals"), F.min("parent_time").alias("parent_time"),
        F.min("removed_at").alias("removed_at"), F.max("last_ref").alias("last_ref"), F.min("first_ref").alias("first_ref"),
    )


def appears_at() -> Column:
    """When a key's existence count goes up: at its earliest record; null if neither a record nor a removal is known."""
    always = F.lit(ALWAYS).cast("timestamp_ntz")
    return F.when(F.col("parents") > 0, F.coalesce("parent_time", always)).when(F.col("removals") > 0, always)


def vanishes_at() -> Column:
    """When it goes down again: at the earliest removal, or at once if that came first."""
    return F.when(F.col("removed_at").isNotNull(), F.greatest(F.col("removed_at"), appears_at()))


def existence(at: Column) -> Column:
    """A key's existence count (1 or 0) at a time, from the moves up to it; without a time, from all that raise it."""
    moved = lambda when: F.coalesce((when <= at).cast("int"), F.lit(0))
    return F.when(at.isNull(), appears_at().isNotNull().cast("int")).otherwise(moved(appears_at()) - moved(vanishes_at()))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with references and an existence count of 0 at the first or the last of them: those that have orphans."""
    return state.where((F.col("refs") > 0) & ((existence(F.col("first_ref")) <= 0) | (existence(F.col("last_ref")) <= 0)))


def state_of(references: Sequence[Reference], parents: Sequence[Parent], removed: DataFrame) -> DataFrame:
    """The state after all rows of the tables."""
    return key_state(changes(reference_rows(references), parents, removed))


def orphans_under(state: DataFrame, references: Sequence[Reference]) -> DataFrame:
    """The orphans among the references under a state: see ``orphan_references``."""
    keys = orphan_keys(state).withColumnsRenamed({"ref_table": "k_table", "ref_key": "k_key"})
    children = reference_rows(references)
    found = children.join(keys, (F.col("ref_table") == F.col("k_table")) & (F.col("ref_key") == F.col("k_key"))).where(existence(F.col("child_time")) <= 0)
    status = F.when(F.col("removed_at") <= F.col("child_time"), "deleted").when(appears_at().isNull(), "missing").otherwise("late")
    return found.withColumn("status", status).select("ref_field", "row_key", "status", "ref_table", "ref_key", "child_time").distinct()


def orphan_references(references: Sequence[Reference], parents: Sequence[Parent], removed: DataFrame) -> DataFrame:
    """(ref_field, row_key, status, ref_table, ref_key, child_time) of references that had nothing to refer to.

    Keys are compared without surrounding blanks and case; null and blank references are none. ``deleted``: the
    earliest removal of the key is not after the child; else ``missing``: neither a record nor a removal of the key;
    else ``late``: the earliest time of the record is after the child. With a null child time only ``missing`` can
    hold; a removal or record without time counts as there, without a time. A row that was delivered several
    times comes out once per status it reaches (exact copies: once). Empty tables give an empty report.
    """
    return orphans_under(state_of(references, parents, removed), references)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring field, period (day of the child, null without time) and status."""
    return orphans.groupBy("ref_field", "ref_table", F.to_date("child_time").alias("period"), "status").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
