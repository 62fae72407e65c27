"""Mixing sources to target weights by Pfair scheduling.

The mix is a sequence of blocks of about equal size, one source each. Block k of a source with weight w may not come
before slot floor(k / w) and must come by slot ceil((k + 1) / w); giving each slot to the released block with the
earliest deadline meets all deadlines as the weights sum to one, so after any number of slots each source is
less than one block off its share. Weights are exact fractions with a common denominator Q, and at every multiple of Q
nothing is owed, so the schedule of Q slots (or of the whole mix, if that has fewer) is computed once on the driver and repeats: block
k of a source that has m of every Q slots lies in slot Q * (k div m) + place[k mod m]. Rows thus find their slot alone.

A row's place within its source is a prefix sum of sizes in the order of a hash of its key: sums per (source, hash
range) first, then within each range, so no task holds a source. Small sources are repeated as whole passes and
a last part of one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import checkpointed
from tickloom.llm.encoding import token_counts

MOST_TARGETS = 10_000
MOST_SLOTS = 2_000_000


@dataclass(frozen=True)
class Target:
    source: str
    share: Fraction
    max_repeats: int


def read_targets(table: DataFrame) -> list[Target]:
    """The table of targets, at most ``MOST_TARGETS`` rows (more are an error). Shares are read as the decimals they
    print as; null or non-positive shares or repeats leave the source out; of repeated sources the shares add up."""
    rows = table.select("source", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out: dict[str, Target] = {}
    for r in rows:
        if r.source is None or not r.target_share or not math.isfinite(r.target_share) or r.target_share < 0 or r.max_repeats is None or r.max_repeats < 1:
            continue
        share = Fraction(str(r.target_share))
        old = out.get(r.source)
        out[r.source] = Target(r.source, share + old.share, max(r.max_repeats, old.max_repeats)) if old else Target(r.source, share, r.max_repeats)
    return sorted(out.values(), key=lambda t: t.source)


def schedule(shares: Sequence[Fraction], slots: int) -> list[list[int]]:
    """Slots of the blocks of each source among the first ``slots``, by earliest deadline first; the shares sum to one and are taken exactly."""
    place: list[list[int]] = [[] for _ in shares]
    waiting = [(0, i) for i in range(len(shares))]
    ready: list[tuple[int, int]] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            w = shares[i]
            heapq.heappush(ready, (-(-(len(place[i]) + 1) * w.denominator // w.numerator), i))
        deadline, i = heapq.heappop(ready)
        if slot >= deadline:
            raise RuntimeError("a deadline was missed")
        place[i].append(slot)
        w = shares[i]
        heapq.heappush(waiting, (len(place[i]) * w.denominator // w.numerator, i))
    return place


def slots_needed(shares: Sequence[Fraction], blocks: Sequence[int], most: int = MOST_SLOTS) -> int:
    """Slots to schedule: one period (the shares' common denominator), after which the schedule repeats, or as many as hold each source's
    blocks if these are fewer. Shares are never rounded: where both are over ``most`` it is an error, and larger blocks or coarser shares help."""
    period = math.lcm(*(s.denominator for s in shares))
    held = max(-(-n * s.denominator // s.numerator) for n, s in zip(blocks, shares, strict=True))
    if min(period, held) > most:
        raise ValueError(f"a period of {period} slots and a mix of {held} are both over {most}: take larger blocks or shares of a smaller common denominator")
    return min(period, held)


@dataclass(frozen=True)
class Mix:
    """``rows``: slot, source, block, doc_id, repeat_no, n_tokens, position; ``report``: per target, see ``mixed``."""

    rows: DataFrame
    report: DataFrame


def _placed(sized: DataFrame) -> DataFrame:
    """Rows with ``start``: the tokens of the source before them, in the order of a hash of the key."""
    rows = sized.withColumn("_h", F.xxhash64("doc_id")).withColumn("_range", F.shiftrightunsigned("_h", 52).cast("int"))
    before = Window.partitionBy("_so").orderBy("_ra").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(F.col("source").alias("_so"), F.col("_range").alias("_ra")).agg(F.sum("n_tokens").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_upto", F.sum("n_tokens").over(within))
    return placed.join(ranges, (F.col("source") == F.col("_so")) & (F.col("_range") == F.col("_ra"))).withColumn("start", F.col("_offset") + F.col("_upto") - F.col("n_tokens"))


def mixed(docs: DataFrame, targets: DataFrame, block_tokens: int = 1024, text: str = "text", path: str | None = None) -> Mix:
    """The largest mix in which every source with tokens has its target share of all tokens.

    Sizes are tokens of a public vocabulary (``path``). The shares of targets without any token are spread over the
    others in proportion. The mix has min over sources of (tokens x max_repeats / share) tokens; each source gives its
    part of them as passes over its records (``repeat_no`` from 0, below ``max_repeats``), the last record being
    whole, so a share is off by less than a record. ``slot`` orders the mix (within it ``position``, the tokens of
    the source before the record); a block holds the records that begin within its ``block_tokens`` tokens.

    Records without source, of sources without target, or without tokens (null or empty text) are in no mix. Repeated
    records are records of their own. Other columns are ignored. Without targets or tokens the mix is empty.
    The report has every target: source, target_share, mix_share (after spreading), max_repeats, source_docs,
    source_tokens, mix_docs, mix_tokens, actual_share, most_used.
    """
    spark = docs.sparkSession
    wanted = read_targets(targets)
    listed = spark.createDataFrame([(t.source, float(t.share), t.max_repeats) for t in wanted], "source string, target_share double, max_repeats int")
    named = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("_x")).where(F.col("source").isin([t.source for t in wanted]))
    sized = checkpointed(token_counts(named, ("doc_id", "source"), "_x", path).where(F.col("n_tokens") > 0))
    have = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row per target
    live = [t for t in wanted if have.get(t.source)]
    total = sum((t.share for t in live), Fraction(0))
    size = min((Fraction(have[t.source] * t.max_repeats) / (t.share / total) for t in live), default=Fraction(0))
    shares = [t.share / total for t in live]
    quotas = [math.ceil(size * s) for s in shares]
    q = slots_needed(shares, [-(-n // block_tokens) for n in quotas]) if live else 0
    plan = spark.createDataFrame(
        [(t.source, have[t.source], n, max(1, len(p)), p) for t, n, p in zip(live, quotas, schedule(shares, q), strict=True)],
        "p_source string, p_have long, p_quota long, p_count long, p_place array<int>",
    )
    rows = _placed(sized).join(F.broadcast(plan), F.col("source") == F.col("p_source"))  # at most MOST_TARGETS rows and MOST_SLOTS places
    rows = rows.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.expr("cast((p_quota - 1) div p_have as int)"))))
    rows = rows.withColumn("position", F.col("repeat_no") * F.col("p_have") + F.col("start")).where(F.col("position") < F.col("p_quota"))
    rows = rows.withColumn("block", F.expr(f"position div {int(block_tokens)}"))
    slot = F.expr(f"(block div p_count) * {q} + element_at(p_place, cast(block % p_count as int) + 1)")
    out = rows.select(slot.cast("long").alias("slot"), "source", "block", "doc_id", "repeat_no", "n_tokens", "position")

    used = out.groupBy(F.col("source").alias("u_source")).agg(F.count("*").alias("mix_docs"), F.sum("n_tokens").alias("mix_tokens"), (F.max("repeat_no") + 1).alias("most_used"))
    there = sized.groupBy(F.col("source").alias("t_source")).agg(F.count("*").alias("source_docs"), F.sum("n_tokens").alias("source_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = listed.join(there, F.col("source") == F.col("t_source"), "left").join(used, F.col("source") == F.col("u_source"), "left")
    everything = Window.partitionBy(F.lit(0))  # over the report's rows, one per target
    report = joined.select(
        "source", "target_share", F.when(F.col("t_source").isNotNull(), F.col("target_share") / F.lit(float(total or 1))).otherwise(0.0).alias("mix_share"), "max_repeats",
        zero("source_docs"), zero("source_tokens"), zero("mix_docs"), zero("mix_tokens"), F.coalesce(F.try_divide("mix_tokens", F.sum("mix_tokens").over(everything)), F.lit(0.0)).alias("actual_share"), zero("most_used"),
    )
    return Mix(out, report)
