"""Queries of the audit tables' rows and of the checks between them, as (code, related_id) where something is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import ticks
from tickloom.functions.lineage import scratch
from tickloom.operators import alignment, cleaning, integrity, validation
from tickloom.plans import market, replay
from tickloom.sources.tables import table

QUERIES: dict[str, market.Q] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: market.Q) -> market.Q:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _once(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).distinct()


_F, _O, _S, _D = (f"(SELECT DISTINCT * FROM {t})" for t in ("fills", "order_records", "snapshots", "decisions"))
_BY = "PARTITION BY product, CAST(exchange_ts AS DATE) ORDER BY exchange_ts, snapshot_id"


# Rows of the audit tables.


@query(market._MD + " SELECT 'book:' || row_id AS row_id, contract AS product, pair_id || '@' || strftime(exchtime, '%Y%m%dT%H%M%S') AS batch_id, dense_rank() OVER (PARTITION BY pair_id, day ORDER BY exchtime) AS batch_seq, row_id AS source_seq, \"timestamp\" AS recv_ts FROM kept")
def audit_book_events(spark, d):
    """A row per kept snapshot with its batch and its source sequence."""
    seq = F.dense_rank().over(Window.partitionBy("pair_id", "day").orderBy("exchtime")).cast("long")
    return cleaning.keep_last(market.md(spark, d)).select(
        F.concat(F.lit("book:"), F.col("row_id")).alias("row_id"), F.col("contract").alias("product"), F.concat("pair_id", F.lit("@"), F.date_format("exchtime", "yyyyMMdd'T'HHmmss")).alias("batch_id"),
        seq.alias("batch_seq"), F.col("row_id").alias("source_seq"), F.col("timestamp").alias("recv_ts"))


@query(f"SELECT snapshot_id, product, snapshot_hash, artifact_path, feed_seq, CAST(epoch_us(available_at) - epoch_us(exchange_ts) AS BIGINT) AS lag_us, row_number() OVER ({_BY}) AS seq FROM {_S} WHERE kind = 'signal' AND exchange_ts IS NOT NULL")
def audit_signal_snapshots(spark, d):
    rows = _once(spark, d, "snapshots").where("kind = 'signal' and exchange_ts is not null")
    seq = F.row_number().over(Window.partitionBy("product", F.to_date("exchange_ts")).orderBy("exchange_ts", "snapshot_id")).cast("long")
    return rows.select("snapshot_id", "product", "snapshot_hash", "artifact_path", "feed_seq", F.timestamp_diff("MICROSECOND", F.col("exchange_ts"), F.col("available_at")).alias("lag_us"), seq.alias("seq"))


@query(f"SELECT row_id, decision_id, dec_ts, quoted_snapshot, hedge_snapshot, CAST(len(CAST(json(coalesce(signals, '[]')) AS VARCHAR[])) AS BIGINT) AS n_signals, array_to_string(list_sort(CAST(json(coalesce(signals, '[]')) AS VARCHAR[])), ',') AS signal_ids FROM {_D}")
def audit_decisions(spark, d):
    """Decisions with the signals that they consumed, in order."""
    ids = F.array_sort(F.from_json(F.coalesce("signals", F.lit("[]")), "array<string>"))
    return _once(spark, d, "decisions").select("row_id", "decision_id", "dec_ts", "quoted_snapshot", "hedge_snapshot", F.size(ids).cast("long").alias("n_signals"), F.array_join(ids, ",").alias("signal_ids"))


@query(f"SELECT o.row_id, o.order_id, i.leg AS role, CASE o.side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 END * o.requested_qty AS signed_qty, CASE WHEN o.limit_price IS NULL THEN 'market' ELSE 'limit' END AS order_type, o.product || ':' || coalesce(i.fee_model_id, 'none') AS model_ref FROM {_O} o LEFT JOIN instruments i USING (product) WHERE o.record_type = 'order_declared'")
def audit_orders(spark, d):
    """Declared orders with their role, signed quantity, type and execution model."""
    i = table(spark, d, "instruments", "product", "leg", "fee_model_id")
    o = _once(spark, d, "order_records").where("record_type = 'order_declared'").join(F.broadcast(i), "product", "left")  # 60 fixed rows
    sign = F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1)
    return o.select("row_id", "order_id", F.col("leg").alias("role"), (sign * F.col("requested_qty")).alias("signed_qty"), F.when(F.col("limit_price").isNull(), "market").otherwise("limit").alias("order_type"),
                    F.concat("product", F.lit(":"), F.coalesce("fee_model_id", F.lit("none"))).alias("model_ref"))


@query(f"SELECT row_id, order_id, lifecycle_state, filled_qty, residual_qty, coalesce(disposition_reason, 'none') AS reason, row_number() OVER (PARTITION BY order_id ORDER BY occurred_at NULLS FIRST, row_id) AS step FROM {_O} WHERE record_type = 'lifecycle' AND order_id IS NOT NULL")
def audit_lifecycle(spark, d):
    rows = _once(spark, d, "order_records").where("record_type = 'lifecycle' and order_id is not null")
    step = F.row_number().over(Window.partitionBy("order_id").orderBy(F.col("occurred_at").asc_nulls_first(), "row_id")).cast("long")
    return rows.select("row_id", "order_id", "lifecycle_state", "filled_qty", "residual_qty", F.coalesce("disposition_reason", F.lit("none")).alias("reason"), step.alias("step"))


_RES = f"""WITH e AS (SELECT row_id, order_id, occurred_at, record_type, lifecycle_state, requested_qty, filled_qty, max(requested_qty) OVER (PARTITION BY order_id) AS asked,
  coalesce(lag(filled_qty) OVER (PARTITION BY order_id ORDER BY occurred_at NULLS FIRST, row_id), 0) AS before FROM {_O} WHERE order_id IS NOT NULL),
 r AS (SELECT *, CASE WHEN record_type = 'order_declared' THEN 'reserve' ELSE 'release' END AS action,
  CASE WHEN record_type = 'order_declared' THEN requested_qty WHEN lifecycle_state = 'partially_filled' THEN coalesce(filled_qty, 0) - before ELSE asked - before END AS amount FROM e)"""


def _reservations(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("order_id")
    rows = _once(spark, d, "order_records").where("order_id is not null")
    rows = rows.withColumns({"asked": F.max("requested_qty").over(by), "before": F.coalesce(F.lag("filled_qty").over(by.orderBy(F.col("occurred_at").asc_nulls_first(), "row_id")), F.lit(0))})
    declared = F.col("record_type") == "order_declared"
    amount = F.when(declared, F.col("requested_qty")).when(F.col("lifecycle_state") == "partially_filled", F.coalesce("filled_qty", F.lit(0)) - F.col("before")).otherwise(F.col("asked") - F.col("before"))
    return rows.withColumns({"action": F.when(declared, "reserve").otherwise("release"), "amount": amount})


@query(_RES + " SELECT row_id, order_id, action, amount, asked AS envelope_max FROM r")
def audit_reservations(spark, d):
    """What each record reserves or releases of its order's envelope: a partial fill its part, a final state the rest."""
    return _reservations(spark, d).select("row_id", "order_id", "action", "amount", F.col("asked").alias("envelope_max"))


@query(_RES + """, s AS (SELECT row_id, order_id, asked, sum(CASE WHEN action = 'reserve' THEN amount ELSE -amount END) OVER (PARTITION BY order_id ORDER BY occurred_at NULLS FIRST, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM r)
 SELECT DISTINCT CASE WHEN held < 0 THEN 'released_more' ELSE 'over_envelope' END AS code, row_id AS related_id FROM s WHERE held < 0 OR held > asked""")
def check_capacity(spark, d):
    """Records after which an order's reserved quantity is below zero or over its envelope."""
    held = F.sum(F.when(F.col("action") == "reserve", F.col("amount")).otherwise(-F.col("amount"))).over(Window.partitionBy("order_id").orderBy(F.col("occurred_at").asc_nulls_first(), "row_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = _reservations(spark, d).withColumn("held", held).where("held < 0 or held > asked")
    return rows.select(F.when(F.col("held") < 0, "released_more").otherwise("over_envelope").alias("code"), F.col("row_id").alias("related_id")).distinct()


@query(f"""SELECT order_id, CASE WHEN n_fills = 0 THEN 'not_attributed' WHEN filled = done THEN 'reconciled' ELSE 'unreconciled' END AS status, CAST(filled AS BIGINT) AS filled, CAST(done AS BIGINT) AS done FROM (
 SELECT o.order_id, coalesce(f.n, 0) AS n_fills, coalesce(f.q, 0) AS filled, coalesce(o.done, 0) AS done FROM (SELECT order_id, max(filled_qty) AS done FROM {_O} WHERE order_id IS NOT NULL GROUP BY 1) o
 LEFT JOIN (SELECT order_id, count(*) AS n, sum(quantity) AS q FROM {_F} WHERE order_id IS NOT NULL GROUP BY 1) f USING (order_id))""")
def audit_outcomes(spark, d):
    """Whether an order's fills account for what its life cycle says was filled."""
    o = _once(spark, d, "order_records").where("order_id is not null").groupBy("order_id").agg(F.coalesce(F.max("filled_qty"), F.lit(0)).alias("done"))
    f = _once(spark, d, "fills").where("order_id is not null").groupBy("order_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("q"))
    rows = o.join(f, "order_id", "left").withColumn("filled", F.coalesce("q", F.lit(0)))
    return rows.select("order_id", F.when(F.col("n").isNull(), "not_attributed").when(F.col("filled") == F.col("done"), "reconciled").otherwise("unreconciled").alias("status"), "filled", "done")


# Checks between the tables.


@query(f"""SELECT DISTINCT 'decision_row_id' AS code, row_id AS related_id FROM {_D} WHERE row_id <> 'run-00:' || decision_id
 UNION SELECT 'order_row_id', row_id FROM {_O} WHERE order_id IS NOT NULL AND NOT starts_with(row_id, 'run-00:' || order_id || ':')
 UNION SELECT 'declared_row_id', row_id FROM {_O} WHERE (record_type = 'order_declared') <> ends_with(row_id, ':declared')
 UNION SELECT 'artifact', snapshot_id FROM {_S} WHERE artifact_path <> 'snapshots/' || kind || '/' || substr(snapshot_hash, 8, 8) || '.json'
 UNION SELECT 'hash_form', snapshot_id FROM {_S} WHERE NOT regexp_full_match(snapshot_hash, 'sha256:[0-9a-f]{{32}}')""")
def check_identity(spark, d):
    """Row ids, artifact paths and digests that don't follow from the business ids and payloads they stand for."""
    o, s = _once(spark, d, "order_records"), _once(spark, d, "snapshots")
    path = F.concat(F.lit("snapshots/"), F.col("kind"), F.lit("/"), F.substring("snapshot_hash", 8, 8), F.lit(".json"))
    return integrity.all_checks([
        integrity.violations(_once(spark, d, "decisions"), "decision_row_id", F.col("row_id") != F.concat(F.lit("run-00:"), F.col("decision_id")), "row_id"),
        integrity.violations(o, "order_row_id", F.col("order_id").isNotNull() & ~F.col("row_id").startswith(F.concat(F.lit("run-00:"), F.col("order_id"), F.lit(":"))), "row_id"),
        integrity.violations(o, "declared_row_id", (F.col("record_type") == "order_declared") != F.col("row_id").endswith(":declared"), "row_id"),
        integrity.violations(s, "artifact", F.col("artifact_path") != path, "snapshot_id"),
        integrity.violations(s, "hash_form", ~F.col("snapshot_hash").rlike("^sha256:[0-9a-f]{32}$"), "snapshot_id"),
    ])


@query(f"""WITH j AS (SELECT f.*, s.snapshot_id AS found, s.kind, s.available_at, s.product AS of FROM {_F} f LEFT JOIN (SELECT DISTINCT snapshot_id, kind, available_at, product FROM snapshots WHERE snapshot_id IS NOT NULL) s ON f.book_snapshot_id = s.snapshot_id WHERE f.book_snapshot_id IS NOT NULL)
 SELECT DISTINCT 'missing_snapshot' AS code, fill_id AS related_id FROM j WHERE found IS NULL UNION SELECT 'not_a_book', fill_id FROM j WHERE kind <> 'book' UNION SELECT 'snapshot_later', fill_id FROM j WHERE available_at > fill_ts UNION SELECT 'other_product', fill_id FROM j WHERE of <> product""")
def check_depth_use(spark, d):
    """Fills whose book is not there, no book, known only later, or another product's."""
    s = table(spark, d, "snapshots").where("snapshot_id is not null").select(F.col("snapshot_id").alias("found"), F.col("kind").alias("of_kind"), F.col("available_at").alias("known"), F.col("product").alias("of")).distinct()
    j = _once(spark, d, "fills").where("book_snapshot_id is not null").join(s, F.col("book_snapshot_id") == F.col("found"), "left")
    return integrity.all_checks([
        integrity.violations(j, "missing_snapshot", F.col("found").isNull(), "fill_id"), integrity.violations(j, "not_a_book", F.col("of_kind") != "book", "fill_id"),
        integrity.violations(j, "snapshot_later", F.col("known") > F.col("fill_ts"), "fill_id"), integrity.violations(j, "other_product", F.col("of") != F.col("product"), "fill_id"),
    ])


@query(f"""WITH o AS (SELECT order_id, max(requested_qty) AS asked, max(side) AS side, max(product) AS product, max(filled_qty) AS done FROM {_O} WHERE order_id IS NOT NULL GROUP BY 1),
 f AS (SELECT f.*, o.asked, o.side, o.product AS o_product, o.done, sum(quantity) OVER (PARTITION BY order_id) AS total FROM {_F} f JOIN o USING (order_id))
 SELECT DISTINCT 'over_request' AS code, order_id AS related_id FROM f WHERE total > asked UNION SELECT 'against_side', fill_id FROM f WHERE (position_delta > 0) <> (side = 'buy') UNION SELECT 'order_product', fill_id FROM f WHERE product <> o_product
 UNION SELECT 'without_evidence', fill_id FROM f WHERE record_type = 'passive' AND coalesce(done, 0) = 0""")
def check_conservation(spark, d):
    """Fills beyond what was asked for, against the order's side, of another product, or passive ones that no life-cycle record shows."""
    o = _once(spark, d, "order_records").where("order_id is not null").groupBy("order_id").agg(F.max("requested_qty").alias("asked"), F.max("side").alias("o_side"), F.max("product").alias("o_product"), F.max("filled_qty").alias("done"))
    f = _once(spark, d, "fills").join(o, "order_id")
    totals = f.groupBy("order_id").agg(F.sum("quantity").alias("total"), F.max("asked").alias("asked"))
    return integrity.all_checks([
        integrity.violations(totals, "over_request", F.col("total") > F.col("asked"), "order_id"), integrity.violations(f, "against_side", (F.col("position_delta") > 0) != (F.col("o_side") == "buy"), "fill_id"),
        integrity.violations(f, "order_product", F.col("product") != F.col("o_product"), "fill_id"),
        integrity.violations(f, "without_evidence", (F.col("record_type") == "passive") & (F.coalesce("done", F.lit(0)) == 0), "fill_id"),
    ])


@query(f"""WITH r AS (SELECT o.row_id, o.record_type, o.lifecycle_state, o.requested_qty, o.filled_qty, o.residual_qty, o.limit_price, o.disposition_reason, i.tick, d.asked FROM {_O} o LEFT JOIN instruments i USING (product)
  LEFT JOIN (SELECT order_id, max(requested_qty) AS asked FROM order_records WHERE record_type = 'order_declared' GROUP BY 1) d ON o.order_id = d.order_id)
 SELECT DISTINCT 'residual_sum' AS code, row_id AS related_id FROM r WHERE filled_qty + residual_qty <> asked UNION SELECT 'filled_rest', row_id FROM r WHERE lifecycle_state = 'filled' AND residual_qty <> 0
 UNION SELECT 'no_reason', row_id FROM r WHERE lifecycle_state IN ('cancelled', 'expired', 'rejected', 'stale') AND disposition_reason IS NULL UNION SELECT 'declared_fields', row_id FROM r WHERE record_type = 'order_declared' AND (requested_qty IS NULL OR filled_qty IS NOT NULL)
 UNION SELECT 'off_tick', row_id FROM r WHERE abs(limit_price / tick - round(limit_price / tick)) > 0.1""")
def check_order_rows(spark, d):
    """Order rows with fields that their type or state forbids, sums that don't hold, or limits off the tick grid."""
    asked = table(spark, d, "order_records").where("record_type = 'order_declared' and order_id is not null").groupBy(F.col("order_id").alias("d_id")).agg(F.max("requested_qty").alias("asked"))
    i = table(spark, d, "instruments", "product", "tick")
    r = _once(spark, d, "order_records").join(F.broadcast(i), "product", "left").join(asked, F.col("order_id") == F.col("d_id"), "left")  # 60 fixed rows
    steps = F.col("limit_price") / F.col("tick")
    return integrity.all_checks([
        integrity.violations(r, "residual_sum", F.col("filled_qty") + F.col("residual_qty") != F.col("asked"), "row_id"), integrity.violations(r, "filled_rest", (F.col("lifecycle_state") == "filled") & (F.col("residual_qty") != 0), "row_id"),
        integrity.violations(r, "no_reason", F.col("lifecycle_state").isin("cancelled", "expired", "rejected", "stale") & F.col("disposition_reason").isNull(), "row_id"),
        integrity.violations(r, "declared_fields", (F.col("record_type") == "order_declared") & (F.col("requested_qty").isNull() | F.col("filled_qty").isNotNull()), "row_id"),
        integrity.violations(r, "off_tick", F.abs(steps - F.round(steps)) > 0.1, "row_id"),
    ])


@query(f"""WITH ids AS (SELECT row_id, dec_ts, unnest(CAST(json(signals) AS VARCHAR[])) AS id FROM {_D} WHERE signals IS NOT NULL), s AS (SELECT snapshot_id, min(available_at) AS known, max(kind) AS kind FROM snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1)
 SELECT DISTINCT 'unknown_signal' AS code, row_id || '/' || id AS related_id FROM ids ANTI JOIN s ON id = snapshot_id UNION SELECT 'signal_later', row_id || '/' || id FROM ids JOIN s ON id = snapshot_id WHERE known > dec_ts
 UNION SELECT 'not_a_signal', row_id || '/' || id FROM ids JOIN s ON id = snapshot_id WHERE kind <> 'signal' UNION SELECT 'same_book', row_id FROM {_D} WHERE quoted_snapshot = hedge_snapshot""")
def check_signals(spark, d):
    """Signals that a decision names and that are unknown, known only later or none; decisions with one book for both legs."""
    rows = _once(spark, d, "decisions")
    ids = rows.where("signals is not null").select("row_id", "dec_ts", F.explode(F.from_json("signals", "array<string>")).alias("id")).withColumn("ref", F.concat("row_id", F.lit("/"), F.col("id")))
    s = table(spark, d, "snapshots").where("snapshot_id is not null").groupBy("snapshot_id").agg(F.min("available_at").alias("known"), F.max("kind").alias("kind"))
    j = ids.join(s, F.col("id") == F.col("snapshot_id"), "left")
    return integrity.all_checks([
        integrity.violations(j, "unknown_signal", F.col("snapshot_id").isNull(), "ref"), integrity.violations(j, "signal_later", F.col("known") > F.col("dec_ts"), "ref"),
        integrity.violations(j, "not_a_signal", F.col("kind") != "signal", "ref"), integrity.violations(rows, "same_book", F.col("quoted_snapshot") == F.col("hedge_snapshot"), "row_id"),
    ])


@query(market._MD + f""", o AS (SELECT DISTINCT row_id, order_id, product, occurred_at, side, limit_price FROM order_records WHERE record_type = 'order_declared' AND occurred_at IS NOT NULL AND limit_price IS NOT NULL),
 m AS (SELECT o.row_id, o.side, o.limit_price, b.tick, b.bids, b.asks FROM o ASOF JOIN (SELECT contract, exchtime, tick, [bidpx0, bidpx1, bidpx2, bidpx3, bidpx4] AS bids, [askpx0, askpx1, askpx2, askpx3, askpx4] AS asks FROM kept) b ON o.product = b.contract AND o.occurred_at >= b.exchtime)
 SELECT 'quote_off_depth' AS code, row_id AS related_id FROM m WHERE len(list_filter(CASE WHEN side = 'buy' THEN bids ELSE asks END, lambda p: abs(p - limit_price) < tick / 10)) = 0""")
def check_quote_in_depth(spark, d):
    """Orders whose limit is none of the own side's levels of the latest book at their time."""
    o = table(spark, d, "order_records").where("record_type = 'order_declared' and occurred_at is not null and limit_price is not null").select("row_id", F.col("product").alias("contract"), "occurred_at", "side", "limit_price").distinct()
    books = cleaning.keep_last(market.md(spark, d)).select("contract", "exchtime", F.col("row_id").alias("book"), "tick", *[F.array(*[f"{s}px{i}" for i in range(5)]).alias(f"{s}s") for s in ("bid", "ask")])
    m = alignment.asof_backward(o, books, "contract", "occurred_at", "exchtime", ("book", "tick", "bids", "asks"), "book").where("asof_book is not null")
    near = F.exists(F.when(F.col("side") == "buy", F.col("asof_bids")).otherwise(F.col("asof_asks")), lambda p: F.coalesce(F.abs(p - F.col("limit_price")) < F.col("asof_tick") / 10, F.lit(False)))
    return m.where(~near).select(F.lit("quote_off_depth").alias("code"), F.col("row_id").alias("related_id"))


_WF = f"""WITH f AS (SELECT f.fill_id, f.product, f.fill_ts, f.position_delta AS q, CAST(round(f.px / i.tick) AS BIGINT) AS px, CAST(round(o.ref / i.tick) AS BIGINT) AS ref FROM {_F} f JOIN instruments i USING (product)
  JOIN (SELECT order_id, max(limit_price) AS ref FROM order_records WHERE record_type = 'order_declared' GROUP BY 1) o USING (order_id) WHERE f.px IS NOT NULL AND f.fill_ts IS NOT NULL AND abs(f.px) < 1e9),
 m AS (SELECT product, arg_max(px, (fill_ts, fill_id)) AS mark FROM f GROUP BY 1)"""


@query(_WF + """ SELECT product, CAST(sum(q * (mark - px)) AS BIGINT) AS total, CAST(coalesce(sum(q * (mark - ref)), 0) AS BIGINT) AS price_move, CAST(coalesce(sum(q * (ref - px)), 0) AS BIGINT) AS execution,
 CAST(sum(q * (mark - px)) - coalesce(sum(q * (mark - ref)), 0) - coalesce(sum(q * (ref - px)), 0) AS BIGINT) AS residual, count(*) FILTER (ref IS NULL) AS unpriced FROM f JOIN m USING (product) GROUP BY 1""")
def attribution(spark, d):
    """PnL in ticks per product: what the mark moved from the order's own price, what execution cost against it, and the residual of fills without such a price."""
    i = table(spark, d, "instruments", "product", "tick")
    ref = table(spark, d, "order_records").where("record_type = 'order_declared' and order_id is not null").groupBy("order_id").agg(F.max("limit_price").alias("ref"))
    f = _once(spark, d, "fills").where("px is not null and fill_ts is not null and abs(px) < 1e9").join(F.broadcast(i), "product").join(ref, "order_id")  # 60 fixed rows
    f = f.select("product", "fill_ts", "fill_id", F.col("position_delta").alias("q"), ticks.in_ticks(F.col("px"), F.col("tick")).alias("px"), ticks.in_ticks(F.col("ref"), F.col("tick")).alias("ref"))
    marks = f.groupBy("product").agg(F.max_by("px", F.struct("fill_ts", "fill_id")).alias("mark"))
    sums = f.join(marks, "product").groupBy("product").agg(
        F.sum(F.expr("q * (mark - px)")).alias("total"), F.coalesce(F.sum(F.expr("q * (mark - ref)")), F.lit(0)).alias("price_move"), F.coalesce(F.sum(F.expr("q * (ref - px)")), F.lit(0)).alias("execution"), F.count_if(F.col("ref").isNull()).alias("unpriced"))
    return sums.withColumn("residual", F.expr("total - price_move - execution"))


# Books under stress, prints, and rows that were written and read back.


@query(market._MD + f""", b AS (SELECT row_id, list_transform({replay._LV('bid')}, lambda x: x.t) AS bids, list_transform({replay._LV('ask')}, lambda x: x.t) AS asks FROM kept),
 m AS (SELECT row_id, bids, asks, bids[1] + asks[1] AS mm FROM b WHERE len(bids) > 0 AND len(asks) > 0),
 s AS (SELECT row_id, list_transform(bids, lambda p: CAST(floor((4 * mm + 5 * (2 * p - mm)) / 8) AS BIGINT)) AS bids, list_transform(asks, lambda p: CAST(ceil((4 * mm + 5 * (2 * p - mm)) / 8) AS BIGINT)) AS asks FROM m),
 j AS (SELECT row_id, CASE WHEN len(list_filter(bids || asks, lambda p: p <= 0)) > 0 THEN 'not_positive' WHEN len(list_filter(range(1, len(bids)), lambda i: bids[i + 1] >= bids[i])) > 0 THEN 'bid_order'
  WHEN len(list_filter(range(1, len(asks)), lambda i: asks[i + 1] <= asks[i])) > 0 THEN 'ask_order' WHEN bids[1] >= asks[1] THEN 'crossed' END AS code FROM s)
 SELECT code, row_id AS related_id FROM j WHERE code IS NOT NULL""")
def check_stressed_books(spark, d):
    """Books that are no valid ones after their levels were moved away from the mid by a quarter of their distance.

    Each row is judged before the last copy is chosen: that window keeps the filter on the code above it. Else the filter goes down through the projections,
    and each book is worked out again wherever the code names it. Rows with an empty side have no mid, and so no code."""
    rows = market.md(spark, d).select("contract", "exchtime", "row_id", *[F.transform(market._book(s), lambda x: x["ticks"]).alias(f"{s}s") for s in ("bid", "ask")])
    rows = rows.withColumn("mm", F.get("bids", F.lit(0)) + F.get("asks", F.lit(0)))
    rows = rows.withColumns({"bids": validation.stretched_levels(F.col("bids"), F.col("mm"), False), "asks": validation.stretched_levels(F.col("asks"), F.col("mm"), True)})
    rows = rows.select("contract", "exchtime", "row_id", F.when(F.col("mm").isNotNull(), validation.book_issue(F.col("bids"), F.col("asks"))).alias("code"))
    return cleaning.keep_last(rows).where("code is not null").select("code", F.col("row_id").alias("related_id"))


@query(f"""WITH t AS (SELECT f.order_id, f.fill_id, CASE WHEN f.position_delta > 0 THEN 'sell' ELSE 'buy' END AS side, CASE WHEN abs(f.px) < 1e11 THEN CAST(floor(f.px / i.tick + 0.5) AS BIGINT) END AS px, f.quantity AS q FROM {_F} f JOIN instruments i USING (product) WHERE f.order_id IS NOT NULL)
 SELECT order_id, count(*) AS n_trades, CAST(sum(q) AS BIGINT) AS quantity, CASE WHEN bool_or(NOT coalesce(px > 0 AND q > 0, false)) THEN 'invalid_trade' WHEN count(DISTINCT fill_id) < count(fill_id) THEN 'repeated_trade' END AS issue FROM t GROUP BY 1""")
def trades_normalised(spark, d):
    """The prints of each order from their JSON list, with what is wrong with it."""
    i = table(spark, d, "instruments", "product", "tick")
    f = _once(spark, d, "fills").where("order_id is not null").join(F.broadcast(i), "product")  # 60 fixed rows
    one = F.struct(F.when(F.col("position_delta") > 0, "sell").otherwise("buy").alias("taker_side"), ticks.in_ticks(F.col("px"), F.col("tick")).alias("price"), F.col("quantity"), F.col("fill_id").alias("trade_id"))
    lists = f.groupBy("order_id").agg(F.to_json(F.collect_list(one)).alias("text"))  # an order's fills
    read = lists.select("order_id", validation.normalised_trades(F.col("text")).alias("r"))
    return read.select("order_id", F.size("r.trades").cast("long").alias("n_trades"), F.aggregate("r.trades", F.lit(0).cast("long"), lambda n, t: n + t["quantity"]).alias("quantity"), F.col("r.issue").alias("issue"))


@query(f"""SELECT row_id, 'sha256:' || sha256('{{"decision_id":"' || decision_id || '","feed_seq":' || feed_seq || ',"row_id":"' || row_id || '"}}') AS digest FROM {_D} WHERE decision_id IS NOT NULL AND feed_seq IS NOT NULL""")
def rows_read_back(spark, d):
    """Decisions emitted as canonical JSON (keys in order, no blanks) and read back: the digest is of the very text that is parsed."""
    rows = _once(spark, d, "decisions").where("decision_id is not null and feed_seq is not null").select("decision_id", "feed_seq", "row_id")
    path = scratch(spark)
    rows.select(F.to_json(F.struct("decision_id", "feed_seq", "row_id"))).write.text(path)
    return spark.read.text(path).select(F.from_json("value", "row_id string")["row_id"].alias("row_id"), F.concat(F.lit("sha256:"), F.sha2("value", 256)).alias("digest"))


_SEALED = {"decisions": ("row_id", "decision_id", "feed_seq"), "fills": ("fill_id", "order_id", "quantity"), "order_records": ("row_id", "lifecycle_state", "filled_qty")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS artifact, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256({' || chr(124) || '.join(f'coalesce(CAST({c} AS VARCHAR), chr(45))' for c in cols)}), 1, 8) AS BIGINT)) AS BIGINT) AS digest_sum FROM {t}" for t, cols in _SEALED.items()))
def sealed_tables(spark, d):
    """A manifest of tables: rows and the sum of their digests' first 32 bits, whatever the order of the rows."""
    out = None
    for name, columns in _SEALED.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
        one = table(spark, d, name, *columns).agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")).alias("digest_sum")).withColumn("artifact", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
