"""Queries of file sources and sinks, audit tables and integrity checks."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import ticks
from tickloom.functions.lineage import scratch
from tickloom.operators import integrity, signals, stress
from tickloom.plans import market
from tickloom.sources import files
from tickloom.sources.raw_lines import COLUMNS
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


@query("SELECT contract, CAST(exchtime AS DATE) AS day, count(*) AS n, count(lastpx) AS n_px, CAST(sum(totalvol % 1000) AS BIGINT) AS check_vol, max(exchtime) AS last_ts FROM market_data WHERE exchtime IS NOT NULL AND contract IS NOT NULL GROUP BY 1, 2")
def day_csv_scan(spark, d):
    """Snapshots written as CSV by day and contract and read again."""
    root = scratch(spark)
    rows = table(spark, d, "market_data").where("exchtime is not null and contract is not null").withColumn("day", F.to_date("exchtime")).select("contract", "day", *COLUMNS)
    files.write_day_csv(rows, root)
    return files.read_day_csv(spark, root).groupBy("contract", F.col("day").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count("lastpx").alias("n_px"), F.sum(F.expr("totalvol % 1000")).alias("check_vol"), F.max("exchtime").alias("last_ts"))


@query("SELECT row_id, decision_id, feed_seq, dec_ts, signals FROM decisions")
def json_lines_scan(spark, d):
    """Decisions written as JSON lines and read again under their schema."""
    root = scratch(spark)
    files.write_json_lines(table(spark, d, "decisions", "row_id", "decision_id", "feed_seq", "dec_ts", "signals"), root)
    return files.read_json_lines(spark, root, "row_id string, decision_id string, feed_seq long, dec_ts timestamp_ntz, signals string")[0]


@query("SELECT DISTINCT snapshot_hash, kind, artifact_path FROM snapshots WHERE snapshot_hash IS NOT NULL")
def payload_store(spark, d):
    return files.payload_store(table(spark, d, "snapshots"), "snapshot_hash", ("kind", "artifact_path"))


@query(market._MD + f", t AS (SELECT row_id, contract, {market._IT('bidpx0')} AS b, {market._IT('askpx0')} AS a FROM md) SELECT row_id, 'sha256:' || sha256(contract || '|' || row_id || '|' || coalesce(CAST(b AS VARCHAR), '-') || '|' || coalesce(CAST(a AS VARCHAR), '-')) AS snapshot_hash FROM t")
def snapshot_digest(spark, d):
    """Digest of a snapshot's contract, row and best prices in ticks."""
    rows = market.md(spark, d).select("row_id", "contract", ticks.in_ticks(F.col("bidpx0"), F.col("tick")).alias("b"), ticks.in_ticks(F.col("askpx0"), F.col("tick")).alias("a"))
    text = F.concat_ws("|", "contract", F.col("row_id").cast("string"), F.coalesce(F.col("b").cast("string"), F.lit("-")), F.coalesce(F.col("a").cast("string"), F.lit("-")))
    return rows.select("row_id", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("snapshot_hash"))


@query("""WITH r AS (SELECT DISTINCT * FROM order_records WHERE order_id IS NOT NULL)
 SELECT order_id, max(requested_qty) AS requested_qty, count(*) FILTER (record_type = 'lifecycle') AS n_states, max(filled_qty) AS filled_qty,
 coalesce(arg_max(lifecycle_state, (occurred_at, row_id)) FILTER (record_type = 'lifecycle' AND lifecycle_state IS NOT NULL AND occurred_at IS NOT NULL), 'open') AS final_status, max(occurred_at) FILTER (lifecycle_state = 'cancelled') AS cancel_ts FROM r GROUP BY 1""")
def research_orders(spark, d):
    """One row per order from its declaration and life-cycle records."""
    rows = table(spark, d, "order_records").where("order_id is not null").distinct()
    life = (F.col("record_type") == "lifecycle") & F.col("lifecycle_state").isNotNull() & F.col("occurred_at").isNotNull()
    return rows.groupBy("order_id").agg(
        F.max("requested_qty").alias("requested_qty"), F.count_if(F.col("record_type") == "lifecycle").alias("n_states"), F.max("filled_qty").alias("filled_qty"),
        F.coalesce(F.max_by("lifecycle_state", F.when(life, F.struct("occurred_at", "row_id"))), F.lit("open")).alias("final_status"), F.max(F.when(F.col("lifecycle_state") == "cancelled", F.col("occurred_at"))).alias("cancel_ts"),
    )


@query("""WITH f AS (SELECT DISTINCT * FROM fills) SELECT fill_id, order_id, product, fill_ts, CASE WHEN record_type = 'passive' THEN 'maker_evidence' ELSE 'aggressive' END AS evidence,
 CASE WHEN record_type = 'taker' THEN quantity END AS taker_qty, CASE WHEN record_type = 'passive' THEN quantity END AS maker_qty, leg FROM f LEFT JOIN instruments USING (product)""")
def research_fills(spark, d):
    """Fills as evidence of either kind, with the leg of their product."""
    i = table(spark, d, "instruments", "product", "leg")
    rows = table(spark, d, "fills").distinct().join(F.broadcast(i), "product", "left")  # 60 fixed rows
    taker = F.col("record_type") == "taker"
    kind = F.when(F.col("record_type") == "passive", "maker_evidence").otherwise("aggressive")
    return rows.select("fill_id", "order_id", "product", "fill_ts", kind.alias("evidence"), F.when(taker, F.col("quantity")).alias("taker_qty"), F.when(F.col("record_type") == "passive", F.col("quantity")).alias("maker_qty"), "leg")


@query("""WITH ids AS (SELECT DISTINCT row_id, dec_ts, unnest(CAST(json(signals) AS VARCHAR[])) AS id FROM decisions), s AS (SELECT snapshot_id, min(available_at) AS a FROM snapshots GROUP BY 1)
 SELECT row_id, id AS signal_id, (epoch_us(dec_ts) - epoch_us(a)) / 1000 AS age_ms FROM ids LEFT JOIN s ON ids.id = s.snapshot_id""")
def research_signals(spark, d):
    """Age of every signal that a decision consumed."""
    ids = table(spark, d, "decisions").select("row_id", "dec_ts", F.explode(F.from_json("signals", "array<string>")).alias("signal_id")).distinct()
    known = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.min("available_at").alias("a"))
    return ids.join(known, F.col("signal_id") == F.col("snapshot_id"), "left").select("row_id", "signal_id", (F.timestamp_diff("MICROSECOND", F.col("a"), F.col("dec_ts")) / 1000).alias("age_ms"))


_STATES = ("cancelled", "expired", "filled", "partially_filled", "rejected")


@query(f"""WITH f AS (SELECT DISTINCT * FROM fills), o AS (SELECT DISTINCT * FROM order_records)
 SELECT 'fill_sign' AS code, fill_id AS related_id FROM f WHERE abs(position_delta) <> quantity
 UNION SELECT 'fill_without_order', fill_id FROM f WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM order_records WHERE order_id IS NOT NULL)
 UNION SELECT 'repeated_fill_id', fill_id FROM f WHERE fill_id IS NOT NULL GROUP BY fill_id HAVING count(*) > 1
 UNION SELECT 'state_domain', row_id FROM o WHERE lifecycle_state NOT IN {_STATES} OR record_type IS NULL
 UNION SELECT 'residual', row_id FROM o WHERE filled_qty < 0 OR residual_qty < 0
 UNION SELECT 'recv_before_exchange', snapshot_id FROM snapshots WHERE recv_ts < exchange_ts
 UNION SELECT 'order_totals', coalesce(a.order_id, b.order_id) FROM (SELECT order_id, sum(quantity) AS q FROM f WHERE order_id IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT order_id, sum(filled_qty) AS q FROM o WHERE lifecycle_state = 'filled' AND order_id IS NOT NULL GROUP BY 1) b ON a.order_id = b.order_id WHERE a.q IS DISTINCT FROM b.q""")
def invariants(spark, d):
    """All integrity checks over the trading tables."""
    f, o = table(spark, d, "fills").distinct(), table(spark, d, "order_records").distinct()
    done = o.where("lifecycle_state = 'filled' and order_id is not null").select("order_id", F.col("filled_qty").alias("quantity"))
    return integrity.all_checks([
        integrity.violations(f, "fill_sign", F.abs("position_delta") != F.col("quantity"), "fill_id"),
        integrity.unmatched(f, "fill_without_order", "fill_id", "order_id", o.where("order_id is not null"), "order_id"),
        integrity.repeated(f, "repeated_fill_id", "fill_id"),
        integrity.out_of_domain(o, "state_domain", "row_id", {"lifecycle_state": _STATES}, ("record_type",)),
        integrity.violations(o, "residual", (F.col("filled_qty") < 0) | (F.col("residual_qty") < 0), "row_id"),
        integrity.violations(table(spark, d, "snapshots"), "recv_before_exchange", F.col("recv_ts") < F.col("exchange_ts"), "snapshot_id"),
        integrity.unequal_totals(f.where("order_id is not null"), done, "order_totals", "order_id", "quantity"),
    ])


@query("SELECT product || '+' || s AS model_id, s AS scenario, 0.5::DOUBLE * p AS participation, f AS fee_factor, sh AS mid_shift_ticks, CAST(dl AS INTEGER) AS delay_ms FROM instruments, (VALUES ('base', 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0), ('thin', 1.5::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE, 250)) t(s, f, sh, p, dl)")
def stress_models(spark, d):
    models = table(spark, d, "instruments").select(F.col("product").alias("model_id"), F.lit(0.5).alias("participation"))
    return stress.stressed_models(models, stress.scenarios(spark, [("base", 1.0, 0.0, 1.0, 0), ("thin", 1.5, 2.0, 0.5, 250)]))


@query("""WITH p AS (SELECT i.pair_id, i.leg, i.multiplier, sum(f.position_delta) AS pos FROM (SELECT DISTINCT * FROM fills) f JOIN instruments i USING (product) GROUP BY ALL),
 w AS (SELECT pair_id, CAST(sum(CASE WHEN leg = 'quoted' THEN pos ELSE 0 END) AS BIGINT) AS q, CAST(sum(CASE WHEN leg = 'hedge' THEN pos ELSE 0 END) AS BIGINT) AS h, max(CASE WHEN leg = 'quoted' THEN multiplier END) AS wq, max(CASE WHEN leg = 'hedge' THEN multiplier END) AS wh FROM p GROUP BY 1)
 SELECT pair_id, q AS quoted, h AS hedge, -q * wq / wh AS target, q * wq + h * wh AS residual FROM w""")
def hedge_residuals(spark, d):
    """Positions of both legs of a pair, the hedge that would match and the risk that is left."""
    i = table(spark, d, "instruments", "product", "pair_id", "leg", "multiplier")
    pos = table(spark, d, "fills").distinct().join(F.broadcast(i), "product")  # 60 fixed rows
    leg = lambda name, c: F.when(F.col("leg") == name, F.col(c))
    zero = F.lit(0).cast("long")
    out = pos.groupBy("pair_id").agg(
        F.coalesce(F.sum(leg("quoted", "position_delta")), zero).alias("quoted"), F.coalesce(F.sum(leg("hedge", "position_delta")), zero).alias("hedge"), F.max(leg("quoted", "multiplier")).alias("wq"), F.max(leg("hedge", "multiplier")).alias("wh"),
    )
    q, h, wq, wh = F.col("quoted"), F.col("hedge"), F.col("wq"), F.col("wh")
    return out.select("pair_id", "quoted", "hedge", stress.hedge_target(q, wq, wh).alias("target"), stress.residual_risk(q, h, wq, wh).alias("residual"))


@query("SELECT DISTINCT row_id, 'sha256:' || sha256(CAST(to_json(list_sort(list_distinct(CAST(json(coalesce(signals, '[]')) AS VARCHAR[])))) AS VARCHAR)) AS signal_set_hash FROM decisions")
def signal_set_hash(spark, d):
    """Digest of the canonical JSON of the set of signals that a decision consumed, in whatever order it names them."""
    ids = F.array_sort(F.array_distinct(F.coalesce(F.from_json("signals", "array<string>"), F.from_json(F.lit("[]"), "array<string>"))))
    return table(spark, d, "decisions", "row_id", "signals").select("row_id", F.concat(F.lit("sha256:"), F.sha2(F.to_json(ids), 256)).alias("signal_set_hash")).distinct()


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'no_quantity' WHEN value <= 0 THEN 'no_price' END AS issue FROM events""")
def payload_decode(spark, d):
    """Event payloads decoded to their typed field, with what is wrong with them."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events", "event_id", "props", "value").select("event_id", k.alias("k"), F.when(k.isNull(), "no_quantity").when(F.col("value") <= 0, "no_price").alias("issue"))


@query("""WITH r AS (SELECT DISTINCT * FROM fills WHERE fill_ts IS NOT NULL), j AS (SELECT r.fill_id, r.fill_ts, i.pair_id, CASE WHEN i.leg = 'quoted' THEN position_delta ELSE 0 END AS q, CASE WHEN i.leg = 'hedge' THEN position_delta ELSE 0 END AS h FROM r JOIN instruments i USING (product))
 SELECT fill_id, CAST(sum(q) OVER w + sum(h) OVER w AS BIGINT) AS residual FROM j WINDOW w AS (PARTITION BY pair_id ORDER BY fill_ts, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_residual(spark, d):
    """A pair's residual risk after every fill of its whole history."""
    i = table(spark, d, "instruments", "product", "pair_id", "leg")
    rows = table(spark, d, "fills").distinct().where("fill_ts is not null").join(F.broadcast(i), "product")  # 60 fixed rows
    legs = {leg: F.when(F.col("leg") == leg, F.col("position_delta")).otherwise(0) for leg in ("quoted", "hedge")}
    one = F.lit(1)
    return signals.carried_sums(rows, "pair_id", "fill_ts", ("fill_ts", "fill_id"), legs).select("fill_id", stress.residual_risk(F.col("quoted"), F.col("hedge"), one, one).alias("residual"))
