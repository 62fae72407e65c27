"""Queries of the order kernels, the grid and the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import ticks
from tickloom.kernel import lifecycle
from tickloom.kernel import spark as kernel
from tickloom.kernel.pair import Terms
from tickloom.kernel.policies import TakeSignal
from tickloom.operators import alignment, cleaning, integrity, reports, signals
from tickloom.plans import config, market, trading
from tickloom.sources.tables import table
from tickloom.streaming import streams

QUERIES: dict[str, market.Q] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: market.Q) -> market.Q:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _fills(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fills", "fill_id", "product", "fill_ts", "px", "position_delta").distinct().where("fill_ts is not null and px is not null and product is not null")
    return rows.select("product", F.to_date("fill_ts").alias("day"), F.col("fill_ts").alias("at"), F.col("fill_id").alias("key"), "px", F.col("position_delta").alias("qty"))


@query("""WITH RECURSIVE f AS (SELECT product, fill_id, px, CAST(position_delta AS BIGINT) AS q, row_number() OVER (PARTITION BY product ORDER BY fill_ts, fill_id) AS i
  FROM (SELECT DISTINCT fill_id, product, fill_ts, px, position_delta FROM fills) WHERE fill_ts IS NOT NULL AND px IS NOT NULL AND product IS NOT NULL AND position_delta IS NOT NULL),
 r AS (SELECT product, i, fill_id, q AS pos, px AS cost, 0.0::DOUBLE AS realised FROM f WHERE i = 1
  UNION ALL SELECT f.product, f.i, f.fill_id, r.pos + f.q,
   CASE WHEN r.pos = 0 THEN f.px WHEN r.pos * f.q > 0 THEN (r.pos * r.cost + f.px * f.q) / (r.pos + f.q) WHEN abs(f.q) > abs(r.pos) THEN f.px ELSE r.cost END,
   CASE WHEN r.pos * f.q < 0 THEN (CASE WHEN r.pos > 0 THEN f.px - r.cost ELSE r.cost - f.px END) * least(abs(r.pos), abs(f.q)) - least(abs(r.pos), abs(f.q)) * f.px * 0.0001::DOUBLE ELSE 0.0 END
  FROM r JOIN f ON f.product = r.product AND f.i = r.i + 1)
 SELECT fill_id AS key, pos, round(cost, 6) AS cost, round(realised, 6) AS realised FROM r""")
def position_cost(spark, d):
    """Position, mean cost and realised PnL after every fill: a day begins with the position and cost of the day before."""
    out = kernel.carried_costs(_fills(spark, d), "product", ("at", "key"), fee=0.0001)
    return out.select("key", "pos", F.round("cost", 6).alias("cost"), F.round("realised", 6).alias("realised"))


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.interval_buckets(cleaning.epochs(cleaning.valid_rows(market.md(spark, d))), "tick", "multiplier")
    # Rows without a bid or total go before the increments, as in the reference, so that the next row has their volume. Every other
    # snapshot ages and decays resting orders; on books with no side, crossed, or far apart the policy places none.
    spread = ticks.in_ticks(F.col("askpx0"), F.col("tick")) - ticks.in_ticks(F.col("bidpx0"), F.col("tick"))
    rows = rows.withColumn("tradable", F.coalesce((F.col("bidpx0") > 0) & spread.between(1, 1000), F.lit(False)))
    # Broken quotes (best levels over 1,000 ticks apart either way, or no positive price) are no depth that a resting order could sweep.
    apart = F.coalesce((F.col("bidvol0") > 0) & (F.col("askvol0") > 0) & (F.abs(spread) > 1000), F.lit(False))
    depth = {s: F.when(F.col("tradable"), market._book(s)).when(~apart, F.filter(market._book(s), lambda x: x["ticks"] > 0)) for s in ("bid", "ask")}
    return rows.select("contract", "day", "exchtime", "row_id", depth["bid"].alias("bids"), depth["ask"].alias("asks"), F.col("buckets").alias("traded"), "tradable")


#: Eight combinations of the touch-joining policy.
COMBOS = config.combinations({"every": [10, 25], "qty": [1, 3], "offset": [0, 1], "patience": 40, "limit": 4000})


@query()
def queue_replay(spark, d):
    """Fills of one combination of the touch-joining policy over all contracts and days."""
    return kernel.replay(_ticks(spark, d), COMBOS[:1])


@query()
def grid_ranking(spark, d):
    """All combinations ranked by the PnL of their round trips (in ticks, to the mid of the last book that can be traded on), with robustness."""
    rows = _ticks(spark, d)
    fills = kernel.replay(rows, COMBOS)
    last = rows.where(F.col("tradable") & (F.size("bids") > 0) & (F.size("asks") > 0)).groupBy("contract", "day").agg(F.max_by((F.col("bids")[0]["ticks"] + F.col("asks")[0]["ticks"]) / 2, F.struct("exchtime", "row_id")).alias("mark"))
    per_day = fills.groupBy("combo", "contract", "day").agg(F.sum(-F.col("side") * F.col("qty") * F.col("px")).alias("cash"), F.sum(F.col("side") * F.col("qty")).alias("pos"), F.count("*").alias("n"))
    per_day = per_day.join(last, ["contract", "day"]).withColumn("pnl", F.round(F.col("cash") + F.col("pos") * F.col("mark"), 4))
    nets = per_day.groupBy("combo", "day").agg(F.sum("pnl").alias("net"), F.sum("n").alias("fills"))
    out = nets.groupBy("combo").agg(F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("net") - F.max("net"), 2).alias("net_less_best_day"), F.sum("fills").alias("fills"))
    listed = spark.createDataFrame([tuple(c.values()) for c in COMBOS], "combo int, every int, qty int, offset int, patience int, limit int")
    return reports.best_of(listed.join(out, "combo", "left").fillna(0, ["net", "net_less_best_day", "fills"]), "net", "combo")


@query()
def policy_replay(spark, d):
    """Fills of a policy that takes the touch on a signal (the rolling deviation of the last price), over two settings of its bands."""
    z = cleaning.keep_last(market.md(spark, d)).select("row_id", "contract", "day", "exchtime", ticks.in_ticks(F.col("lastpx"), F.col("tick")).alias("x")).where(F.abs("x") < 100_000_000)
    z = z.withColumn("signal", signals.rolling_z("x", 20)).select(F.col("row_id").alias("z_row"), "signal")
    rows = _ticks(spark, d)
    return kernel.replay(rows.join(z, F.col("row_id") == F.col("z_row"), "left").drop("z_row"), config.combinations({"enter": [2.0, 3.0], "leave": 0.5, "qty": 2, "limit": 4000}), policy=TakeSignal)


_TRADES = trading._RZ.replace("WITH ", "WITH RECURSIVE ", 1) + f""", q AS (SELECT row_id, contract, day, x, z, row_number() OVER ({trading._W}) AS n, count(*) OVER (PARTITION BY contract, day) AS m FROM z),
 r AS (SELECT contract, day, n, CASE WHEN abs(z) > 2 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END AS target, 0 AS held, row_id AS entry_row, x AS entry_x, false AS closes, row_id AS exit_row, 0 AS side, CAST(0 AS BIGINT) AS pnl, row_id AS was_row FROM q WHERE n = 1
  UNION ALL SELECT contract, day, n, target, CASE WHEN closes OR was = 0 THEN aim ELSE was END, CASE WHEN (closes OR was = 0) AND aim <> 0 THEN row_id ELSE old_row END, CASE WHEN (closes OR was = 0) AND aim <> 0 THEN x ELSE old_x END, closes, row_id, was, CAST((x - old_x) * was AS BIGINT), old_row
  FROM (SELECT q.contract, q.day, q.n, q.row_id, q.x, r.held AS was, r.entry_row AS old_row, r.entry_x AS old_x, CASE WHEN q.n = q.m THEN 0 ELSE r.target END AS aim, r.held <> 0 AND CASE WHEN q.n = q.m THEN 0 ELSE r.target END <> r.held AS closes,
    CASE WHEN q.z IS NULL THEN r.target WHEN r.target = 0 AND abs(q.z) > 2 THEN CASE WHEN q.z > 0 THEN -1 ELSE 1 END WHEN r.target <> 0 AND abs(q.z) <= 0.5 THEN 0 ELSE r.target END AS target
   FROM r JOIN q ON q.contract = r.contract AND q.day = r.day AND q.n = r.n + 1))
 SELECT contract, was_row AS entry_row, exit_row, side, pnl AS pnl_ticks FROM r WHERE closes"""


@query(_TRADES)
def signal_trades(spark, d):
    """Round trips of the rolling deviation with an entry and an exit band."""
    rows = cleaning.keep_last(market.md(spark, d)).select("row_id", "contract", "day", "exchtime", ticks.in_ticks(F.col("lastpx"), F.col("tick")).alias("x")).where(F.abs("x") < 100_000_000)
    return kernel.hysteresis_trades(rows.withColumn("z", signals.rolling_z("x", 20)), 2.0, 0.5)


_LV = lambda side: "list_filter([" + ", ".join(f"{{'t': {market._IT(f'{side}px{i}')}, 'q': CAST({side}vol{i} AS BIGINT)}}" for i in range(5)) + "], lambda x: x.q > 0 AND x.t IS NOT NULL)"
_EXEC = market._MD.replace("WITH ", "WITH RECURSIVE ", 1) + f""", books AS (SELECT contract, exchtime, row_id AS book, {_LV('bid')} AS bids, {_LV('ask')} AS asks FROM kept),
 o AS (SELECT DISTINCT r.row_id AS order_key, r.product AS contract, r.occurred_at AS ts, r.side, r.requested_qty AS qty, {market._IT('r.limit_price').replace('tick', 'i.tick')} AS lim FROM order_records r JOIN instruments i USING (product)
  WHERE r.record_type = 'order_declared' AND r.occurred_at IS NOT NULL AND r.limit_price IS NOT NULL AND r.requested_qty IS NOT NULL),
 m AS (SELECT o.*, b.book, b.bids, b.asks, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg, CASE WHEN side = 'buy' THEN b.asks ELSE b.bids END AS lv FROM o ASOF LEFT JOIN books b ON o.contract = b.contract AND o.ts >= b.exchtime),
 j AS (SELECT *, CASE WHEN len(list_filter(range(1, len(bids)), lambda i: bids[i].t <= bids[i + 1].t)) > 0 THEN 'invalid_bid_order' WHEN len(list_filter(range(1, len(asks)), lambda i: asks[i].t >= asks[i + 1].t)) > 0 THEN 'invalid_ask_order'
  WHEN bids[1].t >= asks[1].t THEN 'crossed_book' END AS bad FROM m),
 k AS (SELECT *, CASE WHEN book IS NULL THEN 'stale' WHEN bad IS NOT NULL THEN 'failed' WHEN len(lv) = 0 THEN 'no_liquidity' WHEN (lim - lv[1].t) * sg < 0 THEN 'rejected' END AS early FROM j),
 a AS (SELECT order_key, contract, book, side, sg, qty, lim, CAST(ts AS DATE) AS day, list_transform(lv, lambda x: x.t) AS px, list_transform(lv, lambda x: x.q) AS size, row_number() OVER (PARTITION BY contract, CAST(ts AS DATE), book, side ORDER BY ts, order_key) AS n FROM k WHERE early IS NULL),
 can AS (SELECT *, size AS left_over, list_transform(range(1, len(px) + 1), lambda i: CASE WHEN (lim - px[i]) * sg >= 0 THEN CAST(floor(size[i] * 0.5::DOUBLE) AS BIGINT) ELSE 0 END) AS can FROM a WHERE n = 1
  UNION ALL SELECT a.*, list_transform(range(1, len(a.px) + 1), lambda i: c.left_over[i] - least(c.can[i], greatest(0, c.qty - coalesce(list_sum(c.can[1:i - 1]), 0)))),
   list_transform(range(1, len(a.px) + 1), lambda i: CASE WHEN (a.lim - a.px[i]) * a.sg >= 0 THEN CAST(floor((c.left_over[i] - least(c.can[i], greatest(0, c.qty - coalesce(list_sum(c.can[1:i - 1]), 0)))) * 0.5::DOUBLE) AS BIGINT) ELSE 0 END)
  FROM can c JOIN a ON a.contract = c.contract AND a.day = c.day AND a.book = c.book AND a.side = c.side AND a.n = c.n + 1),
 t AS (SELECT order_key, qty, px, list_transform(range(1, len(px) + 1), lambda i: least(can[i], greatest(0, qty - coalesce(list_sum(can[1:i - 1]), 0)))) AS take FROM can)
SELECT order_key, CASE WHEN list_sum(take) = 0 THEN 'no_liquidity' WHEN list_sum(take) < qty THEN 'partial' ELSE 'filled' END AS status, CASE WHEN list_sum(take) = 0 THEN 'no_executable_depth' END AS reason, CAST(list_sum(take) AS BIGINT) AS filled,
 len(list_filter(take, lambda x: x > 0)) AS n_levels, CAST(list_sum(list_transform(range(1, len(px) + 1), lambda i: px[i] * take[i])) AS BIGINT) AS notional_ticks, px[1] AS touch FROM t
UNION ALL SELECT order_key, early, CASE early WHEN 'stale' THEN 'missing_book' WHEN 'failed' THEN bad WHEN 'no_liquidity' THEN 'empty_book' ELSE 'limit_not_marketable' END, 0, 0, 0, CASE WHEN early = 'rejected' THEN lv[1].t END FROM k WHERE early IS NOT NULL"""


@query(_EXEC)
def depth_execution(spark, d):
    """Declared orders against the latest book of their product, orders on one snapshot sharing its depth."""
    orders = table(spark, d, "order_records").where("record_type = 'order_declared' and occurred_at is not null and limit_price is not null and requested_qty is not null")
    i = table(spark, d, "instruments", "product", "tick")
    orders = orders.select("row_id", "product", "occurred_at", "side", "requested_qty", "limit_price").distinct().join(F.broadcast(i), "product")  # 60 fixed rows
    orders = orders.select(F.col("row_id").alias("order_key"), F.col("product").alias("contract"), F.col("occurred_at").alias("at"), "side", F.col("requested_qty").alias("qty"), ticks.in_ticks(F.col("limit_price"), F.col("tick")).alias("limit"))
    books = cleaning.keep_last(market.md(spark, d)).select("contract", "exchtime", F.col("row_id").alias("book"), market._book("bid").alias("bids"), market._book("ask").alias("asks"))
    met = alignment.asof_backward(orders, books, "contract", "at", "exchtime", ("book", "bids", "asks"), "book")
    met = met.select("order_key", "contract", F.to_date("at").alias("day"), "at", "side", "qty", "limit", F.col("asof_book").alias("book"), F.col("asof_bids").alias("bids"), F.col("asof_asks").alias("asks"))
    return kernel.execute_orders(met, ("contract", "day"))


def _pair_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.interval_buckets(cleaning.epochs(cleaning.keep_last(market.md(spark, d))), "tick", "multiplier")
    rows = rows.select("pair_id", "leg", "day", "exchtime", "row_id", market._book("bid").alias("bids"), market._book("ask").alias("asks"), F.col("buckets").alias("traded"), "multiplier")
    return kernel.pair_replay(alignment.paired(rows, ("quoted", "hedge"), ("pair_id", "day"), "exchtime", ("row_id", "bids", "asks", "traded", "multiplier")), Terms())


@query()
def pair_replay(spark, d):
    """The ledger of the strict two-leg replay."""
    return _pair_ledger(spark, d)


def ledger_checks(led: DataFrame) -> DataFrame:
    """(code, related_id) where a pair's ledger contradicts itself: running positions are the sums of the effects, every day of a pair
    ends once, flat days have no position, and effects come from the sources there are."""
    led = led.withColumn("id", F.concat_ws(":", "pair_id", "day", "seq"))
    w = Window.partitionBy("pair_id", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = led.withColumns({f"{leg}_sum": F.sum(F.when(F.col("leg") == leg, F.col("delta")).otherwise(0)).over(w) for leg in ("quoted", "hedge")})
    run = run.withColumn("ends", F.sum((F.col("source") == "end").cast("int")).over(Window.partitionBy("pair_id", "day")))
    return integrity.all_checks([
        integrity.violations(run, "running_position", (F.col("quoted_sum") != F.col("quoted_pos")) | (F.col("hedge_sum") != F.col("hedge_pos")), "id"),
        integrity.violations(run, "one_end", F.col("ends") != 1, "id"),
        integrity.violations(run, "flat_is_flat", (F.col("source") == "end") & ((F.col("status") == "flat") != ((F.col("quoted_pos") == 0) & (F.col("hedge_pos") == 0))), "id"),
        integrity.violations(run, "source", ~F.col("source").isin("maker", "hedge", "eod", "end") | ((F.col("source") == "maker") & (F.col("leg") != "quoted")), "id"),
    ])


@query("SELECT CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS related_id WHERE false")
def replay_invariants(spark, d):
    """Checks of the replay's ledger, none of which may find anything."""
    return ledger_checks(_pair_ledger(spark, d))


@query()
def replay_pnl(spark, d):
    """PnL of the replay per pair: cash of both legs in the quoted leg's tick value, open positions marked at the last price of their leg."""
    led = _pair_ledger(spark, d).where("source <> 'end'")
    leg = led.groupBy("pair_id", "day", "leg").agg(F.sum(-F.col("delta") * F.col("px")).alias("cash"), F.sum("delta").alias("pos"), F.max_by("px", "seq").alias("mark"), F.count("*").alias("n"), F.sum(F.abs("delta")).alias("lots"))
    return leg.groupBy("pair_id").agg(F.sum("n").alias("n_effects"), F.sum("lots").alias("lots"), F.round(F.sum(F.col("cash") + F.col("pos") * F.col("mark")), 4).alias("pnl_ticks"), F.count_if(F.col("pos") != 0).alias("n_open"))


_LEGAL = " OR ".join(f"(before = '{a}' AND lifecycle_state IN ({', '.join(repr(b) for b in sorted(lifecycle.NEXT[a]))}))" for a in ("arrived", "partially_filled"))


@query(f"""WITH r AS (SELECT DISTINCT order_id, row_id, occurred_at, lifecycle_state FROM order_records WHERE record_type = 'lifecycle' AND order_id IS NOT NULL AND occurred_at IS NOT NULL),
 p AS (SELECT *, coalesce(lag(lifecycle_state) OVER (PARTITION BY order_id ORDER BY occurred_at, row_id), 'arrived') AS before FROM r)
 SELECT row_id, before, lifecycle_state FROM p WHERE NOT coalesce({_LEGAL}, false)""")
def illegal_transitions(spark, d):
    """Life-cycle records that their order's state before doesn't allow."""
    rows = table(spark, d, "order_records").where("record_type = 'lifecycle' and order_id is not null and occurred_at is not null").select("order_id", "row_id", "occurred_at", "lifecycle_state").distinct()
    before = F.coalesce(F.lag("lifecycle_state").over(Window.partitionBy("order_id").orderBy("occurred_at", "row_id")), F.lit("arrived"))
    legal = F.lit(False)
    for a in ("arrived", "partially_filled"):
        legal = legal | ((F.col("before") == a) & F.col("lifecycle_state").isin(*sorted(lifecycle.NEXT[a])))
    return rows.withColumn("before", before).where(~F.coalesce(legal, F.lit(False))).select("row_id", "before", "lifecycle_state")


@query("""SELECT date_trunc('minute', exchtime) AS batch_ts, count(*) AS n_rows, count(DISTINCT contract) AS n_products, count(DISTINCT contract) >= 2 AS complete FROM market_data WHERE exchtime IS NOT NULL GROUP BY 1
 HAVING date_trunc('minute', exchtime) + INTERVAL 1 MINUTE <= (SELECT max(exchtime) FROM market_data) - INTERVAL 10 MINUTE""")
def stream_batches(spark, d):
    """Minute batches of the snapshot stream that the watermark has sealed, and whether they are complete."""
    return streams.run_to_table(streams.sealed(streams.table_stream(spark, d, "market_data"), "exchtime", "contract"))


@query(f"""WITH r AS (SELECT order_id, row_id, occurred_at, lifecycle_state, filled_qty, row_number() OVER (PARTITION BY order_id ORDER BY occurred_at, row_id) AS n FROM order_records WHERE order_id IS NOT NULL AND occurred_at IS NOT NULL),
 e AS (SELECT order_id, min(n) FILTER (lifecycle_state IN {lifecycle.FINAL}) AS stop, count(*) AS n_all, max(occurred_at) AS last_at FROM r GROUP BY 1)
 SELECT r.order_id, coalesce(max(lifecycle_state) FILTER (r.n = e.stop), 'timed_out') AS state, count(*) AS n, CAST(coalesce(max(filled_qty), 0) AS BIGINT) AS filled FROM r JOIN e USING (order_id)
 WHERE r.n <= coalesce(e.stop, e.n_all) AND (e.stop IS NOT NULL OR e.last_at + INTERVAL 30 MINUTE < (SELECT max(occurred_at) FROM order_records) - INTERVAL 10 MINUTE) GROUP BY 1""")
def stream_orders(spark, d):
    """Orders at their end, final or timed out, from the stream of their records."""
    return streams.run_to_table(streams.order_ends(streams.table_stream(spark, d, "order_records")))


@query("SELECT snapshot_id FROM snapshots WHERE exchange_ts IS NOT NULL GROUP BY 1")
def stream_dedup(spark, d):
    """Snapshots of the stream once each, copies within the watermark left out (a table that is one file is one micro-batch)."""
    out = streams.deduplicated(streams.table_stream(spark, d, "snapshots", 1_000_000), ["snapshot_id"], "exchange_ts", "3650 days")
    return streams.run_to_table(out.select("snapshot_id"))


@query("SELECT row_id FROM market_data WHERE epoch_us(\"timestamp\") - epoch_us(exchtime) > 180000000")
def stream_late(spark, d):
    return streams.run_to_table(streams.late_rows(streams.table_stream(spark, d, "market_data"), "exchtime", "timestamp", 180).select("row_id"))


@query("SELECT product, CAST(sum(position_delta) AS BIGINT) AS pos FROM (SELECT * FROM fills WHERE fill_ts IS NOT NULL AND px IS NOT NULL AND product IS NOT NULL) GROUP BY 1")
def stream_positions(spark, d):
    """The last position per product of the stateful stream (every delivered fill counts)."""
    rows = streams.table_stream(spark, d, "fills").where("fill_ts is not null and px is not null and product is not null")
    rows = rows.select("product", F.col("fill_ts").alias("at"), F.col("fill_id").alias("key"), "px", F.col("position_delta").alias("qty"))
    out = streams.run_to_table(streams.positions(rows))
    return out.groupBy("product").agg(F.max_by("pos", "n").alias("pos"))
