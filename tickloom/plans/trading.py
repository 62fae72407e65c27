"""Queries of signals, reports, ledgers and integrity checks, with their SQL.

Trades are the rows of ``orders`` (amounts in cents), the ledger those of ``lineitem``; messages and the life cycle are
``order_records``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, ticks
from tickloom.operators import cleaning, reports, signals
from tickloom.plans import market
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


def _cents(c: str):
    return F.floor(F.col(c) * 100 + 0.5)


def trades(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    gross = _cents("o_totalprice") - 15_000_000
    fees = F.floor(_cents("o_totalprice") / 1000)
    return o.select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_orderdate").alias("close_time"), F.col("o_orderstatus").alias("route"), F.col("o_orderpriority").alias("direction"), (F.col("o_custkey") % 5 + 1).alias("qty"),
        gross.alias("gross"), fees.alias("fees"), (gross - fees).alias("net"), (F.col("o_custkey") % 7).alias("combo"),
    )


_T = """WITH trades AS (SELECT o_orderkey AS trade_id, o_orderdate AS close_time, o_orderstatus AS route, o_orderpriority AS direction, o_custkey % 5 + 1 AS qty,
 CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) - 15000000 AS gross, CAST(floor(floor(o_totalprice * 100 + 0.5) / 1000) AS BIGINT) AS fees, o_custkey % 7 AS combo, gross - fees AS net FROM orders)"""


@query(_T + " SELECT route, count(*) AS n, CAST(sum(net) AS BIGINT) AS net_pnl FROM trades WHERE route IS NOT NULL GROUP BY 1")
def bucket_pnl(spark, d):
    return reports.bucket_pnl(trades(spark, d), "route", "net")


@query(_T + " SELECT direction, count(*) AS n, CAST(sum(net) AS BIGINT) AS net_pnl, count(*) / sum(count(*)) OVER () AS share FROM trades WHERE direction IS NOT NULL GROUP BY 1")
def reason_mix(spark, d):
    return reports.reason_mix(trades(spark, d), "direction", "net")


@query(_T + " SELECT strftime(close_time, '%Y-%m') AS month, " + ", ".join(f"CAST(coalesce(sum(net) FILTER (route = '{v}'), 0) AS BIGINT) AS d_{i}" for i, v in enumerate("FOP")) + ", CAST(coalesce(sum(net) FILTER (route IN ('F', 'O', 'P')), 0) AS BIGINT) AS total FROM trades WHERE close_time IS NOT NULL GROUP BY 1")
def monthly_pivot(spark, d):
    return reports.monthly_pivot(trades(spark, d), "close_time", "route", "net", ("F", "O", "P"))


@query("SELECT CAST(floor((hour(occurred_at) * 60 + minute(occurred_at)) / 30) * 30 AS BIGINT) AS bucket, count(*) AS n, CAST(sum(requested_qty) AS BIGINT) AS net_pnl, round(avg(requested_qty / nullif(filled_qty, 0)), 6) AS mean_per_unit FROM order_records WHERE occurred_at IS NOT NULL GROUP BY 1")
def tod_buckets(spark, d):
    return reports.time_of_day(table(spark, d, "order_records"), "occurred_at", 30, "requested_qty", "filled_qty")


@query(_T + " SELECT route, count(net) AS n, quantile_cont(net, 0.25) AS q25, quantile_cont(net, 0.5) AS median, quantile_cont(net, 0.75) AS q75 FROM trades GROUP BY 1")
def quantiles(spark, d):
    return reports.quantile_summary(trades(spark, d), ("route",), "net")


@query(_T + """, e AS (SELECT list_distinct(quantile_cont(abs(gross), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM trades),
 b AS (SELECT greatest(len(list_filter(edges, lambda x: x < abs(gross))), 1) AS bucket, abs(gross) AS g, net FROM trades, e WHERE gross IS NOT NULL)
 SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, CAST(sum(net) AS BIGINT) AS net_pnl, min(g) AS low, max(g) AS high FROM b GROUP BY 1""")
def qcut_pnl(spark, d):
    return reports.quantile_buckets(trades(spark, d).withColumn("size", F.abs("gross")), "size", "net")


_DAY = _T + """, days AS (SELECT CAST(close_time AS DATE) AS day, count(*) AS n, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(fees) AS BIGINT) AS fees, CAST(floor(sum(fees) * 0.3::DOUBLE) AS BIGINT) AS rebate FROM trades WHERE close_time IS NOT NULL GROUP BY 1),
 netd AS (SELECT *, gross - fees + rebate AS net FROM days),
 summ AS (SELECT *, CAST(sum(net) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum, CASE WHEN count(*) OVER w5 = 5 THEN CAST(sum(net) OVER w5 AS DOUBLE) / 5 END AS mean5 FROM netd WINDOW w5 AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _summary(spark, d):
    return reports.daily_summary(trades(spark, d), "close_time", "gross", "fees", 0.3)


@query(_DAY + " SELECT * FROM summ")
def daily_summary(spark, d):
    return _summary(spark, d)


@query(_DAY + """, k AS (SELECT *, max(cum) OVER () AS pk, last_value(cum) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin, max(day) OVER () AS lastday, count(*) OVER () AS n_days, row_number() OVER (ORDER BY day) AS i FROM summ),
 k2 AS (SELECT *, min(CASE WHEN cum = pk THEN day END) OVER () AS pd FROM k),
 g AS (SELECT *, CASE WHEN (CASE WHEN pk <> 0 THEN (pk - fin) / abs(pk) * 100 ELSE 0 END) > 15 AND pd <> lastday THEN CASE WHEN day <= pd THEN 'profitable' ELSE 'declining' END
  ELSE CASE WHEN i <= n_days // 3 THEN 'early' WHEN i <= 2 * (n_days // 3) THEN 'middle' ELSE 'late' END END AS regime FROM k2)
 SELECT regime, count(*) AS days, CAST(sum(net) AS BIGINT) AS total_net, max(net) AS best_day FROM g GROUP BY 1""")
def drawdown_regime(spark, d):
    return reports.regimes(_summary(spark, d)).groupBy("regime").agg(F.count("*").alias("days"), F.sum("net").alias("total_net"), F.max("net").alias("best_day"))


_LIM = """WITH lim AS (SELECT product, CASE WHEN hour(occurred_at) >= 18 THEN CAST(occurred_at AS DATE) + 1 ELSE CAST(occurred_at AS DATE) END AS trading_day, count(*) AS n_msgs, count(*) >= 20 AS throttled, count(*) > 20 AS breached FROM order_records WHERE occurred_at IS NOT NULL GROUP BY 1, 2)"""


def _limits(spark, d, limit=20):
    rows = table(spark, d, "order_records", "product", "occurred_at").where("occurred_at is not null").withColumn("trading_day", clock.trading_day(F.col("occurred_at")))
    return reports.order_limits(rows, "product", "trading_day", limit)


@query(_LIM + " SELECT * FROM lim")
def order_limits(spark, d):
    return _limits(spark, d)


@query(_LIM + " SELECT trading_day, max(n_msgs) AS msg_max, count(*) FILTER (breached) AS n_breached, count(*) FILTER (throttled) AS n_throttled FROM lim GROUP BY 1")
def order_limit_days(spark, d):
    return reports.order_limit_days(_limits(spark, d), "trading_day")


@query(_LIM + " SELECT * FROM lim WHERE throttled ORDER BY n_msgs DESC, trading_day, product NULLS FIRST LIMIT 10")
def top_throttled(spark, d):
    """The ten busiest: a report of the top, so the limit is the feature."""
    return _limits(spark, d).where("throttled").orderBy(F.col("n_msgs").desc(), "trading_day", "product").limit(10)


TIERS = ((100, 0.0, 0.25), (500, 0.5, 1.0), (None, 1.0, 2.0))


@query("""WITH m AS (SELECT user_id, count(*) AS msgs, count(*) FILTER (event_type = 'purchase') AS traded FROM events GROUP BY 1), o AS (SELECT *, CAST(greatest(msgs, 0) AS DOUBLE) / greatest(traded, 1) - 1.0 AS otr FROM m)
 SELECT user_id, msgs, traded, otr, 0.0::DOUBLE + greatest(0, least(msgs, 100) - 0) * CASE WHEN otr <= 2 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END + greatest(0, least(msgs, 500) - 100) * CASE WHEN otr <= 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + greatest(0, msgs - 500) * CASE WHEN otr <= 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS fee FROM o""")
def message_fees(spark, d):
    m = table(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("msgs"), F.count_if(F.col("event_type") == "purchase").alias("traded"))
    m = m.withColumn("otr", reports.order_to_trade(F.col("msgs"), F.col("traded")))
    return m.withColumn("fee", reports.tier_fee(F.col("msgs"), F.col("otr"), TIERS, 2.0))


@query(_T + """ SELECT trade_id, gross, gross - fees AS after_trade_fee, gross - fees - qty AS after_message_fee, gross - fees + fees // 3 AS after_rebate, gross - fees - qty + fees // 3 AS net,
 CASE WHEN gross > 0 THEN fees / gross END AS trade_fee_ratio, CASE WHEN gross > 0 THEN qty / gross END AS message_fee_ratio FROM trades""")
def pnl_layers(spark, d):
    return trades(spark, d).drop("net").select("trade_id", *[c.alias(n) for n, c in reports.pnl_layers(F.col("gross"), F.col("fees"), F.col("qty"), F.expr("fees div 3")).items()])


_L = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"


@query(f"""WITH e AS (SELECT l_suppkey, {_L} AS v, l_returnflag AS f, l_linestatus AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
 w AS (SELECT l_suppkey, sum(CASE WHEN f = 'R' THEN v // 10 ELSE 0 END) AS capture, sum(CASE WHEN s = 'O' THEN v // 7 ELSE 0 END) AS quoted_mark, sum(CASE WHEN s <> 'O' THEN v // 9 ELSE 0 END) AS hedge_mark, sum(q * 3) AS shortfall, sum(v // 1000) AS fees, sum(v // 4000) AS rebates, sum(v // 8) AS view FROM e GROUP BY 1)
 SELECT l_suppkey, CAST(capture AS BIGINT) AS capture, CAST(quoted_mark AS BIGINT) AS quoted_mark, CAST(hedge_mark AS BIGINT) AS hedge_mark, CAST(shortfall AS BIGINT) AS shortfall, CAST(fees AS BIGINT) AS fees, CAST(rebates AS BIGINT) AS rebates, CAST(view AS BIGINT) AS view,
 CAST(capture + quoted_mark + hedge_mark - shortfall - fees + rebates AS BIGINT) AS total, CAST(capture + quoted_mark + hedge_mark - shortfall - fees + rebates - view AS BIGINT) AS residual FROM w""")
def pnl_waterfall(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity").withColumn("v", _cents("l_extendedprice"))
    zero = F.lit(0).cast("long")
    rows = li.select(
        "l_suppkey", F.when(F.col("l_returnflag") == "R", F.expr("v div 10")).otherwise(zero).alias("capture"), F.when(F.col("l_linestatus") == "O", F.expr("v div 7")).otherwise(zero).alias("quoted_mark"),
        F.when(F.col("l_linestatus") != "O", F.expr("v div 9")).otherwise(zero).alias("hedge_mark"), (F.col("l_quantity").cast("long") * 3).alias("shortfall"), F.expr("v div 1000").alias("fees"), F.expr("v div 4000").alias("rebates"), F.expr("v div 8").alias("view"),
    )
    return reports.waterfall(rows, ("l_suppkey",))


_CON = _T + ", dd AS (SELECT combo, CAST(close_time AS DATE) AS day, sum(net) AS d, max(net) AS b FROM trades GROUP BY 1, 2), con AS (SELECT combo, CAST(sum(d) AS BIGINT) AS net, CAST(sum(d) - max(b) AS BIGINT) AS net_less_best_trade, CAST(sum(d) - max(d) AS BIGINT) AS net_less_best_day FROM dd GROUP BY 1)"


def _concentration(spark, d):
    return reports.concentration(trades(spark, d).withColumn("day", F.to_date("close_time")), "combo", "day", "net")


@query(_CON + " SELECT * FROM con")
def concentration(spark, d):
    return _concentration(spark, d)


@query(_CON + " SELECT *, CAST(row_number() OVER (ORDER BY net_less_best_day DESC, combo) AS INTEGER) AS rank FROM con")
def best_combo(spark, d):
    return reports.best_of(_concentration(spark, d), "net_less_best_day", "combo")


@query(_T + " SELECT direction, count(*) AS n, CAST(sum(net) AS BIGINT) AS net, count(*) FILTER (net > 0) / count(*) AS win_rate, CAST(sum(net) FILTER (net > 0) AS DOUBLE) / CAST(nullif(sum(-net) FILTER (net < 0), 0) AS DOUBLE) AS profit_factor, max(net) AS best, min(net) AS worst FROM trades GROUP BY 1")
def trade_statistics(spark, d):
    return reports.trade_statistics(trades(spark, d), "direction", "net")


_X = market._MD + f", x AS (SELECT row_id, contract, day, exchtime, {market._IT('lastpx')} AS x FROM kept), y AS (SELECT * FROM x WHERE abs(x) < 100000000)"
_W = "PARTITION BY contract, day ORDER BY exchtime, row_id"


def _series(spark, d):
    rows = cleaning.keep_last(market.md(spark, d))
    return rows.select("row_id", "contract", "day", "exchtime", ticks.in_ticks(F.col("lastpx"), F.col("tick")).alias("x")).where(F.abs("x") < 100_000_000)


def _by_contract():
    return Window.partitionBy("contract", "day").orderBy("exchtime", "row_id")


_ZSQL = "CASE WHEN sqrt(CAST(n * q - s * s AS DOUBLE)) / n <> 0 THEN (x - CAST(s AS DOUBLE) / n) / (sqrt(CAST(n * q - s * s AS DOUBLE)) / n) END"


_RZ = _X + f", a AS (SELECT *, count(x) OVER w AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM y WINDOW w AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, CASE WHEN n = 20 THEN {_ZSQL} END AS z FROM a)"


@query(_RZ + " SELECT row_id, round(z, 6) AS z FROM z")
def rolling_z(spark, d):
    return _series(spark, d).select("row_id", F.round(signals.rolling_z("x", 20), 6).alias("z"))


@query(_X + f", a AS (SELECT *, count(x) OVER w AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM y WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT row_id, round(CASE WHEN n >= 2 THEN coalesce({_ZSQL}, 0.0) ELSE 0.0 END, 6) AS z FROM a")
def expanding_z(spark, d):
    return _series(spark, d).select("row_id", F.round(signals.expanding_z("x"), 6).alias("z"))


def _z_rows(spark, d):
    return _series(spark, d).withColumn("z", signals.rolling_z("x", 20))


@query(_RZ + f", t AS (SELECT *, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 END AS raw FROM z) SELECT row_id, CASE WHEN abs(z) <= 0.5 THEN 0 ELSE coalesce(last_value(raw IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS target FROM t")
def target_carry(spark, d):
    return _z_rows(spark, d).select("row_id", signals.targets("z", 1.5, 0.5, _by_contract()).alias("target"))


@query(_RZ + f", t AS (SELECT *, lag(z) OVER w AS one, lag(z, 2) OVER w AS two FROM z WINDOW w AS ({_W})) SELECT row_id, CASE WHEN one > 1.5 AND two <= 1.5 THEN 'up' ELSE 'down' END AS cross FROM t WHERE (one > 1.5 AND two <= 1.5) OR (one < -1.5 AND two >= -1.5)")
def crossings(spark, d):
    return _z_rows(spark, d).withColumn("cross", signals.crossings("z", 1.5, _by_contract())).where("cross is not null").select("row_id", "cross")


@query(_X + f", t AS (SELECT *, (epoch_us(exchtime) - epoch_us(lag(exchtime) OVER ({_W}))) / 1e6 AS gap FROM y) SELECT row_id, gap FROM t WHERE gap > 60")
def gap_rows(spark, d):
    return _series(spark, d).withColumn("gap", signals.gaps("exchtime", 60, _by_contract())).where("gap is not null").select("row_id", "gap")


@query(_X + f", t AS (SELECT *, coalesce(epoch_us(exchtime) - epoch_us(lag(exchtime) OVER ({_W})), 0) AS st FROM y) SELECT row_id, CAST(sum(CASE WHEN st > 300000000 THEN 60000000 ELSE st END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS axis_us FROM t")
def compressed_axis(spark, d):
    step, axis = signals.compressed_time("exchtime", 300, 60, _by_contract())
    return _series(spark, d).withColumn("_step", step).withColumn("axis_us", axis).select("row_id", "axis_us")


@query(_X + f", t AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a, lag(1) OVER w AS fb, lead(1) OVER w AS fa FROM y WINDOW w AS ({_W})) SELECT row_id, x FROM t WHERE fb IS NULL OR fa IS NULL OR x IS DISTINCT FROM b OR x IS DISTINCT FROM a")
def step_compression(spark, d):
    return _series(spark, d).withColumn("_c", signals.step_corners("x", _by_contract())).where("_c").select("row_id", "x")


@query(_X + f""", t AS (SELECT *, (row_number() OVER ({_W}) - 1) // 50 AS b FROM y), u AS (SELECT *, row_number() OVER (PARTITION BY contract, day, b ORDER BY exchtime, row_id) AS i, count(*) OVER (PARTITION BY contract, day, b) AS n,
 arg_min(row_id, (x, exchtime, row_id)) OVER (PARTITION BY contract, day, b) AS lo, arg_min(row_id, (-x, exchtime, row_id)) OVER (PARTITION BY contract, day, b) AS hi FROM t) SELECT row_id, x FROM u WHERE i = 1 OR i = n OR row_id = lo OR row_id = hi""")
def minmax_downsample(spark, d):
    return signals.downsampled(_series(spark, d), "x", 50).select("row_id", "x")


@query("""WITH e AS (SELECT product, occurred_at, row_id, CASE WHEN record_type = 'order_declared' THEN requested_qty ELSE -coalesce(filled_qty, 0) END AS amount FROM (SELECT DISTINCT * FROM order_records) WHERE occurred_at IS NOT NULL)
 SELECT row_id, CAST(sum(amount) OVER (PARTITION BY product ORDER BY occurred_at, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS reserved FROM e""")
def capacity_running(spark, d):
    """Reserved quantity per product over its whole history: declared orders reserve, fills release."""
    rows = table(spark, d, "order_records").distinct().where("occurred_at is not null")
    amount = F.when(F.col("record_type") == "order_declared", F.col("requested_qty")).otherwise(-F.coalesce(F.col("filled_qty"), F.lit(0)))
    return signals.carried_sums(rows, "product", "occurred_at", ("occurred_at", "row_id"), {"reserved": amount}).select("row_id", "reserved")


_TERMINAL = ("filled", "cancelled", "rejected", "expired", "failed", "stale", "no_liquidity")


@query(f"SELECT order_id, count(*) FILTER (record_type <> 'order_declared') AS n_states FROM order_records WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (lifecycle_state IN {_TERMINAL}) = 0")
def lifecycle_finality(spark, d):
    """Orders without a final state."""
    out = table(spark, d, "order_records").where("order_id is not null").groupBy("order_id").agg(F.count_if(F.col("record_type") != "order_declared").alias("n_states"), F.count_if(F.col("lifecycle_state").isin(*_TERMINAL)).alias("_t"))
    return out.where("_t = 0").drop("_t")


@query("""WITH r AS (SELECT DISTINCT order_id, occurred_at, row_id, filled_qty, residual_qty FROM order_records WHERE order_id IS NOT NULL AND filled_qty IS NOT NULL),
 p AS (SELECT *, lag(filled_qty) OVER (PARTITION BY order_id ORDER BY occurred_at NULLS FIRST, row_id) AS before FROM r) SELECT row_id, order_id, before, filled_qty FROM p WHERE filled_qty < before""")
def fill_progression(spark, d):
    """Records whose cumulated fill falls."""
    rows = table(spark, d, "order_records").where("order_id is not null and filled_qty is not null").select("order_id", "occurred_at", "row_id", "filled_qty", "residual_qty").distinct()
    before = F.lag("filled_qty").over(Window.partitionBy("order_id").orderBy("occurred_at", "row_id"))
    return rows.withColumn("before", before).where("filled_qty < before").select("row_id", "order_id", "before", "filled_qty")


_INV = """WITH f AS (SELECT DISTINCT * FROM fills), g AS (SELECT * FROM f WHERE fill_ts IS NOT NULL AND product IS NOT NULL),
 inv AS (SELECT fill_id, product, fill_ts, position_delta, CAST(sum(position_delta) OVER w AS BIGINT) AS position, lead(fill_ts) OVER (PARTITION BY product ORDER BY fill_ts, fill_id) AS nxt FROM g WINDOW w AS (PARTITION BY product ORDER BY fill_ts, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _inventory(spark, d):
    rows = table(spark, d, "fills").distinct().where("fill_ts is not null and product is not null")
    return signals.carried_sums(rows, "product", "fill_ts", ("fill_ts", "fill_id"), {"position": F.col("position_delta")})


@query(_INV + " SELECT fill_id, product, position FROM inv")
def inventory(spark, d):
    """The position after every fill: a day begins with the position of the day before."""
    return _inventory(spark, d).select("fill_id", "product", "position")


@query(_INV + " SELECT product, CAST(fill_ts AS DATE) AS day, CAST(sum(CASE WHEN position <> 0 THEN coalesce(epoch_us(nxt) - epoch_us(fill_ts), 0) ELSE 0 END) AS BIGINT) AS open_us, max(greatest(abs(position), abs(position - coalesce(position_delta, 0)))) AS peak, arg_max(position, (fill_ts, fill_id)) AS last_position FROM inv GROUP BY 1, 2")
def time_in_inventory(spark, d):
    """Time with a position, peak and last position per product and day: the peak counts what the day begins with, and the time from a day's last fill to the
    product's next one, on whatever day, is the earlier day's. After a product's last fill no time is counted."""
    rows = signals.carried_next(_inventory(spark, d), "product", "fill_ts", ("fill_ts", "fill_id"), "nxt")
    open_us = F.when(F.col("position") != 0, F.coalesce(F.timestamp_diff("MICROSECOND", F.col("fill_ts"), F.col("nxt")), F.lit(0))).otherwise(0)
    peak = F.greatest(F.abs("position"), F.abs(F.col("position") - F.coalesce("position_delta", F.lit(0))))
    rows = rows.withColumns({"open_us": open_us, "peak": peak})
    return rows.groupBy("product", F.col("_day").alias("day")).agg(F.sum("open_us").alias("open_us"), F.max("peak").alias("peak"), F.max_by("position", F.struct("fill_ts", "fill_id")).alias("last_position"))


@query("SELECT contract, CAST(exchtime AS DATE) AS day, row_id, row_number() OVER (PARTITION BY contract, CAST(exchtime AS DATE) ORDER BY exchtime, row_id) AS book_seq FROM market_data WHERE exchtime IS NOT NULL")
def book_sequence(spark, d):
    rows = table(spark, d, "market_data", "contract", "exchtime", "row_id").where("exchtime is not null").withColumn("day", F.to_date("exchtime"))
    return rows.select("contract", "day", "row_id", F.row_number().over(Window.partitionBy("contract", "day").orderBy("exchtime", "row_id")).cast("long").alias("book_seq"))


@query("SELECT snapshot_id, count(*) AS n, count(DISTINCT snapshot_hash) AS n_hashes FROM snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    """Snapshot ids that were delivered more than once, and with how many payloads."""
    return table(spark, d, "snapshots").where("snapshot_id is not null").groupBy("snapshot_id").agg(F.count("*").alias("n"), F.countDistinct("snapshot_hash").alias("n_hashes")).where("n > 1")
