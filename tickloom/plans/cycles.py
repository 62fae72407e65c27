"""Queries of cycles and of the reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.kernel import spark as kernel
from tickloom.operators import cycles, reports
from tickloom.plans import market, replay, trading
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


@query(replay.SQL["position_cost"].split(" SELECT fill_id AS key, pos,")[0] + """, b AS (SELECT r.*, f.px, f.q, r.pos - f.q AS before, lag(r.cost) OVER (PARTITION BY r.product ORDER BY r.i) AS was FROM r JOIN f ON r.product = f.product AND r.i = f.i)
 SELECT fill_id AS key, CASE WHEN before > 0 THEN 1 ELSE -1 END AS direction, CAST(least(abs(before), abs(q)) AS BIGINT) AS closed, px AS exit_px, round(was, 6) AS open_cost, round(least(abs(before), abs(q)) * CASE WHEN before > 0 THEN 1 ELSE -1 END * (px - was), 4) AS points
 FROM b WHERE before * q < 0""")
def closing_cycles(spark, d):
    """A row per closing fill with what it closes."""
    fills = replay._fills(spark, d)
    costs = kernel.carried_costs(fills, "product", ("at", "key"), fee=0.0001).select(F.col("key").alias("c_key"), "pos", "cost")
    out = cycles.cycles(fills.join(costs, F.col("key") == F.col("c_key")), "product", ("at", "key"), "px", "qty")
    return out.select("key", "direction", "closed", "exit_px", F.round("open_cost", 6).alias("open_cost"), F.round("points", 4).alias("points"))


@query(trading._T + """ SELECT route, count(*) FILTER (direction IN ('1-URGENT', '2-HIGH')) / nullif(count(direction), 0) AS convergence_rate, count(*) FILTER (direction = '5-LOW' AND net < 0) / nullif(count(*) FILTER (direction = '5-LOW'), 0) AS failed_hedges FROM trades GROUP BY 1""")
def exit_rates(spark, d):
    return cycles.exit_rates(trading.trades(spark, d), "route", "direction", ("1-URGENT", "2-HIGH"), ("5-LOW",), "net")


@query(trading._T + " SELECT route, count(gross) AS n, round(avg(abs(gross) / 500), 6) AS mean_units, round(median(abs(gross) / 500), 6) AS median_units FROM trades GROUP BY 1")
def divergence(spark, d):
    """Deviations in units of 500."""
    return cycles.divergence(trading.trades(spark, d), "route", "gross", 500)


@query(trading._T + " SELECT CAST(sum(fees) AS BIGINT) AS total, sum(fees) / nullif(sum(qty), 0) AS per_lot, sum(fees) / nullif(sum(gross), 0) AS of_gross, sum(fees) FILTER (route = 'F') / nullif(sum(qty) FILTER (route = 'F'), 0) AS hedge_per_lot FROM trades")
def taker_costs(spark, d):
    return cycles.taker_costs(trading.trades(spark, d), "fees", "qty", "gross", F.col("route") == "F")


@query(trading._T + " SELECT combo, " + ", ".join(f"CAST(coalesce(sum(qty) FILTER (route = '{v}'), 0) AS BIGINT) AS lots_{i}, count(*) FILTER (route = '{v}') AS n_{i}, CAST(coalesce(sum(net) FILTER (route = '{v}'), 0) AS BIGINT) AS net_{i}" for i, v in enumerate("FOP"))
       + ", count(DISTINCT route) > 1 AS mixed FROM trades GROUP BY 1")
def combo_routes(spark, d):
    """Lots, trades and PnL of each route per combination."""
    return cycles.routes(trading.trades(spark, d), "combo", "route", ("F", "O", "P"), "qty", "net")


@query(trading._INV + " SELECT product, round(avg(abs(position)), 6) AS mean_held, max(abs(position)) AS peak, count(*) FILTER (abs(position) >= 20) / count(position) AS bind_rate FROM inv GROUP BY 1")
def capacity_use(spark, d):
    """How much of a cap of 20 lots the running positions use."""
    return cycles.capacity_use(trading._inventory(spark, d), "product", "position", 20)


_CS = "count(net) AS n, round(avg(net), 3) AS mean, round(count(*) FILTER (net > 0) / nullif(count(net), 0), 3) AS win_rate, round(avg(net) FILTER (net > 0), 3) AS mean_win, round(avg(net) FILTER (net < 0), 3) AS mean_loss, max(net) AS best, min(net) AS worst"


@query(trading._T + f" SELECT route, direction, {_CS} FROM trades GROUP BY 1, 2")
def cycle_statistics(spark, d):
    return cycles.cycle_statistics(trading.trades(spark, d), ("route", "direction"), "net")


@query(trading.SQL["drawdown_regime"].split(" SELECT regime, count(*)")[0] + f", t AS (SELECT g.regime, x.net FROM g JOIN (SELECT CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) - 15000000 - CAST(floor(floor(o_totalprice * 100 + 0.5) / 1000) AS BIGINT) AS net FROM orders) x ON x.day = g.day) SELECT regime, {_CS} FROM t GROUP BY 1")
def regime_metrics(spark, d):
    """Cycle statistics of each drawdown regime."""
    days = reports.regimes(trading._summary(spark, d)).select(F.col("day").alias("r_day"), "regime")
    t = trading.trades(spark, d).withColumn("t_day", F.to_date("close_time"))
    return cycles.cycle_statistics(t.join(days, F.col("t_day") == F.col("r_day")), ("regime",), "net")


@query(trading._DAY + f", c AS (SELECT CAST(close_time AS DATE) AS c_day, {_CS} FROM trades GROUP BY 1) SELECT summ.day, summ.net, c.n AS n_cycles, c.win_rate, c.mean_win, c.mean_loss FROM summ LEFT JOIN c ON summ.day = c.c_day")
def daily_with_cycles(spark, d):
    """Each day's result beside the statistics of its cycles."""
    stats = cycles.cycle_statistics(trading.trades(spark, d).withColumn("c_day", F.to_date("close_time")), ("c_day",), "net")
    days = trading._summary(spark, d).select("day", F.col("net").alias("day_net"))
    return days.join(stats, F.col("day") == F.col("c_day"), "left").select("day", F.col("day_net").alias("net"), F.col("n").alias("n_cycles"), "win_rate", "mean_win", "mean_loss")


@query(trading._LIM + " SELECT CAST(sum(n_msgs) AS BIGINT) AS messages, count(*) AS contract_days, count(*) FILTER (breached) AS n_breached, count(*) FILTER (throttled) AS n_throttled, max(n_msgs) AS most FROM lim")
def order_limit_totals(spark, d):
    return trading._limits(spark, d).agg(F.sum("n_msgs").alias("messages"), F.count("*").alias("contract_days"), F.count_if("breached").alias("n_breached"), F.count_if("throttled").alias("n_throttled"), F.max("n_msgs").alias("most"))


@query("""WITH f AS (SELECT DISTINCT * FROM fills WHERE px IS NOT NULL AND fill_ts IS NOT NULL), m AS (SELECT i.pair_id, i.leg, arg_max(f.px, (f.fill_ts, f.fill_id)) AS mark FROM f JOIN instruments i USING (product) GROUP BY 1, 2)
 SELECT pair_id, max(mark) FILTER (leg = 'quoted') AS quoted_mark, max(mark) FILTER (leg = 'hedge') AS hedge_mark FROM m GROUP BY 1""")
def pair_marks(spark, d):
    """The last fill price of each leg, from one map of marks per pair."""
    i = table(spark, d, "instruments", "product", "pair_id", "leg")
    f = table(spark, d, "fills").distinct().where("px is not null and fill_ts is not null").join(F.broadcast(i), "product")  # 60 fixed rows
    marks = f.groupBy("pair_id", "leg").agg(F.max_by("px", F.struct("fill_ts", "fill_id")).alias("mark")).groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("leg", "mark"))).alias("marks"))
    return marks.select("pair_id", F.try_element_at("marks", F.lit("quoted")).alias("quoted_mark"), F.try_element_at("marks", F.lit("hedge")).alias("hedge_mark"))
