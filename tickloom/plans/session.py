"""Queries of the calendar, of orders of delivery, and of rows before and after a replay's filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import clock, ticks
from tickloom.operators import cleaning
from tickloom.operators.regular_grid import session_windows
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


HOLIDAYS, EARLY = ("2019-01-09",), {"2019-01-08": "11:30:00"}
_TD = "CASE WHEN hour({t}) >= 18 THEN CAST({t} AS DATE) + 1 ELSE CAST({t} AS DATE) END"


def _win(t: str) -> str:
    day = _TD.format(t=t)
    return f"""CASE WHEN {day} <> DATE '2019-01-09' AND {t} <= {day} + CASE WHEN {day} = DATE '2019-01-08' THEN TIME '11:30:00' ELSE TIME '15:00:00' END
 THEN (SELECT min(window_order) FROM session_windows w WHERE CAST({t} AS TIME) >= CAST(opens_at AS TIME) AND CAST({t} AS TIME) < CAST(closes_at AS TIME)) END"""


def _window(spark, d, t: str):
    return clock.calendar_window(F.col(t), session_windows(table(spark, d, "session_windows")), HOLIDAYS, EARLY)


@query(f"SELECT row_id, {_win('exchtime')} AS win FROM market_data WHERE exchtime IS NOT NULL")
def calendar_membership(spark, d):
    """The session window of every snapshot under holidays and early closes."""
    return table(spark, d, "market_data", "row_id", "exchtime").where("exchtime is not null").select("row_id", _window(spark, d, "exchtime").alias("win"))


@query(f"""WITH t AS (SELECT DISTINCT {_TD.format(t='exchtime')} AS day FROM market_data WHERE exchtime IS NOT NULL)
 SELECT day, window_order, CASE WHEN opens_at >= '18:00:00' THEN day - 1 ELSE day END + CAST(closes_at AS TIME) AS ends_at FROM t, session_windows""")
def window_ends(spark, d):
    """The instant at which each window of each trading day ends."""
    days = table(spark, d, "market_data", "exchtime").where("exchtime is not null").select(clock.trading_day(F.col("exchtime")).alias("day")).distinct()
    return days.crossJoin(F.broadcast(table(spark, d, "session_windows"))).select("day", "window_order", clock.window_end(F.col("day"), F.col("opens_at"), F.col("closes_at")).alias("ends_at"))  # four fixed rows


@query(f"""WITH t AS (SELECT i.pair_id, m.exchtime, i.leg, {_win('m.exchtime')} IS NOT NULL AS is_open FROM market_data m JOIN instruments i ON m.contract = i.product WHERE m.exchtime IS NOT NULL)
 SELECT pair_id, exchtime, count(DISTINCT leg) = 2 AND bool_and(is_open) AS is_open FROM t GROUP BY 1, 2""")
def pair_session_open(spark, d):
    """Whether both legs of a pair are there and in session at a batch's time."""
    rows = market.md(spark, d).select("pair_id", "exchtime", "leg", _window(spark, d, "exchtime").isNotNull().alias("is_open"))
    return rows.groupBy("pair_id", "exchtime").agg((F.max((F.col("leg") == "quoted").cast("int")) + F.max((F.col("leg") == "hedge").cast("int")) == 2).alias("both"), F.bool_and("is_open").alias("all_open")).select(
        "pair_id", "exchtime", (F.col("both") & F.col("all_open")).alias("is_open"))


@query(f"""SELECT DISTINCT snapshot_id, CASE WHEN kind = 'signal' THEN 'kept' WHEN {_TD.format(t='exchange_ts')} <> DATE '2019-01-07' THEN 'wrong_day' WHEN {_win('exchange_ts')} IS NULL THEN 'out_of_session' ELSE 'kept' END AS disposition
 FROM snapshots WHERE exchange_ts IS NOT NULL""")
def replay_filter(spark, d):
    """What a replay of one trading day does with each snapshot: signals are always kept, other days are an error, the rest must be in session."""
    t = F.col("exchange_ts")
    what = F.when(F.col("kind") == "signal", "kept").when(clock.trading_day(t) != F.lit("2019-01-07").cast("date"), "wrong_day").when(_window(spark, d, "exchange_ts").isNull(), "out_of_session").otherwise("kept")
    return table(spark, d, "snapshots").where(t.isNotNull()).select("snapshot_id", what.alias("disposition")).distinct()


@query("SELECT row_id, decision_id FROM (SELECT DISTINCT row_id, decision_id, quoted_snapshot, dec_ts FROM decisions WHERE dec_ts IS NOT NULL AND quoted_snapshot IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY quoted_snapshot, CAST(dec_ts AS DATE) ORDER BY dec_ts, row_id) > 1")
def opening_skip(spark, d):
    """Decisions without the first of every book and day, which a stressed run skips."""
    rows = table(spark, d, "decisions").where("dec_ts is not null and quoted_snapshot is not null").select("row_id", "decision_id", "quoted_snapshot", "dec_ts").distinct()
    n = F.row_number().over(Window.partitionBy("quoted_snapshot", F.to_date("dec_ts")).orderBy("dec_ts", "row_id"))
    return rows.withColumn("n", n).where("n > 1").select("row_id", "decision_id")


@query("SELECT m.row_id, row_number() OVER (PARTITION BY i.pair_id, CAST(m.\"timestamp\" AS DATE) ORDER BY m.\"timestamp\", i.leg DESC, m.row_id) AS place FROM market_data m JOIN instruments i ON m.contract = i.product WHERE m.\"timestamp\" IS NOT NULL")
def receive_order(spark, d):
    """Both legs of a pair merged by receive time; ties by leg (quoted first), then by delivery."""
    i = table(spark, d, "instruments", "product", "pair_id", "leg")
    rows = table(spark, d, "market_data", "row_id", "contract", "timestamp").where("timestamp is not null").join(F.broadcast(i), F.col("contract") == F.col("product"))  # 60 fixed rows
    w = Window.partitionBy("pair_id", F.to_date("timestamp")).orderBy("timestamp", F.col("leg").desc(), "row_id")
    return rows.select("row_id", F.row_number().over(w).cast("long").alias("place"))


@query(market._MD + " SELECT row_id, dense_rank() OVER (PARTITION BY pair_id, day ORDER BY exchtime) AS batch, row_number() OVER (PARTITION BY pair_id, day ORDER BY exchtime, contract, row_id) AS place FROM md")
def batch_order(spark, d):
    """Rows in their canonical order: batch (one event time), contract, delivery."""
    w = Window.partitionBy("pair_id", "day")
    return market.md(spark, d).select("row_id", F.dense_rank().over(w.orderBy("exchtime")).cast("long").alias("batch"), F.row_number().over(w.orderBy("exchtime", "contract", "row_id")).cast("long").alias("place"))


@query("SELECT snapshot_id, kind, exchange_ts, row_number() OVER (PARTITION BY product, CAST(exchange_ts AS DATE) ORDER BY exchange_ts, kind, snapshot_id) AS place FROM (SELECT DISTINCT snapshot_id, kind, product, exchange_ts FROM snapshots WHERE exchange_ts IS NOT NULL)")
def event_order(spark, d):
    """Events of a product's day in their order within batches: the book before the signal."""
    rows = table(spark, d, "snapshots", "snapshot_id", "kind", "product", "exchange_ts").where("exchange_ts is not null").distinct()
    w = Window.partitionBy("product", F.to_date("exchange_ts")).orderBy("exchange_ts", "kind", "snapshot_id")
    return rows.select("snapshot_id", "kind", "exchange_ts", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT fill_id AS id, product, quantity AS qty, px, CAST(NULL AS VARCHAR) AS side FROM fills UNION ALL SELECT row_id, product, requested_qty, NULL, side FROM order_records WHERE record_type = 'order_declared'")
def union_by_name(spark, d):
    """Fills and declared orders in one table; a column that one side lacks is null."""
    f = table(spark, d, "fills").select(F.col("fill_id").alias("id"), "product", F.col("quantity").alias("qty"), "px")
    o = table(spark, d, "order_records").where("record_type = 'order_declared'").select(F.col("row_id").alias("id"), "product", F.col("requested_qty").alias("qty"), "side")
    return f.unionByName(o, allowMissingColumns=True)


@query(market._MD + " SELECT DISTINCT pair_id, day FROM md WHERE leg = 'quoted' INTERSECT SELECT DISTINCT pair_id, day FROM md WHERE leg = 'hedge'")
def common_days(spark, d):
    """Days on which both legs of a pair have data."""
    rows = market.md(spark, d).select("pair_id", "day", "leg")
    return rows.where("leg = 'quoted'").select("pair_id", "day").distinct().join(rows.where("leg = 'hedge'"), ["pair_id", "day"], "left_semi")


@query("SELECT product, CAST(len(split_part(CAST(tick AS VARCHAR), '.', 2)) AS BIGINT) AS decimals FROM instruments")
def tick_precision(spark, d):
    """Decimals of each instrument's tick as it is written."""
    return table(spark, d, "instruments").select("product", F.length(F.split_part(F.col("tick").cast("string"), F.lit("."), F.lit(2))).cast("long").alias("decimals"))


_LOGS = market._MD + """, a AS (SELECT pair_id, day, exchtime, row_id, bidpx0 + askpx0 AS m FROM kept WHERE leg = 'quoted' AND bidpx0 > 0 AND askpx0 > 0 AND bidpx0 < 1e11 AND askpx0 < 1e11),
 b AS (SELECT pair_id, exchtime, bidpx0 + askpx0 AS m FROM kept WHERE leg = 'hedge' AND bidpx0 > 0 AND askpx0 > 0 AND bidpx0 < 1e11 AND askpx0 < 1e11),
 x AS (SELECT a.pair_id, a.day, a.exchtime, a.row_id, CAST(round((ln(a.m) - ln(b.m)) * 1e6) AS BIGINT) AS x FROM a JOIN b USING (pair_id, exchtime)),
 s AS (SELECT *, count(x) OVER w AS n, sum(x) OVER w AS s1, sum(x * x) OVER w AS s2 FROM x WINDOW w AS (PARTITION BY pair_id, day ORDER BY exchtime, row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query(_LOGS + " SELECT row_id, x, n FROM s")
def log_spread(spark, d):
    """Difference of the legs' log mids in millionths, with the readings that its rolling score rests on."""
    rows = _log_spread(spark, d)
    w = Window.partitionBy("pair_id", "day").orderBy("exchtime", "row_id").rowsBetween(-20, -1)
    return rows.select("row_id", "x", F.count("x").over(w).alias("n"))


def _log_spread(spark, d):
    rows = cleaning.keep_last(market.md(spark, d)).where("bidpx0 > 0 and askpx0 > 0 and bidpx0 < 1e11 and askpx0 < 1e11").withColumn("m", F.col("bidpx0") + F.col("askpx0"))
    a = rows.where("leg = 'quoted'").select("pair_id", "day", "exchtime", "row_id", F.col("m").alias("a"))
    b = rows.where("leg = 'hedge'").select("pair_id", "exchtime", F.col("m").alias("b"))
    return a.join(b, ["pair_id", "exchtime"]).withColumn("x", F.round((F.ln("a") - F.ln("b")) * 1e6).cast("long"))


@query(market._MD + f""", q AS (SELECT row_id, {market._IT('bidpx0')} AS b, {market._IT('askpx0')} AS a FROM kept WHERE bidpx0 > 0 AND askpx0 > bidpx0 AND askpx0 < 1e11)
 SELECT row_id, array_to_string(list_transform([1, 2, 4], lambda k: CAST(b - k AS BIGINT)) || list_transform([50, 100], lambda k: CAST((a + b) // (2 * k) AS BIGINT)), ',') AS steps FROM q""")
def unwind_steps(spark, d):
    """Prices of an unwinding ladder: steps of whole ticks below the bid, and steps that are a fraction of the mid."""
    rows = cleaning.keep_last(market.md(spark, d)).where("bidpx0 > 0 and askpx0 > bidpx0 and askpx0 < 1e11")
    b, a = (ticks.in_ticks(F.col(c), F.col("tick")) for c in ("bidpx0", "askpx0"))
    rows = rows.select("row_id", b.alias("b"), a.alias("a"))
    whole = F.transform(F.array(*[F.lit(k) for k in (1, 2, 4)]), lambda k: F.col("b") - k)
    parts = F.transform(F.array(*[F.lit(k) for k in (50, 100)]), lambda k: F.expr("a + b").cast("long") - (F.expr("a + b").cast("long") % (2 * k)))
    scaled = F.zip_with(parts, F.array(F.lit(100), F.lit(200)), lambda x, k: (x / k).cast("long"))
    return rows.select("row_id", F.array_join(F.concat(whole.cast("array<string>"), scaled.cast("array<string>")), ",").alias("steps"))
