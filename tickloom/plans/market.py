"""Queries of cleaning, books, calendars, validation and alignment over the snapshot tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, ticks
from tickloom.operators import alignment, cleaning, validation
from tickloom.operators.regular_grid import session_windows, window_of
from tickloom.sources.tables import table

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def md(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots with an exchange time, and their instrument's terms (a fixed table of 60 rows)."""
    i = table(spark, d, "instruments", "product", "tick", "multiplier", "pair_id", "leg")
    rows = table(spark, d, "market_data").where(F.col("exchtime").isNotNull())
    return rows.join(F.broadcast(i), F.col("contract") == F.col("product")).withColumn("day", F.to_date("exchtime"))


_MD = """WITH md AS (SELECT m.*, i.tick, i.multiplier, i.pair_id, i.leg, CAST(m.exchtime AS DATE) AS day FROM market_data m JOIN instruments i ON m.contract = i.product WHERE m.exchtime IS NOT NULL),
kept AS (SELECT * FROM md QUALIFY row_number() OVER (PARTITION BY contract, exchtime ORDER BY row_id DESC) = 1),
valid AS (SELECT * FROM kept WHERE bidpx0 > 0 AND totalvol > 0)"""


@query(_MD + " SELECT row_id, contract, exchtime FROM kept")
def dedup_last(spark, d):
    return cleaning.keep_last(md(spark, d)).select("row_id", "contract", "exchtime")


_PX = [f"{s}px{i}" for s in ("bid", "ask") for i in range(5)]


@query(_MD + " SELECT row_id, CASE WHEN bidvol0 <= 0 THEN askpx0 ELSE bidpx0 END AS b0, " + ", ".join(f"CASE WHEN bidvol{i} <= 0 THEN b{i - 1} ELSE bidpx{i} END AS b{i}" for i in range(1, 5))
       + ", CASE WHEN askvol0 <= 0 THEN b0 ELSE askpx0 END AS a0, " + ", ".join(f"CASE WHEN askvol{i} <= 0 THEN a{i - 1} ELSE askpx{i} END AS a{i}" for i in range(1, 5)) + " FROM valid")
def clean_ticks(spark, d):
    out = cleaning.repaired(cleaning.valid_rows(md(spark, d)))
    return out.select("row_id", *[F.col(c).alias(c[0] + c[-1]) for c in _PX])


_INC = _MD + """, inc AS (SELECT *, CASE WHEN lag(row_id) OVER w IS NULL THEN totalvol ELSE totalvol - lag(totalvol) OVER w END AS d_vol,
  CASE WHEN lag(row_id) OVER w IS NULL THEN totalvalue ELSE totalvalue - lag(totalvalue) OVER w END AS d_value FROM valid WINDOW w AS (PARTITION BY contract, day ORDER BY exchtime, row_id)),
 priced AS (SELECT *, CASE WHEN d_vol > 0 THEN d_value / d_vol / multiplier END AS traded FROM inc)"""


def _increments(spark, d):
    return cleaning.increments(cleaning.valid_rows(md(spark, d)), by=("contract", "day")).withColumn("traded", cleaning.interval_price(F.col("d_totalvalue"), F.col("d_totalvol"), F.col("multiplier")))


@query(_INC + " SELECT row_id, d_vol, d_value, traded FROM priced")
def increments(spark, d):
    return _increments(spark, d).select("row_id", F.col("d_totalvol").alias("d_vol"), F.col("d_totalvalue").alias("d_value"), "traded")


@query(_INC + """, s AS (SELECT row_id, d_vol, traded, tick, floor(traded / tick) * tick AS p1 FROM priced WHERE traded > 0 AND traded < 1e9)
SELECT row_id, p1, p1 + tick AS p2, round_even((traded - p1) * d_vol / tick, 0) + 0.0 AS v2, round_even(d_vol - round_even((traded - p1) * d_vol / tick, 0), 0) AS v1 FROM s""")
def two_tick_split_even(spark, d):
    rows = _increments(spark, d).where((F.col("traded") > 0) & (F.col("traded") < 1e9))
    return cleaning.two_tick_split(rows, "traded", "d_totalvol", "tick").select("row_id", "p1", "p2", "v2", "v1")


@query(_INC + """, s AS (SELECT row_id, d_vol, traded, tick, floor(traded / tick) * tick AS p1 FROM priced WHERE traded > 0 AND traded < 1e9),
 t AS (SELECT *, greatest(0.0::DOUBLE, least(floor((traded - p1) * d_vol / tick + 0.5), CAST(d_vol AS DOUBLE))) AS v2 FROM s) SELECT row_id, p1, p1 + tick AS p2, v2, d_vol - v2 AS v1 FROM t""")
def two_tick_split_up(spark, d):
    rows = _increments(spark, d).where((F.col("traded") > 0) & (F.col("traded") < 1e9))
    return cleaning.two_tick_split(rows, "traded", "d_totalvol", "tick", "up").select("row_id", "p1", "p2", "v2", "v1")


@query(_MD + " SELECT row_id, last_value(lastpx IGNORE NULLS) OVER w AS lastpx, last_value(openinterest IGNORE NULLS) OVER w AS openinterest FROM kept WINDOW w AS (PARTITION BY contract, day ORDER BY exchtime, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def forward_fill(spark, d):
    return cleaning.forward_filled(cleaning.keep_last(md(spark, d)), ("lastpx", "openinterest"), ("contract", "day")).select("row_id", "lastpx", "openinterest")


_EPOCH = _MD + """, r AS (SELECT *, coalesce(CAST(totalvol < lag(totalvol) OVER w OR totalvalue < lag(totalvalue) OVER w AS INTEGER), 0) AS reset, lag(totalvol) OVER w AS pv, lag(totalvalue) OVER w AS pw
  FROM kept WINDOW w AS (PARTITION BY contract, day ORDER BY exchtime, row_id)),
 ep AS (SELECT *, sum(reset) OVER (PARTITION BY contract, day ORDER BY exchtime, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch,
  CASE WHEN reset = 0 THEN totalvol - pv END AS d_vol, CASE WHEN reset = 0 THEN totalvalue - pw END AS d_value FROM r)"""


@query(_EPOCH + " SELECT row_id, CAST(epoch AS BIGINT) AS epoch, d_vol, d_value FROM ep")
def cumulative_epochs(spark, d):
    return cleaning.epochs(cleaning.keep_last(md(spark, d))).select("row_id", "epoch", "d_vol", "d_value")


@query(_EPOCH + """, b AS (SELECT row_id, d_vol, d_value / d_vol / multiplier / tick AS x, floor(d_value / d_vol / multiplier / tick + 1e-12) AS lo FROM ep WHERE d_vol > 0 AND d_value > 0 AND d_value / d_vol / multiplier / tick < 1e15),
 u AS (SELECT *, CAST(greatest(0, least(floor((x - lo) * d_vol + 0.5), d_vol)) AS BIGINT) AS uq FROM b),
 o AS (SELECT row_id, CAST(lo AS BIGINT) AS ticks, d_vol - uq AS quantity FROM u UNION ALL SELECT row_id, CAST(lo AS BIGINT) + 1, uq FROM u)
SELECT row_id, ticks, quantity FROM o WHERE quantity > 0""")
def interval_buckets(spark, d):
    rows = cleaning.interval_buckets(cleaning.epochs(cleaning.keep_last(md(spark, d))), "tick", "multiplier")
    return rows.select("row_id", F.explode("buckets").alias("b")).select("row_id", "b.ticks", "b.quantity")


@query("SELECT row_id, (SELECT min(p) FROM (VALUES " + ", ".join(f"(bidpx{i}, bidvol{i})" for i in range(5)) + ") t(p, q) WHERE q > 0) AS low, (SELECT max(p) FROM (VALUES "
       + ", ".join(f"(askpx{i}, askvol{i})" for i in range(5)) + ") t(p, q) WHERE q > 0) AS high FROM market_data")
def depth_envelope(spark, d):
    return cleaning.depth_envelope(table(spark, d, "market_data")).select("row_id", "low", "high")


_IT = lambda c: f"CASE WHEN abs({c}) < 1e11 THEN CAST(floor({c} / tick + 0.5) AS BIGINT) END"


@query(_MD + f" SELECT row_id, {_IT('bidpx0')} AS bid_ticks, {_IT('askpx0')} AS ask_ticks, (bidpx0 + askpx0) / 2 AS mid, greatest(exchtime, \"timestamp\") AS available_at FROM md")
def quotes(spark, d):
    """Best prices in ticks, the mid and when the row became available."""
    return md(spark, d).select("row_id", ticks.in_ticks(F.col("bidpx0"), F.col("tick")).alias("bid_ticks"), ticks.in_ticks(F.col("askpx0"), F.col("tick")).alias("ask_ticks"), ((F.col("bidpx0") + F.col("askpx0")) / 2).alias("mid"), F.greatest("exchtime", "timestamp").alias("available_at"))


@query(_MD + " SELECT row_id, " + " || ',' || ".join(f"CASE WHEN abs({c}) < 1e9 THEN CASE WHEN abs({c} / tick - round({c} / tick)) <= 1e-9 THEN '0' ELSE '1' END ELSE '-' END" for c in _PX) + " AS off_grid FROM md")
def tick_grid_check(spark, d):
    """For each price whether it is off the tick grid (1), on it (0), or no price (-)."""
    def flag(c):
        x = F.col(c) / F.col("tick")
        return F.when(F.abs(F.col(c)) < 1e9, F.when(F.abs(x - F.round(x)) <= 1e-9, "0").otherwise("1")).otherwise("-")
    return md(spark, d).select("row_id", F.concat_ws(",", *[flag(c) for c in _PX]).alias("off_grid"))


@query(_MD + """ SELECT row_id, CAST(CASE WHEN askpx0 IS NULL THEN 0 ELSE coalesce(askvol0, 0) + CASE WHEN askpx1 - askpx0 <= 2 * tick + tick / 10 THEN coalesce(askvol1, 0) + CASE WHEN askpx2 - askpx0 <= 2 * tick + tick / 10 THEN coalesce(askvol2, 0)
 + CASE WHEN askpx3 - askpx0 <= 2 * tick + tick / 10 THEN coalesce(askvol3, 0) + CASE WHEN askpx4 - askpx0 <= 2 * tick + tick / 10 THEN coalesce(askvol4, 0) ELSE 0 END ELSE 0 END ELSE 0 END ELSE 0 END END AS BIGINT) AS ask_depth FROM md""")
def depth_within(spark, d):
    """Ask quantity within two ticks of the touch."""
    return md(spark, d).select("row_id", ticks.depth_within("ask", 3, F.col("tick")).alias("ask_depth"))


@query(_MD + """, lv AS (SELECT row_id, askpx0 + 2 * tick AS lim, unnest([1,2,3,4,5]) AS n, unnest(["""
       + ", ".join(f"askpx{i}" for i in range(5)) + "]) AS p, unnest([" + ", ".join(f"askvol{i}" for i in range(5)) + """]) AS q FROM md),
 ok AS (SELECT *, bool_and(coalesce(p <= lim, false)) OVER (PARTITION BY row_id ORDER BY n) AS reach FROM lv WHERE q > 0),
 cap AS (SELECT *, CASE WHEN reach THEN CAST(floor(q * 0.5) AS BIGINT) ELSE 0 END AS can FROM ok),
 run AS (SELECT *, greatest(0, least(can, 40 - coalesce(sum(can) OVER (PARTITION BY row_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM cap),
 s AS (SELECT row_id, CAST(sum(take) AS BIGINT) AS filled, CAST(count(*) FILTER (take > 0) AS INTEGER) AS used FROM run GROUP BY 1)
 SELECT md.row_id, coalesce(filled, 0) AS filled, coalesce(used, 0) AS used FROM md LEFT JOIN s USING (row_id)""")
def depth_sweep(spark, d):
    """A buy of 40 lots up to two ticks through the touch, half of each level being available."""
    rows = md(spark, d)
    swept = ticks.sweep(ticks.levels("ask"), F.lit(40), F.col("askpx0") + 2 * F.col("tick"), F.lit(True), 0.5)
    return rows.withColumn("s", swept).select("row_id", F.col("s.filled").alias("filled"), F.col("s.used").alias("used"))


def _book(side: str):
    t = ticks.in_ticks
    parts = F.array(*[F.struct(t(F.col(f"{side}px{i}"), F.col("tick")).alias("ticks"), F.col(f"{side}vol{i}").cast("long").alias("quantity")) for i in range(5)])
    return F.filter(parts, lambda x: (x["quantity"] > 0) & x["ticks"].isNotNull())


@query(_MD + ", o AS (SELECT row_id, lag(row_id) OVER (PARTITION BY contract, day ORDER BY exchtime, row_id) AS prev FROM kept), lv AS ("
       + " UNION ALL ".join(f"SELECT row_id, '{s}' AS side, {_IT(f'{s}px{i}')} AS ticks, CAST({s}vol{i} AS BIGINT) AS q FROM kept WHERE {s}vol{i} > 0 AND abs({s}px{i}) < 1e11" for s in ("bid", "ask") for i in range(5))
       + """), ch AS (SELECT o.row_id, side, ticks, q AS now, 0 AS was FROM o JOIN lv ON o.row_id = lv.row_id WHERE prev IS NOT NULL UNION ALL SELECT o.row_id, side, ticks, 0, q FROM o JOIN lv ON o.prev = lv.row_id)
SELECT row_id, side, ticks, CASE WHEN sum(was) = 0 THEN 'add' WHEN sum(now) = 0 THEN 'cancel' ELSE 'modify' END AS action, CAST(sum(now) - sum(was) AS BIGINT) AS qty_delta FROM ch GROUP BY 1, 2, 3 HAVING sum(now) <> sum(was)""")
def book_delta(spark, d):
    rows = cleaning.keep_last(md(spark, d)).select("contract", "day", "exchtime", "row_id", _book("bid").alias("bid"), _book("ask").alias("ask"))
    return cleaning.book_changes(rows)


@query(_MD + f""" SELECT row_id, CAST(floor({_IT('askpx0')} * 1.25 - 0) AS BIGINT) AS wide, CAST(ceil((ref + (ask - ref) * 1.5)) AS BIGINT) AS ask_stressed, CAST(floor((ref + (bid - ref) * 1.5)) AS BIGINT) AS bid_stressed
 FROM (SELECT *, {_IT('askpx0')} AS ask, {_IT('bidpx0')} AS bid, ({_IT('askpx0')} + {_IT('bidpx0')}) / 2.0::DOUBLE AS ref FROM md)""")
def stressed_quotes(spark, d):
    """Prices moved away from a reference by a factor: bids rounded down to a tick, asks up."""
    rows = md(spark, d).withColumns({"ask": ticks.in_ticks(F.col("askpx0"), F.col("tick")), "bid": ticks.in_ticks(F.col("bidpx0"), F.col("tick"))}).withColumn("ref", (F.col("ask") + F.col("bid")) / 2.0)
    return rows.select("row_id", F.floor(F.col("ask") * 1.25).alias("wide"), F.ceil(F.col("ref") + (F.col("ask") - F.col("ref")) * 1.5).alias("ask_stressed"), F.floor(F.col("ref") + (F.col("bid") - F.col("ref")) * 1.5).alias("bid_stressed"))


@query(_MD + """, t AS (SELECT row_id, lastpx AS px, tick, CAST(round(tick * 1000000) AS HUGEINT) AS u, CASE WHEN abs(lastpx) < 1e11 THEN CAST(round(lastpx * 1000000) AS HUGEINT) END AS p FROM md),
 s AS (SELECT *, CAST((CASE WHEN p < 0 THEN -1 ELSE 1 END) * ((2 * abs(p) + u) // (2 * u)) * u AS DOUBLE) / 1000000 AS on_grid FROM t) SELECT row_id, CASE WHEN abs(on_grid - px) <= tick / 10 THEN on_grid ELSE px END AS snapped FROM s WHERE abs(px) < 1e9""")
def tick_snap(spark, d):
    """Last prices on the tick grid (half up in decimal), where no more than a tenth of a tick off."""
    rows = md(spark, d).where(F.abs("lastpx") < 1e9)
    return rows.select("row_id", ticks.snapped(F.col("lastpx"), F.col("tick")).alias("snapped"))


@query("""SELECT row_id, CASE WHEN hour(exchtime) >= 18 THEN CAST(exchtime AS DATE) + 1 ELSE CAST(exchtime AS DATE) END AS trading_day, CAST(exchtime + INTERVAL 6 HOURS AS DATE) AS shifted_day,
 CASE WHEN hour(exchtime) >= 9 AND hour(exchtime) < 15 THEN 'day' WHEN hour(exchtime) >= 21 OR hour(exchtime) < 3 THEN 'night' ELSE 'other' END AS session,
 CAST(exchtime AS TIME) BETWEEN TIME '09:00:00' AND TIME '15:00:00' AS in_day, (CAST(exchtime AS TIME) >= TIME '21:00:00' OR CAST(exchtime AS TIME) <= TIME '03:00:00') AS in_night,
 CASE WHEN hour(exchtime) >= 18 THEN CAST(exchtime AS DATE) + 1 ELSE CAST(exchtime AS DATE) END + CASE WHEN CASE WHEN hour(exchtime) >= 18 THEN CAST(exchtime AS DATE) + 1 ELSE CAST(exchtime AS DATE) END = DATE '2019-01-08' THEN TIME '11:30:00' ELSE TIME '15:00:00' END AS eod
 FROM market_data WHERE exchtime IS NOT NULL""")
def trading_calendar(spark, d):
    t = F.col("exchtime")
    return table(spark, d, "market_data", "row_id", "exchtime").where(t.isNotNull()).select(
        "row_id", clock.trading_day(t).alias("trading_day"), clock.shifted_day(t).alias("shifted_day"), clock.session_class(t).alias("session"),
        clock.within(t, 32_400, 54_000).alias("in_day"), clock.within(t, 75_600, 10_800).alias("in_night"), clock.end_of_day(t, early={"2019-01-08": "11:30:00"}).alias("eod"),
    )


_WIN = "(SELECT min(window_order) FROM session_windows w WHERE CAST(exchtime AS TIME) >= CAST(opens_at AS TIME) AND CAST(exchtime AS TIME) < CAST(closes_at AS TIME))"


@query(f"""WITH t AS (SELECT row_id, contract, exchtime, {_WIN} AS win FROM market_data WHERE exchtime IS NOT NULL AND contract IS NOT NULL),
 l AS (SELECT *, lag(row_id) OVER w AS p, lag(win) OVER w AS pw FROM t WINDOW w AS (PARTITION BY contract, CAST(exchtime AS DATE) ORDER BY exchtime, row_id))
 SELECT row_id, contract, win, pw AS win_before FROM l WHERE p IS NOT NULL AND win IS DISTINCT FROM pw""")
def session_breaks(spark, d):
    windows = session_windows(table(spark, d, "session_windows"))
    rows = table(spark, d, "market_data", "row_id", "contract", "exchtime").where("exchtime is not null and contract is not null").withColumn("win", window_of(F.col("exchtime"), windows))
    w = Window.partitionBy("contract", F.to_date("exchtime")).orderBy("exchtime", "row_id")
    rows = rows.withColumns({"p": F.lag("row_id").over(w), "win_before": F.lag("win").over(w)})
    return rows.where(F.col("p").isNotNull() & ~F.col("win").eqNullSafe(F.col("win_before"))).select("row_id", "contract", "win", "win_before")


def _order(side: str, op: str) -> str:
    lv = "[" + ", ".join(f"{{'p': {side}px{i}, 'q': {side}vol{i}}}" for i in range(5)) + "]"
    prices = f"list_transform(list_filter({lv}, lambda x: x.q > 0), lambda x: x.p)"
    return f"len(list_filter(range(1, len({prices})), lambda i: {prices}[i + 1] {op} {prices}[i])) > 0"


_ISSUES = ("CASE WHEN i.product IS NULL THEN 'undeclared_contract' WHEN exchtime IS NULL OR \"timestamp\" IS NULL THEN 'invalid_timestamp' WHEN \"timestamp\" < exchtime THEN 'receive_before_exchange' "
           + "WHEN row_id IS NULL OR row_id < 0 THEN 'invalid_source_sequence' WHEN " + " OR ".join(f"{s}{w}{i} IS NULL" for s in ("bid", "ask") for w in ("px", "vol") for i in range(5)) + " THEN 'missing_book_field' WHEN "
           + " OR ".join(f"{s}vol{i} < 0" for s in ("bid", "ask") for i in range(5)) + " THEN 'negative_depth' WHEN bidvol0 <= 0 OR askvol0 <= 0 THEN 'zero_top_depth' WHEN " + _order("bid", ">=") + " THEN 'invalid_bid_order' WHEN "
           + _order("ask", "<=") + " THEN 'invalid_ask_order' WHEN bidpx0 >= askpx0 THEN 'crossed_book' END")


@query(f"SELECT row_id, code FROM (SELECT row_id, {_ISSUES} AS code FROM market_data m LEFT JOIN instruments i ON m.contract = i.product) WHERE code IS NOT NULL")
def validation_issues(spark, d):
    i = table(spark, d, "instruments", "product")
    rows = table(spark, d, "market_data").join(F.broadcast(i), F.col("contract") == F.col("product"), "left")  # 60 fixed rows
    return rows.select("row_id", validation.first_failing(validation.row_checks(F.col("product").isNotNull())).alias("code")).where("code is not null")


@query(_MD.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT contract, day, row_id, CAST(totalvol AS DOUBLE) AS v, totalvalue AS x, row_number() OVER (PARTITION BY contract, day ORDER BY exchtime, row_id) AS n FROM kept),
 r AS (SELECT contract, day, n, row_id, coalesce(v >= 0 AND x >= 0, false) AS accepted, CASE WHEN v >= 0 AND x >= 0 THEN v ELSE '-inf'::DOUBLE END AS bv, CASE WHEN v >= 0 AND x >= 0 THEN x ELSE '-inf'::DOUBLE END AS bx FROM s WHERE n = 1
  UNION ALL SELECT s.contract, s.day, s.n, s.row_id, coalesce(v >= greatest(0, bv) AND x >= greatest(0, bx), false), CASE WHEN v >= greatest(0, bv) AND x >= greatest(0, bx) THEN v ELSE bv END, CASE WHEN v >= greatest(0, bv) AND x >= greatest(0, bx) THEN x ELSE bx END
  FROM r JOIN s ON s.contract = r.contract AND s.day = r.day AND s.n = r.n + 1)
 SELECT row_id, accepted FROM r""")
def monotone_totals(spark, d):
    return validation.monotone_totals(cleaning.keep_last(md(spark, d)))


@query(_MD + " SELECT pair_id, exchtime AS batch_ts, min(exchtime) AS first_ts, max(exchtime) AS last_ts, count(*) AS n_rows, count(DISTINCT contract) AS n_products, count(*) > count(DISTINCT contract) AS has_repeats, count(DISTINCT contract) = 2 AS complete FROM md GROUP BY pair_id, exchtime")
def batch_seal(spark, d):
    rows = md(spark, d).withColumn("batch_ts", F.col("exchtime"))
    return validation.sealed_batches(rows, ("pair_id", "batch_ts"), "exchtime", "contract", 2)


@query(_MD + """, s AS (SELECT pair_id, day, exchtime, max(CASE WHEN leg = 'quoted' THEN row_id END) AS q, max(CASE WHEN leg = 'hedge' THEN row_id END) AS h FROM kept GROUP BY 1, 2, 3 HAVING count(*) = 2)
SELECT pair_id, exchtime, dense_rank() OVER w AS batch_seq, q AS quoted_row, h AS hedge_row, lag(q) OVER w AS quoted_before, lag(h) OVER w AS hedge_before FROM s WINDOW w AS (PARTITION BY pair_id, day ORDER BY exchtime)""")
def prev_batch(spark, d):
    """Complete batches of both legs with their ordinal in the day and the rows of the batch before."""
    rows = cleaning.keep_last(md(spark, d)).groupBy("pair_id", "day", "exchtime").agg(
        F.max(F.when(F.col("leg") == "quoted", F.col("row_id"))).alias("quoted_row"), F.max(F.when(F.col("leg") == "hedge", F.col("row_id"))).alias("hedge_row"), F.count("*").alias("n"),
    ).where("n = 2")
    w = Window.partitionBy("pair_id", "day").orderBy("exchtime")
    return rows.select("pair_id", "exchtime", F.dense_rank().over(w).cast("long").alias("batch_seq"), "quoted_row", "hedge_row", F.lag("quoted_row").over(w).alias("quoted_before"), F.lag("hedge_row").over(w).alias("hedge_before"))


@query(_MD + f""", s AS (SELECT pair_id, day, exchtime, max(CASE WHEN leg = 'quoted' THEN row_id END) AS q, max(CASE WHEN leg = 'hedge' THEN row_id END) AS h FROM kept GROUP BY 1, 2, 3),
 f AS (SELECT *, last_value(q IGNORE NULLS) OVER w AS qf, last_value(h IGNORE NULLS) OVER w AS hf FROM s WINDOW w AS (PARTITION BY pair_id, day ORDER BY exchtime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT f.pair_id, f.exchtime, q IS NOT NULL AS quoted_is_real, h IS NOT NULL AS hedge_is_real, a.askpx0 AS quoted_askpx0, b.askpx0 AS hedge_askpx0 FROM f LEFT JOIN kept a ON f.qf = a.row_id LEFT JOIN kept b ON f.hf = b.row_id""")
def pair_align_ffill(spark, d):
    return alignment.paired(cleaning.keep_last(md(spark, d)), ("quoted", "hedge"), ("pair_id", "day"), "exchtime", ("row_id", "askpx0")).select("pair_id", "exchtime", "quoted_is_real", "hedge_is_real", "quoted_askpx0", "hedge_askpx0")


@query(_MD + " SELECT a.pair_id, a.exchtime, (a.bidpx0 + a.askpx0) / 2 - (b.bidpx0 + b.askpx0) / 2 AS basis FROM kept a JOIN kept b ON a.pair_id = b.pair_id AND a.exchtime = b.exchtime AND a.leg = 'quoted' AND b.leg = 'hedge'")
def sync_two_leg(spark, d):
    rows = cleaning.keep_last(md(spark, d)).withColumn("mid", (F.col("bidpx0") + F.col("askpx0")) / 2).select("pair_id", "exchtime", "leg", "mid")
    a, b = rows.where("leg = 'quoted'"), rows.where("leg = 'hedge'").withColumnRenamed("mid", "mid_h").drop("leg")
    return a.join(b, ["pair_id", "exchtime"]).select("pair_id", "exchtime", (F.col("mid") - F.col("mid_h")).alias("basis"))


@query("""WITH f AS (SELECT DISTINCT fill_id, product, fill_ts FROM fills WHERE fill_ts IS NOT NULL AND product IS NOT NULL),
 q AS (SELECT contract, exchtime, row_id FROM market_data WHERE contract IS NOT NULL AND exchtime IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contract, exchtime ORDER BY row_id DESC) = 1)
 SELECT f.fill_id, f.fill_ts, q.exchtime AS asof_exchtime, q.row_id AS asof_row_id FROM f ASOF LEFT JOIN q ON f.product = q.contract AND f.fill_ts >= q.exchtime""")
def asof_backward(spark, d):
    """The latest book of the product at each fill."""
    fills = table(spark, d, "fills").where("fill_ts is not null and product is not null").select("fill_id", F.col("product").alias("contract"), "fill_ts").distinct()
    quotes_ = table(spark, d, "market_data", "contract", "exchtime", "row_id")
    return alignment.asof_backward(fills, quotes_, "contract", "fill_ts", "exchtime", ("row_id",), "row_id").select("fill_id", "fill_ts", "asof_exchtime", "asof_row_id")


@query("""WITH o AS (SELECT DISTINCT row_id, product, occurred_at FROM order_records WHERE occurred_at IS NOT NULL AND product IS NOT NULL),
 s AS (SELECT product, available_at, snapshot_id, feed_seq FROM snapshots WHERE kind = 'signal' AND available_at IS NOT NULL AND product IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product, available_at ORDER BY feed_seq DESC, snapshot_id DESC) = 1)
 SELECT o.row_id, s.snapshot_id AS asof_snapshot_id, s.available_at AS asof_available_at FROM o ASOF LEFT JOIN s ON o.product = s.product AND o.occurred_at >= s.available_at""")
def signal_asof(spark, d):
    """The latest available signal of the product at each order record."""
    records = table(spark, d, "order_records").where("occurred_at is not null and product is not null").select("row_id", "product", "occurred_at").distinct()
    signals = table(spark, d, "snapshots").where("kind = 'signal'").select("product", "available_at", "feed_seq", "snapshot_id").distinct()
    return alignment.asof_backward(records, signals, "product", "occurred_at", "available_at", ("snapshot_id",), "feed_seq").select("row_id", "asof_snapshot_id", "asof_available_at")


@query(_MD + """, a AS (SELECT pair_id, day, exchtime, row_id FROM kept WHERE leg = 'quoted'), b AS (SELECT pair_id, day, exchtime, row_id FROM kept WHERE leg = 'hedge'),
 p AS (SELECT a.*, b.exchtime AS bt, b.row_id AS br FROM a ASOF LEFT JOIN b ON a.pair_id = b.pair_id AND a.day = b.day AND a.exchtime >= b.exchtime),
 n AS (SELECT p.*, b.exchtime AS nt, b.row_id AS nr FROM p ASOF LEFT JOIN b ON p.pair_id = b.pair_id AND p.day = b.day AND p.exchtime <= b.exchtime),
 g AS (SELECT *, epoch_us(exchtime) - epoch_us(bt) AS back, epoch_us(nt) - epoch_us(exchtime) AS ahead FROM n)
 SELECT row_id, CASE WHEN least(back, ahead) <= 100000 THEN CASE WHEN ahead IS NULL OR back <= ahead THEN br ELSE nr END END AS near_row_id FROM g""")
def asof_nearest(spark, d):
    """The hedge leg's row nearest to each row of the quoted leg, within 100 ms."""
    rows = cleaning.keep_last(md(spark, d)).select("pair_id", "day", "exchtime", "row_id", "leg")
    return alignment.asof_nearest(rows.where("leg = 'quoted'").drop("leg"), rows.where("leg = 'hedge'").drop("leg"), ("pair_id", "day"), "exchtime", ("row_id",), "row_id", 0.1).select("row_id", "near_row_id")


@query("SELECT DISTINCT fill_id FROM fills f WHERE NOT EXISTS (SELECT 1 FROM order_records o WHERE o.order_id = f.order_id)")
def orphan_fills(spark, d):
    return table(spark, d, "fills", "fill_id", "order_id").join(table(spark, d, "order_records", "order_id"), "order_id", "left_anti").select("fill_id").distinct()


@query("""WITH ids AS (SELECT row_id, dec_ts, 'quoted' AS role, quoted_snapshot AS id FROM decisions UNION SELECT row_id, dec_ts, 'hedge', hedge_snapshot FROM decisions
 UNION SELECT row_id, dec_ts, 'signal', unnest(CAST(json(signals) AS VARCHAR[])) FROM decisions), s AS (SELECT snapshot_id, min(available_at) AS a FROM snapshots GROUP BY 1)
 SELECT row_id, role, id, CASE WHEN s.snapshot_id IS NULL THEN 'unknown_snapshot' ELSE 'not_yet_available' END AS violation FROM ids LEFT JOIN s ON ids.id = s.snapshot_id WHERE id IS NOT NULL AND (s.snapshot_id IS NULL OR s.a > dec_ts)""")
def causal_snapshots(spark, d):
    """Snapshots that a decision names and that did not exist or were not available at its time."""
    ids = F.concat(
        F.array(F.struct(F.lit("quoted").alias("role"), F.col("quoted_snapshot").alias("id")), F.struct(F.lit("hedge").alias("role"), F.col("hedge_snapshot").alias("id"))),
        F.transform(F.coalesce(F.from_json("signals", "array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("signal").alias("role"), x.alias("id"))),
    )
    named = table(spark, d, "decisions").select("row_id", "dec_ts", F.explode(ids).alias("i")).select("row_id", "dec_ts", "i.role", "i.id").where("id is not null").distinct()
    known = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.min("available_at").alias("a"))
    out = named.join(known, F.col("id") == F.col("snapshot_id"), "left").where("snapshot_id is null or a > dec_ts")
    return out.select("row_id", "role", "id", F.when(F.col("snapshot_id").isNull(), "unknown_snapshot").otherwise("not_yet_available").alias("violation"))


@query("""WITH f AS (SELECT order_id, CAST(sum(quantity) AS BIGINT) AS qty FROM (SELECT DISTINCT * FROM fills) WHERE order_id IS NOT NULL GROUP BY 1), o AS (SELECT order_id, max(filled_qty) AS qty FROM order_records WHERE order_id IS NOT NULL GROUP BY 1)
 SELECT coalesce(f.order_id, o.order_id) AS order_id, CASE WHEN o.order_id IS NULL THEN 'left_only' WHEN f.order_id IS NULL THEN 'right_only' ELSE 'differs' END AS kind, f.qty AS l_qty, o.qty AS r_qty
 FROM f FULL JOIN o ON f.order_id = o.order_id WHERE o.order_id IS NULL OR f.order_id IS NULL OR f.qty IS DISTINCT FROM o.qty""")
def reconcile_fills(spark, d):
    """Filled quantity by order: the fills against the orders' records."""
    fills = table(spark, d, "fills").distinct().where("order_id is not null").groupBy("order_id").agg(F.sum("quantity").alias("qty"))
    records = table(spark, d, "order_records", "order_id", "filled_qty").where("order_id is not null").groupBy("order_id").agg(F.max("filled_qty").alias("qty"))
    return alignment.reconciled(fills, records, ("order_id",), ("qty",))


@query(_MD + f""" SELECT row_id FROM md WHERE hour(exchtime) IN (9, 10, 13, 14, 21) AND {_IT('askpx0')} - {_IT('bidpx0')} BETWEEN 1 AND 3 AND bidvol0 >= 5 AND askvol0 >= 5""")
def entry_filter(spark, d):
    """Rows on which a taker may enter: hour, spread of one to three ticks, quantity at both touches."""
    t = ticks.in_ticks
    spread = t(F.col("askpx0"), F.col("tick")) - t(F.col("bidpx0"), F.col("tick"))
    return md(spark, d).where(F.hour("exchtime").isin(9, 10, 13, 14, 21) & spread.between(1, 3) & (F.col("bidvol0") >= 5) & (F.col("askvol0") >= 5)).select("row_id")


@query(_MD + " SELECT row_id, CAST(least(7, round_even(askvol0 * 0.5::DOUBLE, 0)) AS BIGINT) AS buys, CAST(least(7, round_even(bidvol0 * 0.5::DOUBLE, 0)) AS BIGINT) AS sells FROM md WHERE askvol0 IS NOT NULL AND bidvol0 IS NOT NULL")
def fill_or_kill(spark, d):
    """What a fill-or-kill order of seven lots gets at either touch: half of the quantity, half to even."""
    rows = md(spark, d).where("askvol0 is not null and bidvol0 is not null")
    take = lambda c: F.least(F.lit(7.0), F.bround(F.col(c) * 0.5, 0)).cast("long")
    return rows.select("row_id", take("askvol0").alias("buys"), take("bidvol0").alias("sells"))


@query("""WITH f AS (SELECT DISTINCT fill_id, product, fill_ts FROM fills WHERE fill_ts IS NOT NULL AND product IS NOT NULL),
 q AS (SELECT DISTINCT contract, exchtime FROM market_data WHERE contract IS NOT NULL AND exchtime IS NOT NULL),
 a AS (SELECT f.*, q.exchtime FROM f ASOF LEFT JOIN q ON f.product = q.contract AND f.fill_ts >= q.exchtime)
 SELECT fill_id, (epoch_us(fill_ts) - epoch_us(exchtime)) / 1e6 AS age_s FROM a WHERE exchtime IS NULL OR epoch_us(fill_ts) - epoch_us(exchtime) > 60000000""")
def stale_executions(spark, d):
    """Fills whose product had no book in the minute before, with the age of the latest one (null: none at all)."""
    fills = table(spark, d, "fills").where("fill_ts is not null and product is not null").select("fill_id", F.col("product").alias("contract"), "fill_ts").distinct()
    out = alignment.asof_backward(fills, table(spark, d, "market_data", "contract", "exchtime", "row_id"), "contract", "fill_ts", "exchtime", ("row_id",), "row_id")
    age = clock.seconds_between(F.col("asof_exchtime"), F.col("fill_ts"))
    return out.withColumn("age_s", age).where("age_s is null or age_s > 60").select("fill_id", "age_s")


@query("""SELECT o.o_orderkey, coalesce(l.label, 'unknown') AS label FROM orders o LEFT JOIN (VALUES ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('5-LOW', 'slow')) l(p, label) ON o.o_orderpriority = l.p""")
def label_lookup(spark, d):
    """A small map joined on, with a default."""
    labels = spark.createDataFrame([("1-URGENT", "fast"), ("2-HIGH", "fast"), ("5-LOW", "slow")], "p string, label string")
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return o.join(F.broadcast(labels), F.col("o_orderpriority") == F.col("p"), "left").select("o_orderkey", F.coalesce("label", F.lit("unknown")).alias("label"))  # three rows
