"""Queries of the data-quality operators (p1 to p5) and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.lineage import checkpointed
from tickloom.operators import anomalies, late_events, references, regular_grid
from tickloom.sources import raw_lines
from tickloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.implausible_fields(anomalies.implausible_readings(table(spark, d, "market_data")))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    flags = anomalies.implausible_readings(table(spark, d, "market_data"))
    return flags.groupBy(F.col("source").alias("contract"), "field", "kind").agg(F.count("*").alias("n"))


def _gridded(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "market_data"), regular_grid.session_windows(table(spark, d, "session_windows")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.missing_slots(_gridded(spark, d))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with readings, marks and fills."""
    return _gridded(spark, d)


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The observed part of the grid, which has a SQL twin."""
    return _gridded(spark, d).select("contract", "slot", "field", "value")


def _referring(fills: DataFrame, records: DataFrame, decisions: DataFrame, snapshots: DataFrame) -> tuple[list[references.Reference], list[references.Parent]]:
    refs = [
        references.Reference("fills.order_id", fills, "order_id", "fill_id", "fill_ts", "order_records"),
        references.Reference("fills.decision_id", fills, "decision_id", "fill_id", "fill_ts", "decisions"),
        references.Reference("fills.book_snapshot_id", fills, "book_snapshot_id", "fill_id", "fill_ts", "snapshots"),
        references.Reference("order_records.decision_id", records, "decision_id", "row_id", "occurred_at", "decisions"),
    ]
    parents = [
        references.Parent("order_records", records, "order_id", "occurred_at"),
        references.Parent("decisions", decisions, "decision_id", "dec_ts"),
        references.Parent("snapshots", snapshots.where(F.col("kind") == "book"), "snapshot_id", "available_at"),
    ]
    return refs, parents


def _referring_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("fills", "order_records", "decisions", "snapshots")]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs, parents = _referring(*_referring_tables(spark, d))
    return references.orphan_references(refs, parents, table(spark, d, "retired_keys"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "row_key", "status").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def p3_incremental(spark: SparkSession, d: str, cut: str = "2019-01-08 00:00:00") -> DataFrame:
    """``p3_found`` from a stored state: the changes before ``cut`` are kept as a table, the later ones (and those without time) merged into it."""
    tables, times, gone = _referring_tables(spark, d), ("fill_ts", "occurred_at", "dec_ts", "available_at"), table(spark, d, "retired_keys")
    early = lambda c: F.coalesce(F.col(c) < F.lit(cut).cast("timestamp_ntz"), F.lit(False))
    state = None
    for first in (True, False):
        refs, parents = _referring(*[t.where(early(c) == first) for t, c in zip(tables, times, strict=True)])
        deltas = references.changes(references.reference_rows(refs), parents, gone.where(early("retired_at") == first))
        state = checkpointed(references.key_state(deltas)) if state is None else references.apply_changes(state, deltas)
    return references.orphans_under(state, _referring(*tables)[0]).select("ref_field", "row_key", "status").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.late_records(table(spark, d, "market_data"), table(spark, d, "snapshots")).select("src", "row_key", "status")


def p4_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The sum as text of six decimals, which compares exactly."""
    out = late_events.corrected_aggregates(table(spark, d, "market_data"), table(spark, d, "snapshots"))
    return out.select("src", F.col("k").alias("contract"), "ev_minute", "arr_minute", F.col("revision").cast("long").alias("revision"), "n", "n_v", F.col("sum_v").cast("decimal(38,6)").cast("string").alias("sum_v"), "is_final")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines.rejected(table(spark, d, "raw_lines"))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines.loaded(table(spark, d, "raw_lines"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    rows = raw_lines.parsed(table(spark, d, "raw_lines"))
    return rows.groupBy("raw_file_id", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (p1_found, p1_report, p2_found, p2_grid, p2_values, p3_found, p3_report, p3_incremental, p4_found, p4_revisions, p5_found, p5_loaded, p5_report)
}

_SLOTS = """
WITH win AS (SELECT window_order, CAST(opens_at AS TIME) o, CAST(closes_at AS TIME) c FROM session_windows),
tagged AS (
  SELECT contract, CAST(exchtime AS DATE) AS d, (SELECT min(window_order) FROM win WHERE CAST(exchtime AS TIME) >= o AND CAST(exchtime AS TIME) < c) AS w,
         CAST(floor((epoch_us(exchtime) - epoch_us(date_trunc('day', exchtime))) / 10000000) AS BIGINT) AS s, exchtime, row_id, lastpx, openinterest
  FROM market_data WHERE exchtime IS NOT NULL),
slots AS (
  SELECT contract, d, w, s, arg_max(lastpx, (exchtime, row_id)) FILTER (lastpx IS NOT NULL) AS lastpx, arg_max(openinterest, (exchtime, row_id)) FILTER (openinterest IS NOT NULL) AS openinterest
  FROM tagged WHERE w IS NOT NULL GROUP BY ALL),
ends AS (SELECT contract, d, w, unnest(range(lo, hi + 1)) AS s FROM (SELECT contract, d, w, min(s) AS lo, max(s) AS hi FROM slots GROUP BY ALL)),
full_grid AS (SELECT e.contract, strftime(CAST(e.d AS TIMESTAMP) + to_seconds(10 * e.s), '%Y-%m-%d %H:%M:%S') AS slot, g.lastpx, CAST(g.openinterest AS DOUBLE) AS openinterest
  FROM ends e LEFT JOIN slots g ON e.contract IS NOT DISTINCT FROM g.contract AND e.d = g.d AND e.w = g.w AND e.s = g.s),
long AS (SELECT contract, slot, 'lastpx' AS field, lastpx AS value FROM full_grid UNION ALL SELECT contract, slot, 'openinterest', openinterest FROM full_grid)
"""

_ORPHANS = """
WITH norm AS (
  SELECT 'fills.order_id' AS ref_field, fill_id AS row_key, 'order_records' AS tab, lower(trim(order_id)) AS k, fill_ts AS t FROM fills
  UNION ALL SELECT 'fills.decision_id', fill_id, 'decisions', lower(trim(decision_id)), fill_ts FROM fills
  UNION ALL SELECT 'fills.book_snapshot_id', fill_id, 'snapshots', lower(trim(book_snapshot_id)), fill_ts FROM fills
  UNION ALL SELECT 'order_records.decision_id', row_id, 'decisions', lower(trim(decision_id)), occurred_at FROM order_records),
par AS (
  SELECT tab, k, min(t) AS born, true AS has FROM (
    SELECT 'order_records' AS tab, lower(trim(order_id)) AS k, occurred_at AS t FROM order_records
    UNION ALL SELECT 'decisions', lower(trim(decision_id)), dec_ts FROM decisions
    UNION ALL SELECT 'snapshots', lower(trim(snapshot_id)), available_at FROM snapshots WHERE kind = 'book') GROUP BY ALL),
ret AS (SELECT ref_table AS tab, lower(trim(ref_key)) AS k, min(retired_at) AS gone, true AS was FROM retired_keys GROUP BY ALL),
judged AS (
  SELECT DISTINCT n.ref_field, n.row_key, n.tab AS ref_table, n.k AS ref_key, n.t, CASE WHEN r.gone <= n.t THEN 'deleted' WHEN p.has IS NULL AND r.was IS NULL THEN 'missing' WHEN p.born > n.t THEN 'late' END AS status
  FROM norm n LEFT JOIN par p ON n.tab = p.tab AND n.k = p.k LEFT JOIN ret r ON n.tab = r.tab AND n.k = r.k
  WHERE n.k IS NOT NULL AND n.k <> '')
"""

_LATE = """
WITH records AS (
  SELECT 'market_data' AS src, contract AS k, exchtime AS ev, "timestamp" AS arr, row_id AS ord, CAST(row_id AS VARCHAR) AS row_key, CASE WHEN abs(lastpx) < 1e11 THEN CAST(lastpx AS DECIMAL(18, 6)) END AS v
  FROM market_data WHERE exchtime IS NOT NULL AND "timestamp" IS NOT NULL
  UNION ALL
  SELECT 'snapshots', product, exchange_ts, available_at, feed_seq, snapshot_id, NULL
  FROM (SELECT DISTINCT snapshot_id, feed_seq, product, exchange_ts, available_at FROM snapshots WHERE exchange_ts IS NOT NULL AND available_at IS NOT NULL)),
marked AS (SELECT *, max(ev) OVER (PARTITION BY src, k ORDER BY arr, ord, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM records),
judged AS (SELECT *, CASE WHEN m >= date_trunc('minute', ev) + INTERVAL 1 MINUTE THEN CASE WHEN epoch_us(m) - epoch_us(ev) > 180000000 THEN 'too_late' ELSE 'corrects' END END AS status FROM marked)
"""

_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_CHECKS = {
    "clock": r"(regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?') AND try_cast(x[:19] AS TIMESTAMP) IS NOT NULL)",
    "double": f"(regexp_full_match(x, '{_NUM}') AND isfinite(try_cast(x AS DOUBLE)))",
    "value": f"(regexp_full_match(x, '{_NUM}') AND isfinite(try_cast(x AS DOUBLE)) AND try_cast(x AS DOUBLE) >= 0)",
    "int": "(regexp_full_match(x, '[+-]?[0-9]+') AND try_cast(x AS INTEGER) >= 0)",
    "long": "(regexp_full_match(x, '[+-]?[0-9]+') AND try_cast(x AS BIGINT) >= 0)",
}


def _kind(c: str) -> str:
    return "clock" if c in raw_lines.CLOCKS else "value" if c == "totalvalue" else "double" if c in raw_lines.DOUBLES else "int" if c in raw_lines.INTS else "long"


_LINES = rf"""
WITH body AS (SELECT line_id, coalesce(line, '') AS line FROM raw_lines WHERE raw_row_ordinal IS NULL OR raw_row_ordinal <> 0),
quoted AS (SELECT *, regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS fine FROM body),
cut AS (SELECT *, CASE WHEN fine THEN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1) END AS f FROM quoted),
fields AS (SELECT *, list_transform(f, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) AS g FROM cut),
judged AS (SELECT line_id, CASE WHEN NOT fine THEN 'quoting' WHEN len(g) <> {len(raw_lines.COLUMNS)} THEN 'column_count'
  WHEN NOT ({" AND ".join(f"(g[{i + 1}] = '' OR coalesce(" + _CHECKS[_kind(c)].replace("(x,", f"(g[{i + 1}],").replace("(x[", f"(g[{i + 1}][").replace("(x ", f"(g[{i + 1}] ") + ", false))" for i, c in enumerate(raw_lines.COLUMNS))}) THEN 'invalid_value' END AS reason FROM fields)
"""

_GROUPS = " OR ".join(f"(k = {k} AND len(arr) >= {k + 2} AND CASE WHEN field <> 'totalvol' THEN len(list_filter(arr[2:{k + 1}], lambda x: abs(x - arr[1]) > 25 * step AND abs(x - arr[{k + 2}]) > 25 * step)) = {k}"
                      f" ELSE arr[1] <= arr[{k + 2}] AND (list_max(arr[2:{k + 1}]) < arr[1] OR list_min(arr[2:{k + 1}]) > arr[{k + 2}]) END)" for k in range(1, 7))
_IMPLAUSIBLE = f"""
WITH md AS (SELECT row_id, contract, CAST(exchtime AS DATE) AS d, exchtime AS t, bidpx0, askpx0, lastpx, CAST(totalvol AS DOUBLE) AS totalvol FROM market_data WHERE exchtime IS NOT NULL),
long AS (SELECT row_id, contract, d, t, 'bidpx0' AS field, bidpx0 AS v FROM md UNION ALL SELECT row_id, contract, d, t, 'askpx0', askpx0 FROM md UNION ALL SELECT row_id, contract, d, t, 'lastpx', lastpx FROM md UNION ALL SELECT row_id, contract, d, t, 'totalvol', totalvol FROM md),
rd AS (SELECT contract, d, field, t, arg_min(v, row_id) AS v FROM long WHERE v IS NOT NULL GROUP BY ALL),
seq AS (SELECT *, row_number() OVER w AS n, lag(v) OVER w AS pv, list(v) OVER (PARTITION BY contract, d, field ORDER BY t ROWS BETWEEN 1 PRECEDING AND 6 FOLLOWING) AS arr FROM rd WINDOW w AS (PARTITION BY contract, d, field ORDER BY t)),
steps AS (SELECT contract, field, median(abs(v - pv)) AS step FROM seq WHERE pv IS NOT NULL AND v <> pv GROUP BY 1, 2),
hits AS (SELECT contract, d, field, unnest(range(n, n + k)) AS n FROM (SELECT s.*, st.step, unnest([1, 2, 3, 4, 5, 6]) AS k FROM seq s JOIN steps st ON s.contract IS NOT DISTINCT FROM st.contract AND s.field = st.field WHERE s.n > 1) q WHERE {_GROUPS}),
runs AS (SELECT contract, d, field, min(n) AS n1, max(n) AS n2, min(t) AS t1, max(t) AS t2 FROM (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY contract, d, field ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM seq) GROUP BY contract, d, field, g HAVING count(*) >= 25),
lively AS (SELECT r.contract, r.d, r.field, r.n1, r.n2 FROM runs r JOIN md m ON r.contract IS NOT DISTINCT FROM m.contract AND r.d = m.d AND m.t BETWEEN r.t1 AND r.t2 GROUP BY ALL
  HAVING (r.field = 'bidpx0' OR count(DISTINCT bidpx0) >= 5) AND (r.field = 'askpx0' OR count(DISTINCT askpx0) >= 5) AND (r.field = 'lastpx' OR count(DISTINCT lastpx) >= 5) AND (r.field = 'totalvol' OR count(DISTINCT totalvol) >= 5)),
cases AS (SELECT contract, d, field, n FROM seq WHERE CASE WHEN field = 'totalvol' THEN v < 0 ELSE v <= 0 END UNION SELECT * FROM hits UNION SELECT contract, d, field, unnest(range(n1 + 1, n2 + 1)) FROM lively)
SELECT DISTINCT l.row_id, l.field FROM cases c JOIN seq s ON c.contract IS NOT DISTINCT FROM s.contract AND c.d = s.d AND c.field = s.field AND c.n = s.n
JOIN long l ON l.contract IS NOT DISTINCT FROM s.contract AND l.d = s.d AND l.field = s.field AND l.t = s.t AND l.v IS NOT NULL
"""

_KINDS = (
    _IMPLAUSIBLE.replace("cases AS (SELECT contract, d, field, n FROM", "cases AS (SELECT contract, d, field, n, 'impossible' AS kind FROM").replace("UNION SELECT * FROM hits", "UNION SELECT contract, d, field, n, 'spike' FROM hits")
    .replace("unnest(range(n1 + 1, n2 + 1)) FROM lively", "unnest(range(n1 + 1, n2 + 1)), 'stuck' FROM lively").replace("SELECT DISTINCT l.row_id, l.field FROM cases c", "SELECT contract, field, kind, count(*) AS n FROM (SELECT DISTINCT l.row_id, l.contract, l.field, c.kind FROM cases c")
    + ") GROUP BY 1, 2, 3"
)


def _value(i: int, c: str) -> str:
    text, kind = f"nullif(g[{i + 1}], '')", _kind(c)
    if kind == "clock":
        return f"CAST(left({text}, 26) AS TIMESTAMP)"
    return f"CAST({text} AS {'INTEGER' if kind == 'int' else 'BIGINT' if kind == 'long' else 'DOUBLE'})"


SQL: dict[str, str] = {
    "p1_found": _IMPLAUSIBLE,
    "p1_report": _KINDS,
    "p5_loaded": _LINES + ", fine_lines AS (SELECT f.line_id, f.g FROM fields f JOIN judged j USING (line_id) WHERE j.reason IS NULL) SELECT line_id, raw_file_id, raw_row_ordinal, " + ", ".join(f'{_value(i, c)} AS "{c}"' for i, c in enumerate(raw_lines.COLUMNS)) + " FROM fine_lines JOIN raw_lines USING (line_id)",
    "p2_found": _SLOTS + "SELECT contract, slot, field FROM long WHERE value IS NULL",
    "p2_values": _SLOTS + "SELECT contract, slot, field, value FROM long",
    "p3_found": _ORPHANS + "SELECT DISTINCT ref_field, row_key, status FROM judged WHERE status IS NOT NULL",
    "p3_incremental": _ORPHANS + "SELECT DISTINCT ref_field, row_key, status FROM judged WHERE status IS NOT NULL",
    "p3_report": _ORPHANS + "SELECT ref_field, ref_table, CAST(t AS DATE) AS period, status, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM judged WHERE status IS NOT NULL GROUP BY ALL",
    "p4_found": _LATE + "SELECT src, row_key, status FROM judged WHERE status IS NOT NULL",
    "p4_revisions": _LATE + """, cells AS (
  SELECT src, k, date_trunc('minute', ev) AS ev_minute, date_trunc('minute', arr) AS arr_minute, count(*) AS n, count(v) AS n_v, sum(v) AS s
  FROM judged WHERE status IS DISTINCT FROM 'too_late' GROUP BY ALL)
SELECT src, k AS contract, ev_minute, arr_minute, row_number() OVER w AS revision, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(n_v) OVER w AS BIGINT) AS n_v, CAST(CAST(sum(s) OVER w AS DECIMAL(38, 6)) AS VARCHAR) AS sum_v,
       arr_minute = max(arr_minute) OVER (PARTITION BY src, k, ev_minute) AS is_final
FROM cells WINDOW w AS (PARTITION BY src, k, ev_minute ORDER BY arr_minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "p5_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_report": _LINES + "SELECT raw_file_id, coalesce(reason, 'loaded') AS outcome, count(*) AS n FROM judged JOIN raw_lines USING (line_id) GROUP BY ALL",
}
