"""Late and out-of-order events, in SQL: an event-period by arrival-period triangle.

Records are summed into cells of (source, key, event minute, arrival minute); sums across the arrivals of an event
minute give every corrected revision of that minute, and cells beyond the cut-off stay out. The cells' latest event
times, cumulated across arrival minutes, are the watermark that each arrival minute begins with, so that a
record needs comparing only with the records of its own arrival minute: no window covers a key's whole history, and a key
with a third of all rows is cut into its minutes. Exact copies of ``snapshots`` are one record.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CUTOFF_S = 180

#: The start of a time's minute, without a time zone (the built-in truncation goes through the session's).
MINUTE = r"\1 - make_dt_interval(0, 0, 0, extract(SECOND FROM \1))"

#: All records with both times: src, key (contract), event and arrival time, place among equal arrivals, value, key of the row.
RECORDS = """
SELECT 'market_data' AS src, contract AS k, exchtime AS ev, `timestamp` AS arr, row_id AS ord, CAST(row_id AS STRING) AS row_key, CASE WHEN abs(lastpx) < 1e11 THEN CAST(lastpx AS DECIMAL(18, 6)) END AS v
FROM {market_data} WHERE exchtime IS NOT NULL AND `timestamp` IS NOT NULL
UNION ALL
SELECT 'snapshots', product, exchange_ts, available_at, feed_seq, snapshot_id, CAST(NULL AS DECIMAL(18, 6))
FROM (SELECT DISTINCT snapshot_id, feed_seq, product, exchange_ts, available_at FROM {snapshots} WHERE exchange_ts IS NOT NULL AND available_at IS NOT NULL)
"""

CELLS = """
SELECT src, k, {minute:ev} AS ev_minute, {minute:arr} AS arr_minute,
       count(*) AS n, count(v) AS n_v, sum(v) AS sum_v, max(ev) AS last_ev
FROM records GROUP BY 1, 2, 3, 4
"""

#: The latest event time of what arrived in earlier minutes.
WATERMARKS = """
SELECT src AS w_src, k AS w_k, arr_minute AS w_minute,
       max(last_ev) OVER (PARTITION BY src, k ORDER BY arr_minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
FROM (SELECT src, k, arr_minute, max(last_ev) AS last_ev FROM cells GROUP BY 1, 2, 3)
"""

#: Every record with what it is: null in time, else corrects or too_late.
JUDGED = """
SELECT src, row_key, k, ev, arr, v, arr_minute, {minute:ev} AS ev_minute,
       CASE WHEN m >= {minute:ev} + INTERVAL 1 MINUTE THEN CASE WHEN timestampdiff(MICROSECOND, ev, m) > {cutoff} * 1000000 THEN 'too_late' ELSE 'corrects' END END AS status
FROM (
  SELECT r.*, greatest(w.mark, max(ev) OVER (PARTITION BY src, k, arr_minute ORDER BY arr, ord, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS m
  FROM (SELECT *, {minute:arr} AS arr_minute FROM records) r
  JOIN watermarks w ON r.src = w.w_src AND r.k <=> w.w_k AND r.arr_minute = w.w_minute
)
"""

FOUND = "SELECT src, row_key, status, k, ev, arr FROM judged WHERE status IS NOT NULL"

#: Each revision: what the minute held after an arrival minute that brought records within the cut-off.
REVISIONS = """
SELECT src, k, ev_minute, arr_minute, row_number() OVER seen AS revision, sum(n) OVER upto AS n, sum(n_v) OVER upto AS n_v, sum(sum_v) OVER upto AS sum_v,
       arr_minute = max(arr_minute) OVER (PARTITION BY src, k, ev_minute) AS is_final
FROM (
  SELECT src, k, ev_minute, arr_minute, count(*) AS n, count(v) AS n_v, sum(v) AS sum_v
  FROM judged WHERE status IS DISTINCT FROM 'too_late' GROUP BY 1, 2, 3, 4
)
WINDOW seen AS (PARTITION BY src, k, ev_minute ORDER BY arr_minute), upto AS (PARTITION BY src, k, ev_minute ORDER BY arr_minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _query(market_data: DataFrame, snapshots: DataFrame, last: str, cutoff_s: int) -> DataFrame:
    spark: SparkSession = market_data.sparkSession
    steps = [("records", RECORDS), ("cells", CELLS), ("watermarks", WATERMARKS), ("judged", JUDGED), ("found", FOUND), ("revisions", REVISIONS)]
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in steps)
    ctes = re.sub(r"\{minute:(\w+)\}", MINUTE, ctes.replace("{cutoff}", str(int(cutoff_s))))
    return spark.sql(f"WITH {ctes} SELECT * FROM {last}", market_data=market_data, snapshots=snapshots)


def late_records(market_data: DataFrame, snapshots: DataFrame, cutoff_s: int = CUTOFF_S) -> DataFrame:
    """(src, row_key, status, k, ev, arr) of records that arrived after their minute had ended.

    With M the greatest event time among the records of the key that arrived before (in order of arrival time, then row_id or
    feed_seq), a record is late if M has reached the end of its minute: ``too_late`` if M is more than ``cutoff_s`` after
    its event time, else ``corrects``. Records without one of the times are none; a null key is a key of its own; copies
    under their own row_id are records, exact copies of a snapshot are one. Other columns are ignored.
    """
    return _query(market_data, snapshots, "found", cutoff_s)


def corrected_aggregates(market_data: DataFrame, snapshots: DataFrame, cutoff_s: int = CUTOFF_S) -> DataFrame:
    """(src, k, ev_minute, arr_minute, revision, n, n_v, sum_v, is_final): every revision of every minute's count and sum.

    Records that are too late are in none. ``sum_v`` sums the ``n_v`` values of ``lastpx`` under 1e11 in size
    (larger ones are no prices) exactly to six decimals; it is null where there is none (always for snapshots). A minute without records has no row.
    """
    return _query(market_data, snapshots, "revisions", cutoff_s)
