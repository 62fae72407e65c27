"""Every check between the tables on small tables with one planted fault each, against its SQL."""

import duckdb
import pytest

from tickloom.plans import checks

SOURCE = "/root/testdata/sf0.001"
FAULTS = {
    "decisions": ["UPDATE t SET row_id = 'run-00:other' WHERE decision_id = (SELECT min(decision_id) FROM t)", "UPDATE t SET signals = '[\"nowhere\"]' WHERE decision_id = (SELECT max(decision_id) FROM t)",
                  "UPDATE t SET hedge_snapshot = quoted_snapshot WHERE decision_id = (SELECT max(decision_id) FROM t)"],
    "order_records": ["UPDATE t SET row_id = replace(row_id, ':declared', ':x') WHERE row_id = (SELECT min(row_id) FROM t WHERE record_type = 'order_declared')", "UPDATE t SET requested_qty = 0 WHERE row_id = (SELECT max(row_id) FROM t WHERE record_type = 'order_declared')",
                      "UPDATE t SET filled_qty = 999 WHERE row_id = (SELECT min(row_id) FROM t WHERE lifecycle_state = 'partially_filled')", "UPDATE t SET limit_price = limit_price * 1.00037 WHERE row_id = (SELECT min(row_id) FROM t WHERE limit_price IS NOT NULL)"],
    "fills": ["UPDATE t SET product = 'NJ-next' WHERE fill_id = (SELECT min(fill_id) FROM t)", "UPDATE t SET quantity = 999, position_delta = -position_delta WHERE fill_id = (SELECT max(fill_id) FROM t)"],
    "snapshots": ["UPDATE t SET artifact_path = 'elsewhere' WHERE snapshot_id = (SELECT min(snapshot_id) FROM t)", "UPDATE t SET snapshot_hash = 'md5:1' WHERE snapshot_id = (SELECT max(snapshot_id) FROM t)", "UPDATE t SET kind = 'book' WHERE kind = 'signal'"],
}
WANTED = {
    "check_capacity": {"released_more"}, "check_identity": {"decision_row_id", "declared_row_id", "artifact", "hash_form"}, "check_depth_use": {"missing_snapshot"}, "check_conservation": {"over_request", "against_side", "order_product"},
    "check_order_rows": {"residual_sum", "off_tick"}, "check_signals": {"unknown_signal", "not_a_signal", "same_book"}, "check_quote_in_depth": {"quote_off_depth"},
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("faulty"), duckdb.connect()
    for name in ("decisions", "order_records", "fills", "snapshots", "instruments", "market_data"):
        con.execute(f"CREATE OR REPLACE TABLE t AS SELECT * FROM '{SOURCE}/{name}.parquet'")
        for fault in FAULTS.get(name, []):
            con.execute(fault)
        con.execute(f"COPY t TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", sorted(WANTED))
def test_planted_faults_are_found(spark, tables, name):
    folder, con = tables
    mine = sorted(tuple(r[c] for c in ("code", "related_id")) for r in checks.QUERIES[name](spark, folder).collect())
    assert mine == sorted(con.execute(f"SELECT code, related_id FROM ({checks.SQL[name]})").fetchall())
    assert WANTED[name] <= {code for code, _ in mine}
