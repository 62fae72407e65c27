"""check_stressed_books on small tables with planted books, against its SQL, and how often its plan writes a book out."""

import duckdb
import pytest

from tickloom.plans import checks

SOURCE = "/root/testdata/sf0.001"
NAME = "check_stressed_books"
LEVEL = {s: [f"{s}px{i} = {{}}, {s}vol{i} = {{}}" for i in range(5)] for s in ("bid", "ask")}


def book(bids, asks):
    """SET clause of a book: per side the (price, quantity) of its levels, best first; the other levels have no quantity."""
    levels = {"bid": bids, "ask": asks}
    return ", ".join(LEVEL[s][i].format(*(levels[s][i] if i < len(levels[s]) else (0, 0))) for s in ("bid", "ask") for i in range(5))


GOOD = ([(99, 1), (98, 1)], [(101, 1), (102, 1)])
PLANTED = {  # row: the book of the first copy, of the last copy (None: there is no second one), and the code
    1: ([(10, 1), (1, 1)], [(30, 1)], None, "not_positive"),
    2: ([(99, 1), (99, 1)], [(101, 1)], None, "bid_order"),
    3: ([(99, 1)], [(101, 1), (100, 1)], None, "ask_order"),
    4: ([(101, 1)], [(99, 1)], None, "crossed"),
    5: ([(99, 1), (99, 0), (98, 1)], [(101, 1), (101, 0), (102, 1)], None, None),  # a level without quantity is none
    6: ([(99, 1), (99, "NULL"), (98, 1)], [("NULL", 1), (101, 1)], None, None),
    7: ([(1e12, 1), (99, 1)], [("CAST('nan' AS DOUBLE)", 1), (101, 1)], None, None),
    8: ([(-5, 1)], [], None, None),  # without a mid
    9: ([], [(101, 1), (100, 1)], None, None),
    10: ([(101, 1)], [(99, 1)], GOOD, None),  # the last copy decides: valid,
    11: (*GOOD, ([(101, 1)], [(99, 1)]), "crossed"),  # not valid,
    12: ([(101, 1)], [(99, 1)], ([(101, 1)], []), None),  # or without a mid
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("books"), duckdb.connect()
    con.execute(f"CREATE TABLE instruments AS SELECT * REPLACE (1.0 AS tick) FROM '{SOURCE}/instruments.parquet'")
    con.execute(f"CREATE TABLE market_data AS SELECT * REPLACE (TIMESTAMP '2019-01-07 10:00:00' + to_seconds(row_number() OVER ()) AS exchtime, row_number() OVER () AS row_id, (SELECT min(product) FROM instruments) AS contract)"
                f" FROM '{SOURCE}/market_data.parquet' LIMIT {len(PLANTED)}")
    con.execute("INSERT INTO market_data SELECT * REPLACE (row_id + 100 AS row_id) FROM market_data WHERE row_id IN (" + ", ".join(str(k) for k, v in PLANTED.items() if v[2]) + ")")
    for k, (bids, asks, last, _) in PLANTED.items():
        con.execute(f"UPDATE market_data SET {book(bids, asks)} WHERE row_id = {k}")
        if last:
            con.execute(f"UPDATE market_data SET {book(*last)} WHERE row_id = {k + 100}")
    for name in ("instruments", "market_data"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), con


def test_planted_books(spark, tables):
    folder, con = tables
    mine = sorted((r.code, r.related_id) for r in checks.QUERIES[NAME](spark, folder).collect())
    assert mine == sorted(con.execute(f"SELECT code, related_id FROM ({checks.SQL[NAME]})").fetchall())
    assert mine == sorted((code, k + 100 if last else k) for k, (_, _, last, code) in PLANTED.items() if code)


def test_given_books(spark):
    con = duckdb.connect()
    for name in ("instruments", "market_data"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SOURCE}/{name}.parquet'")
    mine = sorted((r.code, r.related_id) for r in checks.QUERIES[NAME](spark, SOURCE).collect())
    assert mine == sorted(con.execute(f"SELECT code, related_id FROM ({checks.SQL[NAME]})").fetchall())


def test_a_book_is_written_out_once(spark, tables):
    """The optimiser copies expressions into a filter that it pushes down: the plan had a side's array of levels in 74 places."""
    plan = checks.QUERIES[NAME](spark, tables[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(array(") == 2 and plan.count("transform(") == 4
