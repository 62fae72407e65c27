import os

import pytest

from tests.compare import DIRECTORY, connection, rows_of_spark, rows_of_sql
from tickloom.llm import plans
from tickloom.llm.encoding import default_vocabulary, tokenizer

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="the test tables are not there")


def test_queries(spark):
    duck = connection()
    for name, sql in plans.SQL.items():
        assert rows_of_spark(plans.QUERIES[name](spark, DIRECTORY)) == rows_of_sql(duck, sql)
    ids = {r.doc_id: r.ids for r in plans.QUERIES["p6_ids"](spark, DIRECTORY).collect()}
    vocabulary = tokenizer(default_vocabulary())
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert ids == {i: vocabulary.encode(t, add_special_tokens=False).ids if t else [] for i, t in texts}
    report = plans.QUERIES["p7_report"](spark, DIRECTORY).collect()
    assert abs(sum(r.actual_share for r in report) - 1) < 1e-9 and all(r.most_used <= r.max_repeats for r in report)
    assert plans.QUERIES["p8_found"](spark, DIRECTORY).count() > 0
