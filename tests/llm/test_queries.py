"""Every query over its whole tables: columns as defined, results as independent computations give them."""

import pytest

from tests.oracle import compare, connection
from tideline.llm import queries as Q

COLUMNS = {
    "p1_found": {"sentence_id_a": "string", "sentence_id_b": "string"}, "p2_found": {"tweet_id": "string"}, "p3_found": {"src": "string", "rec_id": "string", "pii_type": "string"}, "p4_found": {"tweet_id_a": "string", "tweet_id_b": "string"},
    "p5_found": {"src": "string", "sentence_id": "string", "answer_of": "string", "defect": "string"}, "p6_found": {"cluster_id": "int", "tweet_id": "string"}, "p7_found": {"tweet_id": "string", "field": "string"}, "p9_found": {"doc_id": "bigint", "item_id": "bigint"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_over_whole_tables(spark, folder, name):
    df = Q.queries()[name](spark, folder)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(map(str, rows)))


def test_sql(spark, folder):
    con = connection(folder)
    for name, sql in Q.oracle_sql().items():
        compare(Q.queries()[name](spark, folder), con, sql)
