import pytest

from tallyfold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    assert df.columns and df.count() >= 0


def test_columns(spark, tiny):
    want = {"p1_found": ["row_id", "po_id"], "p4_found": ["po_id", "line_pos", "contract_id", "rate_pos"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind", "pii_text"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, tiny).columns == columns
