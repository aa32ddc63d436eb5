import pytest

import __spark_entry__ as entry
from tidewheel.llm import queries as Q

COLUMNS = {"p5_found": ["vec_id_a", "vec_id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    assert df.columns == COLUMNS.get(name, df.columns)
    df.count()


def test_registered():
    assert set(Q.QUERIES) <= set(entry.queries())
