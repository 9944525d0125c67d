import os

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="test data not present")
def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["host", "rows", "pages"]
    rows = df.collect()
    assert len(rows) > 0 and sum(r.pages for r in rows) == 50


def test_every_query_has_a_name_and_oracle_keys_are_queries():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 60
