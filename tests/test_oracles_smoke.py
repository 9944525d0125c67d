"""A few registered queries against their DuckDB oracles on sf0.001 (the
full comparison is tools/check_oracles.py)."""

import math
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["S06_csv_documents", "S10_sheet_cells", "P05_absolute_links", "P16_fingerprints", "T01_natural_sort",
         "V04_search_counts", "N01_nth_of_type"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    f = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(f(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["customer", "documents", "events", "pages", "part", "orders"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(cur.fetchall(), dcols)
