"""Queries against their SQL twins on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"
NAMES = ["kql_sort_limit", "kql_list_any", "hubs", "edge_rules", "edge_gaps", "duplicates", "normalize_text", "bm25_base", "diff_fields", "as_of", "sessions", "feedback_summary"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    import duckdb

    from loomgraph.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    a, b = catalog.queries()[name](spark, D).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in d[cols].itertuples(index=False))
    assert rows(a) == rows(b)
