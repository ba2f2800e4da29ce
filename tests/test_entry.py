import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the test tables aren't here")


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "id" and df.count() > 0


def test_sql_has_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_sql_agrees(spark):
    """A few queries and their SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    for name in ("class_report", "join_lookup_cascade", "temporal_normalize", "extract_records", "extract_annotations", "split_stratified", "text_clean_body"):
        df = e.queries()[name](spark, D)
        r = con.execute(e.oracle_sql()[name])
        cols = [c[0] for c in r.description]
        got = sorted(str([x[c] for c in cols]) for x in df.collect())
        assert got == sorted(str([float(v) if type(v).__name__ == "Decimal" else v for v in x]) for x in r.fetchall()), name
