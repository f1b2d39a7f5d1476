import pytest

import __spark_entry__ as entry


def test_entry_and_names(spark):
    found = entry.entry(spark)
    assert found.columns and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["keyword_search", "hybrid_rrf", "relevance_edges", "review_merge", "p4_found", "stream_event_counts"])
def test_queries_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from tools.compare import rows

    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    ours, theirs = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
