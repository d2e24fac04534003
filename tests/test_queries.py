"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from foliant.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        made.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return made


def rows(frame):
    def plain(x):
        return "null" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), list(frame.columns)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    ours, ours_columns = rows(catalogue.QUERIES[name](spark, str(DATA)).toPandas())
    theirs, columns = rows(con.execute(catalogue.ORACLE_SQL[name]).df())
    assert ours_columns == columns
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "page_num", "score", "kind"]
