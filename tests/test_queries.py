"""Each query over the driver's smallest tables against DuckDB, where the tables and its SQL are there."""

import datetime
import os

import pytest

from skriva.plans import catalogue

DIR = os.environ.get("SKRIVA_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, DIR)
    rows = [tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect()]
    if name not in catalogue.SQL:
        assert rows
        return
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert [columns[i] for i in order] == sorted(got.columns)
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_entry_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
