"""Queries over tables that hold what the driver's small ones don't, against their SQL."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from skriva.plans import catalogue, fixtures, formats
from skriva.sources import pdf
from skriva.streaming import bounded


def against_sql(spark, name, folder, **tables):
    import duckdb

    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def events(users):
    at = datetime.datetime(2024, 1, 1)
    n = len(users)
    return pa.table({"event_id": pa.array(range(n), pa.int64()), "ts": pa.array([at + datetime.timedelta(seconds=i) for i in range(n)], pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": ["click"] * n, "value": [1.0] * n})


def test_archives_of_more_tracks_than_a_list_has(spark, tmp_path):
    part = pa.table({"p_partkey": pa.array(range(700), pa.int64()), "p_name": [f"part {i % 9}" for i in range(700)], "p_brand": ["Brand#1" if i % 7 else "Brand#2" for i in range(700)]})
    assert len(against_sql(spark, "archive_entries", tmp_path, part=part)) == 700


def test_reports_name_the_services_of_clients_ports(spark, tmp_path):
    # a client's port is 1024 and its user's number; with clicks of these users the server's has no name
    users = [port - 1024 for port in (1433, 8443) for _ in range(20)]
    said = against_sql(spark, "capture_report", tmp_path, events=events(users))
    assert "TCP, SQL Server:" in said[0][1] and "TCP, HTTPS:" in said[0][1]


def test_bounded_tables_wait_for_what_comes_last(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bounded.capped_stream, "__defaults__", (None, 50, bounded.IDLE_MS))  # as a file of many more packets than REACH
    against_sql(spark, "flow_capped_stream", tmp_path, events=events([i * i % 397 for i in range(2000)]))


def test_reports_of_any_length_are_not_made_to_be_measured(spark, tmp_path):
    keys = pa.array([150, 151, 152], pa.int64())
    orders = pa.table({"o_orderkey": keys, "o_custkey": pa.array([7, 30_000, 400_000_000], pa.int64())})
    assert len(against_sql(spark, "reading_checks", tmp_path, orders=orders)) == 3


def test_a_line_of_a_page_is_placed_once(monkeypatch):
    made, times = [], pdf._times
    monkeypatch.setattr(pdf, "_times", lambda a, b: made.append(1) or times(a, b))
    text = "two words (and \\ more) " * 50
    ((_, _, said, kept, dropped, error),) = pdf.pages_of("x", fixtures.pdf_file([text]))
    assert (said, kept, dropped, error) == (text, len(text), 0, None) and len(made) < 20


def test_files_of_a_small_table_are_made_by_many_tasks(spark):
    rows = spark.range(1000).coalesce(1).selectExpr("cast(id as string) as path")
    made = formats.built(rows, lambda r: r["path"].encode())
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {(r["path"], bytes(r["content"])) for r in made.collect()} == {(str(i), str(i).encode()) for i in range(1000)}
