"""Queries on events whose times stand at half seconds and beside whole minutes, against their SQL."""

import datetime as dt

import duckdb
import pytest
from test_oracles import canonical

from newsdesk.plans import catalogue


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    at, start = tmp_path_factory.mktemp("times"), dt.datetime(2024, 1, 19, 23, 0)
    # Halves of even and odd seconds, and up to a millisecond on both sides of whole minutes.
    times = [start + dt.timedelta(seconds=k, milliseconds=500) for k in range(20)]
    times += [start + dt.timedelta(minutes=m, microseconds=us) for m in range(0, 121, 10) for us in (-1000, -501, -500, -499, -1, 0, 1, 499, 500, 501, 1000)]
    times += [dt.datetime(1969, 12, 31, 23, 59) + dt.timedelta(microseconds=us) for us in (-501, -500, -499, 499, 500, 501)]
    rows = [(k, t, k % 7, "error" if k % 6 == 0 else "view", float(k), "{}") for k, t in enumerate(times)]
    shape = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, shape).write.parquet(f"{at}/events.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["relative_times", "provider_history"])
def test_edges(spark, edges, name):
    found = catalogue.QUERIES[name](spark, edges)
    c, columns = duckdb.connect(), ", ".join(sorted(found.columns))
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{edges}/events.parquet/*.parquet'")
    wanted = c.execute(f"SELECT {columns} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert canonical(tuple(r) for r in found.select(*sorted(found.columns)).collect()) == canonical(wanted)
