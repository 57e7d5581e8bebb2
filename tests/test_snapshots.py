"""Versioned tables: atomic versions, conflicts, point reads, replays."""

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import store
from newsdesk.sources.snapshots import Conflict, Snapshots


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.col("id").alias("n"))
    return Snapshots.create(rows, str(tmp_path / "articles"), "url", 8)


def upsert(old, batch):
    return store.upsert(old, batch, "url")


def test_versions_and_reads(spark, table):
    batch = spark.createDataFrame([("u1", -1), ("new", 7)], "url string, n long")
    assert table.merge(batch, upsert) == 2
    want = sorted([(f"u{i}", -1 if i == 1 else i) for i in range(100)] + [("new", 7)])
    assert rows_of(table.read()) == want
    assert rows_of(table.read(1)) == sorted((f"u{i}", i) for i in range(100))
    before, after = table.version(1), table.version(2)
    touched = set(after.changed)
    assert 1 <= len(touched) <= 2 and all(before.writes[c] == after.writes[c] for c in before.writes if c not in touched)
    assert rows_of(table.get("u1", "u5", "none")) == [("u1", -1), ("u5", 5)]
    assert rows_of(table.lookup(spark.createDataFrame([("u2",), ("u2",), (None,), ("x",)], "url string"))) == [("u2", 2)]


def test_point_reads_open_one_cell_and_push_the_filter(spark, table):
    got = table.get("u7")
    assert len(got.inputFiles()) == 1 and len(table.read().inputFiles()) == 8
    assert "EqualTo(url,u7)" in got._jdf.queryExecution().executedPlan().toString()


def test_two_writers_of_one_cell(spark, table):
    """The second commits while the first computes: the first is told, and nothing of it shows."""
    batch = spark.createDataFrame([("u1", -1)], "url string, n long")

    def slow(old, rows):
        table.merge(spark.createDataFrame([("u1", -2)], "url string, n long"), upsert)
        return upsert(old, rows)

    with pytest.raises(Conflict):
        table.merge(batch, slow)
    assert table.numbers() == [1, 2] and rows_of(table.get("u1")) == [("u1", -2)]
    named = set(table.version(1).writes.values()) | set(table.version(2).writes.values())
    held = {s.getPath().getName().removeprefix("write=") for s in table._files.listStatus(table._at(f"{table.path}/data"))}
    assert held == named


def test_two_writers_of_other_cells(spark, table):
    cell = {r["url"]: r["c"] for r in table.read().select("url", F.pmod(F.xxhash64("url"), F.lit(8)).alias("c")).collect()}
    one = "u1"
    two = next(u for u in sorted(cell) if cell[u] != cell[one])
    batch = lambda url, n: spark.createDataFrame([(url, n)], "url string, n long")

    def slow(old, rows):
        table.merge(batch(two, -2), upsert)
        return upsert(old, rows)

    assert table.merge(batch(one, -1), slow) == 3
    assert rows_of(table.get(one, two)) == sorted([(one, -1), (two, -2)]) and table.read().count() == 100


def test_a_version_is_whole_or_absent(spark, table, monkeypatch):
    """A writer that is lost before its rename leaves the readers what they had; vacuum removes its files."""
    monkeypatch.setattr(Snapshots, "_published", lambda self, version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([("u1", -1)], "url string, n long"), upsert)
    monkeypatch.undo()
    assert table.numbers() == [1] and rows_of(table.get("u1")) == [("u1", 1)]
    assert table.vacuum(keep=1, hours=1000) == 0 and table.vacuum(keep=1, hours=0) == 1
    assert table.read().count() == 100


def test_streams_write_a_batch_once(spark, table):
    more = lambda old, batch: store.upsert(old, old.select("url", (F.col("n") + 1).alias("n")).join(batch, "url", "left_semi"), "url")
    batch = spark.createDataFrame([("u3",)], "url string")
    for number in (0, 0, 1, 0, 1):
        table.merge(batch, more, once=("job", number))
    assert rows_of(table.get("u3")) == [("u3", 5)] and table.version().done == {"job": 1}


def test_columns_and_keys(spark, table):
    wider = spark.createDataFrame([("u1", 1, "x")], "url string, n long, tag string")
    table.merge(wider, lambda old, b: old.join(b.select("url", "tag"), "url", "left"))
    assert rows_of(table.get("u1", "u2")) == [("u1", 1, "x"), ("u2", 2, None)]
    with pytest.raises(ValueError, match="tag"):
        table.merge(wider, lambda old, b: old.drop("tag"))
    with pytest.raises(ValueError, match="doesn't hold"):
        table.merge(wider, lambda old, b: old.unionByName(spark.range(50).select(F.col("id").cast("string").alias("url"), F.lit(1).cast("long").alias("n"), F.lit("").alias("tag"))))
    with pytest.raises(Exception, match="no key"):
        table.replace(spark.createDataFrame([(None, 1)], "url string, n long"))
    table.replace(spark.createDataFrame([("a", "b")], "url string, n string"))
    assert rows_of(table.read()) == [("a", "b")]
    table.replace(table.read().limit(0))
    assert rows_of(table.read()) == [] and rows_of(table.get("a")) == []
    with pytest.raises(Conflict):
        Snapshots.create(wider, table.path, "url", 4)
