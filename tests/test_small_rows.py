"""Job snapshots, packets by day, excerpts, base addresses, texts of answers."""

import json

from pyspark.sql import functions as F

from newsdesk.functions import text, urls
from newsdesk.operators import enrichment
from newsdesk.sources import files


def test_jobs(spark, tmp_path):
    """Newest first, cut at the limit; broken files are passed over, silent running jobs are stale."""
    kept = {
        "a": ("done", "2026-01-01T00:00:00Z", "2026-01-01T00:01:00Z"),
        "b": ("running", "2026-01-03T00:00:00Z", "2026-01-03T00:00:00Z"),
        "c": ("running", "2026-01-02T00:00:00Z", "2026-01-03T00:09:00Z"),
    }
    for key, (status, started, updated) in kept.items():
        (tmp_path / f"{key}.json").write_text(json.dumps({"id": key, "status": status, "startedAt": started, "updatedAt": updated}))
    (tmp_path / "broken.json").write_text('{"id": "x", ')
    (tmp_path / "nameless.json").write_text('{"status": "done"}')
    as_of = F.lit("2026-01-03T00:10:00Z").cast("timestamp")
    got = [(r["id"], r["status"]) for r in files.jobs(spark, str(tmp_path), as_of).collect()]
    assert got == [("b", "stale"), ("c", "running"), ("a", "done")]
    assert [r["id"] for r in files.jobs(spark, str(tmp_path), as_of, 2).collect()] == ["b", "c"]
    assert len(files.jobs(spark, str(tmp_path), as_of, 0).collect()) == 1


def test_packets_replace_their_days(spark, tmp_path):
    """K2: a later batch replaces the days that it holds and leaves the others."""
    out, shape = str(tmp_path / "packets"), "site string, day string, title string"
    files.write_packets(spark.createDataFrame([("s", "2026-01-01", "old"), ("s", "2026-01-02", "stays"), ("t", "2026-01-01", "too")], shape), out)
    files.write_packets(spark.createDataFrame([("s", "2026-01-01", "new"), ("s", "2026-01-01", "more")], shape), out)
    rows = spark.read.json(out).select("site", F.col("day").cast("string"), "title").collect()
    assert sorted(map(tuple, rows)) == [("s", "2026-01-01", "more"), ("s", "2026-01-01", "new"), ("s", "2026-01-02", "stays"), ("t", "2026-01-01", "too")]


def test_excerpts_addresses_answers(spark):
    """I26, I37, I42, at their edges."""
    item = "array<struct<content:array<struct<type:string,text:string>>>>"
    answer = F.from_json(F.lit('[{"content":[{"type":"output_text","text":"a"},{"type":"refusal","text":"no"}]},{},{"content":[{"type":"output_text","text":"b"}]}]'), item)
    body = F.lit("one\n\n\n" + "x" * 600 + "\n\nthree\n\nfour")
    row = spark.range(1).select(
        text.excerpts(body).alias("found"), text.excerpts(F.lit("")).alias("none"), enrichment.answer_text(answer).alias("answer"),
        *[urls.base_url(F.lit(u)).alias(f"u{i}") for i, u in enumerate((" https://a.b/v1// ", "https://a.b", None))],
    ).first()
    assert row["found"] == ["one", "x" * 500, "three"] and row["none"] == []
    assert row["answer"] == "a\nb"
    assert [row[f"u{i}"] for i in range(3)] == ["https://a.b/v1", "https://a.b", ""]
