"""View models, sources, routing and site rules."""

import json
import re

from pyspark.sql import functions as F

from newsdesk.operators import crawl, enrichment
from newsdesk.sources import files, schemas


def pair(x):
    return {"en": x, "zh": x}


def metric(value, period=""):
    return {"label": pair("l"), "value": value, "unit": pair("u"), "period": pair(period), "sourceId": "core"}


CONTENT = {
    "coreNews": {"displayTitle": pair("A & B"), "summary": pair("s"), "keyFacts": [{"text": pair("<f>"), "sourceId": "gone"}, {"text": pair("g"), "sourceId": "core"}]},
    "dimensions": [{"title": pair("d"), "metrics": [metric(None), metric(100.0), metric(250.0)], "supportingFacts": []}, {"title": pair("e"), "metrics": [metric(2.5e6, "2024")], "supportingFacts": []}, {"title": pair("h"), "metrics": [], "supportingFacts": [{"text": pair("why")}]}],
    "sources": [{"id": "core", "url": "ftp://x", "publishedAt": "2030-01-01"}, {"id": "late", "url": "https://y", "publishedAt": "2024-05-02"}, {"id": "bad", "url": "z"}, {"id": "ok", "url": "http://v", "publishedAt": "2024-05-01"}],
}


def test_view_model(spark):
    df = spark.createDataFrame([(json.dumps(CONTENT),)], "c string").select(F.from_json("c", f"struct<{schemas.CONTENT}>").alias("c"))
    c = F.col("c")
    sources = enrichment.clean_sources(c["sources"], F.lit("2024-05-01"))
    got = df.select(
        enrichment.hero_metrics(c["dimensions"]).alias("hero"), enrichment.bar_rows(c["dimensions"][0]["metrics"]).alias("bars"), enrichment.timeline_items(c["dimensions"][1]).alias("t1"),
        enrichment.timeline_items(c["dimensions"][2]).alias("t2"), enrichment.numbered(c["dimensions"]).alias("n"), F.transform(sources, lambda s: s["id"]).alias("s"),
        enrichment.clean_references(c["coreNews"]["keyFacts"], sources).alias("facts"), enrichment.page(c).alias("page"),
    ).first()
    assert [m["value"] for m in got["hero"]] == [100.0, 2.5e6]
    assert [(b["shown"], b["percent"]) for b in got["bars"]] == [("100", 40), ("250", 100)]
    assert (got["t1"], got["t2"]) == (["2024: l"], ["why"])
    assert [(x["number"], x["last"]) for x in got["n"]] == [("01", False), ("02", False), ("03", True)]
    assert got["s"] == ["core", "ok"] and [f["sourceId"] for f in got["facts"]] == [None, "core"]
    assert "<h1>A &amp; B</h1>" in got["page"] and "<li>&lt;f&gt;</li>" in got["page"] and "<dd>2.5M</dd>" in got["page"]


def test_citations(spark):
    rows = [("url_citation", "u1", ""), ("file", "u2", "t"), ("url_citation", "u1", "again"), ("url_citation", "u3", "T")]
    df = spark.createDataFrame([([dict(zip(("type", "url", "title"), r)) for r in rows],)], "a array<struct<type:string,url:string,title:string>>")
    assert [tuple(x) for x in df.select(enrichment.citations(F.col("a"))).first()[0]] == [("u1", "u1"), ("T", "u3")]


def test_cutoff_and_filters(spark):
    df = spark.createDataFrame([("2024-01-02T23:30:00Z",), ("2024-01-02 soon",), (None,)], "p string")
    assert [r[0] for r in df.select(enrichment.cutoff_date(F.col("p"))).collect()] == ["2024-01-02", "2024-01-02", None]
    rows = spark.createDataFrame([(1, "t", "b", "u"), (2, "", "b", "u"), (3, "t", None, "u"), (4, "t", "b", "u")], "id int, title string, body string, url string")
    assert [r["id"] for r in enrichment.enrichable(rows, "id", 1).collect()] == [1] and enrichment.persistable(rows).count() == 3


def test_site_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "ok", "source": "S", "country": "MY", "latestUrl": "https://x/y", "timezone": "UTC", "articleLimit": 2, "candidateLimit": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "Bad Id", "country": "mys", "latestUrl": "x"}))
    got = {r["id"]: r["errors"] for r in files.site_configs(spark, str(tmp_path)).collect()}
    assert got["ok"] == ["candidateLimit is below articleLimit"]
    assert got["Bad Id"] == ["source is missing", "timezone is missing", "id has other characters than a-z, 0-9 and hyphens", "country is no two-letter code", "latestUrl is no web address"]
    url = F.lit("https://x/2024/2/3/slug")
    one = spark.range(1).select(crawl.url_date(url, r"/(\d{4})/(\d{1,2})/(\d{1,2})/").cast("string").alias("d"), F.unix_timestamp(crawl.loose_time(F.lit("on 2024年2月3日 08:05"))).alias("t"), crawl.loose_time(F.lit("soon")).alias("n")).first()
    assert tuple(one) == ("2024-02-03", 1706918700, None)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("s", "d1", "x"), ("s", "d2", "y")], "site string, day string, title string")
    files.write_crawl(rows, str(tmp_path / "crawl"))
    files.write_crawl(rows.where("day = 'd2'").withColumn("title", F.lit("z")), str(tmp_path / "crawl"))
    assert sorted(r["title"] for r in spark.read.json(str(tmp_path / "crawl")).collect()) == ["x", "z"]


def test_pages_are_bare_files(spark, tmp_path):
    """Ten thousand pages are ten thousand files in one folder, and an attempt that is repeated changes none."""
    at = tmp_path / "pages"
    pages = spark.range(10_000).select(F.concat(F.lit("p"), "id", F.lit(".html")).alias("render_file"), F.concat(F.lit("<p>é"), "id", F.lit("</p>")).alias("html"))
    for _ in range(2):
        manifest = files.write_pages(pages, str(at))
    held = {p.name: p.read_text() for p in at.iterdir() if p.name.endswith(".html") and not p.name.startswith(".")}
    assert held == {f"p{i}.html": f"<p>é{i}</p>" for i in range(10_000)}
    assert not [p for p in at.iterdir() if p.is_dir() and p.name != "_manifest"] and not [p for p in at.iterdir() if re.fullmatch(r"\.[0-9a-f]{32}", p.name)]
    assert manifest.count() == 10_000 and manifest.where("failure IS NOT NULL OR bytes IS NULL").count() == 0
    assert files.lost_pages(manifest, str(at)).count() == 0
    (at / "p3.html").write_text("half")
    (at / "p4.html").unlink()
    assert {r[0] for r in files.lost_pages(manifest, str(at)).collect()} == {"p3.html", "p4.html"}


def test_pages_that_fail_stop_no_other(spark, tmp_path):
    rows = [("a.html", "1", None), ("a.html", "2", None), ("b.html", None, "no title"), ("c.html", None, None), ("../d.html", "x", None), (".e", "x", None), (None, "x", None), ("x" * 300, "x", None), ("", "x", None), ("g.html", "", None)]
    got = {r["render_file"]: (r["bytes"], r["failure"]) for r in files.write_pages(spark.createDataFrame(rows, "render_file string, html string, failure string"), str(tmp_path / "p")).collect()}
    assert got["a.html"] == (1, None) and (tmp_path / "p" / "a.html").read_text() == "2" and got["g.html"] == (0, None)
    assert got["b.html"][1] == "no title" and got["c.html"][1] == "no html"
    assert [got[n][1] for n in ("../d.html", ".e", None, "")] == ["not a file name"] * 4
    assert "File name too long" in got["x" * 300][1] and not (tmp_path / "d.html").exists()
    empty = spark.createDataFrame([], "render_file string, html string")
    assert files.write_pages(empty, str(tmp_path / "none")).count() == 0
