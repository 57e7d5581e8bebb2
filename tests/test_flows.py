"""Stage handlers, persistence, listings, charsets and snapshots on small tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsdesk.functions import numbers, text, urls
from newsdesk.operators import crawl, dedup, enrichment, html, portal, stages, store
from newsdesk.sources import files


def test_recent_window(spark):
    rows = [(1, "u1", "MY", "2024-01-01 00:00:00", "a b c d"), (2, "u2", "MY", "2024-01-03 00:00:00", "a b c d"), (3, "u3", "MY", "2024-01-03 00:00:01", "a b c d x"),
            (4, "u3", "MY", "2024-01-03 01:00:00", "a b c d"), (5, "u5", "SG", "2024-01-03 01:00:00", "a b c d"), (6, "u6", "MY", None, "a b c d"), (7, "u7", None, "2024-01-03 01:00:00", "a b c d")]
    df = spark.createDataFrame(rows, "id long, url string, country string, at string, gist string").withColumn("at", F.col("at").cast("timestamp"))
    got = dedup.best_recent(df, "id", F.col("url"), "country", F.col("at"), F.col("gist")).collect()
    # 2 is 48 hours after 1, which is too late; 3 is an older row of 4's url.
    assert [(r["id"], r["match_id"], r["score"]) for r in got] == [(4, 2, 1.0)]


def test_lists_in_order(spark):
    rows = [(0, "2024-02-01", "b", 1), (1, "soon", "A", 1), (2, None, "a", 2), (3, "2024-02-01T05:00:00Z", "é", 1), (4, "", "z", 1)]
    df = spark.createDataFrame(rows, "ordinal int, published_at string, name string, total int")
    ids = lambda order: [r["ordinal"] for r in df.orderBy(*order).collect()]
    assert ids(portal.newest_first("published_at")) == [3, 0, 1, 2, 4]
    assert ids(portal.reader_order("published_at")) == [1, 3, 0, 2, 4]
    assert ids(portal.by_name("total", "name")) == [2, 1, 0, 3, 4]
    placed = portal.placed(df.repartition(3), portal.newest_first("published_at"), "place").orderBy("place").collect()
    assert [(r["place"], r["ordinal"]) for r in placed] == list(enumerate([3, 0, 1, 2, 4]))


@pytest.fixture(scope="module")
def status(spark):
    at = datetime(2024, 1, 1)
    rows = [(k, "render", "done" if k % 2 else "failed", k, None, at.replace(day=1 + k)) for k in range(8)] + [(k, "enrich", "done", 0, None, at) for k in range(8)] + [(9, "distill", "done", 0, None, at)]
    return spark.createDataFrame(rows, "article_id long, stage string, status string, attempts int, next_retry_at timestamp, updated_at timestamp")


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([(k, f"t{k}", datetime(2024, 1, 1)) for k in range(10)], "article_id long, title string, fetched_at timestamp")


def test_dashboard_and_renders(spark, status, articles):
    top = stages.dashboard(status, articles, 2).collect()
    assert [(r["article_id"], r["title"], sorted(r["stages"])) for r in top] == [(7, "t7", ["enrich", "render"]), (6, "t6", ["enrich", "render"])]
    assert stages.dashboard(status, articles, 0).count() == 1
    there = spark.createDataFrame([("infographic_7.dc.html",), ("infographic_3.dc.html",)], "render_file string")
    assert [r["article_id"] for r in stages.missing_renders(status, articles, there, 5).collect()] == [5, 1]
    assert [r["article_id"] for r in stages.missing_renders(status, articles, there, 1, over=1).collect()] == [] and stages.missing_renders(status, articles, there, 0).count() == 0
    now = F.lit("2024-02-01").cast("timestamp")
    assert sorted(r["article_id"] for r in stages.render_work(status, articles, there, now, 6).collect()) == [0, 1, 2, 4, 5, 6]
    assert stages.render_work(status, articles, there, now, 2).count() == 2
    taken = stages.batches(articles, [F.col("article_id")], size=3, most=2).collect()
    assert [(r["article_id"], r["batch"]) for r in taken] == [(k, k // 3) for k in range(6)]


def test_handlers(spark, status, articles):
    rows = [(1, "distill", True, None, None, None), (2, "dedup", True, None, None, 9), (3, "dedup", True, None, None, None), (4, "enrich", True, None, True, None), (5, "enrich", True, "x; y", False, None), (6, "tag", False, "boom", None, None)]
    df = spark.createDataFrame(rows, "article_id long, stage string, ok boolean, error string, valid boolean, match_id long")
    got = sorted((r["article_id"], r["stage"], r["status"], r["error"] or "") for r in stages.outcome_events(df).collect())
    assert got == [(1, "distill", "done", ""), (2, "dedup", "done", ""), (2, "enrich", "skipped", ""), (2, "render", "skipped", ""), (3, "dedup", "done", ""), (4, "enrich", "done", ""), (5, "enrich", "failed", "Enrichment validation failed: x; y"), (6, "tag", "failed", "boom")]
    content = spark.createDataFrame([(1, "enriched", "{}"), (2, "failed", None)], "article_id long, status string, content string")
    ready = {r["article_id"]: r["error"] for r in stages.usable_enrichments(articles.where("article_id < 4 AND article_id > 0"), content).collect()}
    assert ready[1] is None and "(status: failed)" in ready[2] and "(status: none)" in ready[3]
    after, n = stages.seed_stage(articles, status, "tag", F.lit("2024-02-01").cast("timestamp"))
    assert n.first()["seeded"] == 1 and [r["article_id"] for r in after.where("stage = 'tag' AND status = 'pending'").collect()] == [9]
    assert stages.seed_stage(articles, after, "tag", F.lit("2024-02-01").cast("timestamp"))[1].first()["seeded"] == 0


def test_persist(spark):
    old = spark.createDataFrame([("u1", "old", ["o"], "od"), ("u9", "stays", ["s"], "sd")], "url string, title string, tags array<string>, dedup_title string")
    rows = [(1, "u1", "one", ["a"], "d1", None), (2, "u1", "two", None, None, "late"), (3, "u2", "new", None, None, None), (4, "u2", "", ["no"], "x", None), (5, None, "t", None, None, None), (6, "u3", "tagged", ["t"], None, "err"), (7, "u3", "again", ["u"], None, None), (8, "u9", "moved", None, "unused", None)]
    batch = spark.createDataFrame(rows, "seq int, url string, title string, tags array<string>, dedup_title string, dedup_error string")
    after, events = store.persist(old, batch)
    assert {r["url"]: (r["title"], r["tags"], r["dedup_title"]) for r in after.collect()} == {"u1": ("two", ["a"], "d1"), "u2": ("new", None, None), "u3": ("again", ["u"], None), "u9": ("moved", ["s"], "sd")}
    assert sorted((r["seq"], r["status"], r["error"]) for r in events.collect()) == [(1, "done", None), (2, "failed", "late"), (6, "failed", "err"), (8, "done", None)]
    packets = spark.createDataFrame([("m", 1, None, "u1", "t", None, "pm", None), (None, 2, "enriched", "u1", "t", "p", "pm", None), ("m", 3, "x", "", "t", None, None, None)], "model string, ordinal int, status string, url string, title string, provider string, provider_model string, error string")
    rows, counts = store.enrichment_rows(packets, spark.createDataFrame([(5, "u1")], "article_id long, url string"))
    assert [(r["article_id"], r["status"], r["provider"], r["model"]) for r in rows.collect()] == [(5, "enriched", "p", "pm")] and tuple(counts.first()) == (2, 1)
    assert store.adapt(old, "url string, tags array<string>, added int").columns == ["url", "tags", "added"]
    with pytest.raises(ValueError):
        store.replace_chain(spark.createDataFrame([], "task string, position int, model_id long"), "t", [1, "2"])


def test_listing(spark):
    page = """<a href='/2024/01/05/x/'>One <b>two</b></a><a class=c href="https://www.a.example/y?q=1">Y</a><a href="//b.example/z">Z</a><a href="/2024/01/05/x/">again</a>
      <!-- <a href="/gone">no</a> --><a href="rel.html">R</a><a href="https://sub.a.example/s">S</a>"""
    df = spark.createDataFrame([("https://www.a.example/news/list", page)], "url string, html string")
    got = [(r["href"], r["title"]) for r in html.listing_links(df, "html", "url").orderBy("position").collect()]
    assert got == [("https://www.a.example/2024/01/05/x/", "One two"), ("https://www.a.example/y?q=1", "Y"), ("https://www.a.example/news/rel.html", "R")]
    assert html.listing_links(df, "html", "url", subdomains=True).count() == 4 and html.listing_links(df, "html", "url", limit=1).count() == 1


def test_site_rules(spark):
    since = F.lit("2024-01-02").cast("date")
    cases = {"https://www.thestar.com.my/news/2024/01/03/a": "thestar", "https://www.thestar.com.my/news/2024/01/01/a": None, "https://sinchew.com.my/news/20240105/x/12": "sinchew", "https://evil.example/news/20240105/x/12": None,
             "https://theedgemalaysia.com/node/5": "theedge", "https://www.nikkei.com/article/D/": "nikkei", "https://www3.nhk.or.jp/news/html/20240230/k.html": None, "https://www3.nhk.or.jp/news/html/20240229/k.html": "nhk", "not a url": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["s"] for r in df.select("u", urls.known_site_link(F.col("u"), since).alias("s")).collect()} == cases


def test_linked_data_graph(spark):
    page = '<script type="application/ld+json">{"@graph":[{"a":1},{"b":2},{"headline":"third"}]}</script>'
    lists = '<script type="application/ld+json">oops</script><script type="application/ld+json">[{"a":1},{"datePublished":"2024"}]</script>'
    df = spark.createDataFrame([(1, page), (2, lists), (3, "")], "id int, html string")
    got = {r["id"]: r for r in html.article(df, "html").collect()}
    assert got[1]["title"] == "third" and got[2]["published_at"] == "2024" and got[3]["published_at"] is None


def test_charsets(spark):
    word = "新闻内容"
    rows = [(1, word.encode(), ""), (2, word.encode("gbk"), ""), (3, word.encode("gbk"), "text/html; charset=GB2312"), (4, b'<meta charset="big5">' + "新聞".encode("big5"), ""), (5, b"", None), (6, "é".encode("latin-1"), "x; charset=iso-8859-1")]
    df = spark.createDataFrame([Row(k=k, content=bytearray(c), kind=t) for k, c, t in rows], "k int, content binary, kind string")
    got = {r["k"]: r["t"] for r in df.select("k", files.page_text(F.col("content"), F.col("kind")).alias("t")).collect()}
    assert got == {1: word, 2: word, 3: word, 4: '<meta charset="big5">新聞', 5: "", 6: "é"}


def test_captured_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("新闻".encode("gbk"))
    (tmp_path / "b.html").write_bytes("é新".encode())
    (tmp_path / "c.html").write_bytes(b"x" * 50)
    got = {r["path"][-6:]: r["text"] for r in files.captured_text(spark, str(tmp_path), most=40).collect()}
    assert got == {"a.html": "新闻", "b.html": "é新"}


def test_stream_answer(spark):
    frames = ['data: {"choices":[{"delta":{"content":"a"}}]}', "data:{broken", ": note", 'data: {"choices":[{"delta":{"reasoning_content":"no","content":"b"},"finish_reason":"stop"}]}', 'data: {"choices":[],"usage":{"total":3}}', "data: [DONE]"]
    got = spark.range(1).select(files.sse_answer(F.lit("\r\n".join(frames))).alias("x")).first()["x"]
    assert tuple(got) == ("ab", "stop", '{"total":3}', None)
    got = spark.range(1).select(files.sse_answer(F.lit('data: {"error":{"message":"full"}}')).alias("x")).first()["x"]
    assert tuple(got) == ("", None, None, "Stream error: full")


def test_injected_callables(spark):
    sites = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "none")], "place int, id string")

    def fetch(site):
        if site["id"] == "bad":
            raise ValueError("HTTP 403")
        return [{"url": f"{site['id']}/{k}", "title": "t"} for k in range(2)] if site["id"] == "a" else []

    got = [(r["place"], r["site"], r["article"] and r["article"]["url"], r["failure"]) for r in crawl.crawled(sites, fetch, "struct<url:string,title:string>").orderBy("place", "article.url").collect()]
    assert got == [(0, "a", "a/0", None), (0, "a", "a/1", None), (1, "bad", None, "HTTP 403"), (2, "none", None, None)]
    articles = spark.createDataFrame([(1, "x"), (2, None)], "article_id long, title string")
    made = {r["article_id"]: r for r in enrichment.answered(articles, lambda a: {"title": a["title"].upper()}, "m").collect()}
    assert json.loads(made[1]["content"]) == {"title": "X"} and made[2]["content"] is None and made[2]["error"]
    found = enrichment.recorded(articles, spark.createDataFrame([(1, "{}")], "article_id long, content string"), "m").collect()
    assert {r["article_id"]: r["error"] for r in found} == {1: None, 2: "no recorded answer"}


def test_cards(spark):
    pair = "struct<en:string,zh:string>"
    kind = f"title {pair}, suggestedPresentation string, supportingFacts array<struct<text:{pair},sourceId:string>>, metrics array<struct<label:{pair},value:double,unit:{pair}>>"
    p = lambda x: (x, x)
    rows = [(p("t"), "quote", [(p("f"), "s1"), (p("g"), None)], []), (p("t"), "map", [], [(p("m"), 2e6, p("km")), (p("n"), None, None)]), (p("t"), "chart", None, None)]
    df = spark.createDataFrame(rows, kind).select(F.struct("*").alias("d"), F.array(F.struct(F.lit("s1").alias("id"), F.lit("pub").alias("publisher"))).alias("s"))
    got = df.select(enrichment.body_kind(F.col("d")).alias("k"), enrichment.quote_card(F.col("d"), F.col("s")).alias("q"), enrichment.map_rows(F.col("d.metrics")).alias("m")).collect()
    assert [r["k"] for r in got] == ["quote", "map", "facts"] and got[0]["q"]["publisher"] == "pub" and len(got[0]["q"]["rest"]) == 1 and got[1]["q"] is None
    assert [(x["en"], x["zh"]) for x in got[1]["m"]] == [("2M km", "200万km")] and got[2]["m"] == []


def test_answers_and_repairs(spark):
    answers = {'["A b","c"]': (["a-b", "c"], None), 'Sure: {"tags":["X"],"country":"my"}': (["x"], "MY"), "```json\n[\"q\"]\n```": (["q"], None), "nothing": None}
    df = spark.createDataFrame([(k,) for k in answers], "x string")
    assert {r["x"]: r["t"] and tuple(r["t"]) for r in df.select("x", text.tagger_answer(F.col("x")).alias("t")).collect()} == answers
    nested = spark.createDataFrame([([("&lt;a", {"k": "&amp;lt;"})],)], "v array<struct<a:string,m:map<string,string>>>")
    found = nested.select(text.repair_all(F.col("v"), nested.schema["v"].dataType).alias("v")).first()["v"][0]
    assert (found["a"], found["m"]) == ("<a", {"k": "<"})
    got = spark.range(1).select(numbers.number_or(F.lit(None).cast("int"), 1), numbers.number_or(F.lit(0), 1), numbers.number_or(F.lit(5), 1), numbers.minutes_ago(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-01 00:05:30").cast("timestamp"), "cn")).first()
    assert tuple(got) == (1, 1, 5, "5分钟前")


def test_saved(spark, tmp_path):
    site = spark.createDataFrame([("a", "A", "MY", "https://a.example/", "UTC", 5, 9)], "id string, source string, country string, latestUrl string, timezone string, articleLimit int, candidateLimit int")
    files.save_site_configs(site, f"file://{tmp_path}/sites")
    files.save_site_configs(site.withColumn("id", F.lit("b")), f"file://{tmp_path}/sites")
    assert sorted(r["id"] for r in spark.read.json(f"file://{tmp_path}/sites").select("id").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        files.save_site_configs(site.withColumn("country", F.lit("x")), f"file://{tmp_path}/sites")
    files.save_packet(spark.createDataFrame([("u", "body")], "url string, body string"), f"file://{tmp_path}/packet", "body")
    saved = spark.read.json(f"file://{tmp_path}/packet")
    assert files.replay(saved, "body", "content_hash").count() == 0 and files.replay(saved.withColumn("body", F.lit("x")), "body", "content_hash").count() == 1


JOB_EVENT = "job string, event_id long, ts timestamp, kind string, n long, ok boolean, worker string, note string"


def test_job_snapshots(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("j1", 1, at, "candidates", 5, None, None, None), ("j1", 2, at, "started", None, None, "w1", "u"), ("j2", 3, at, "fail", None, None, None, "gone")]
    spark.createDataFrame(rows, JOB_EVENT).write.json(f"file://{tmp_path}/in")
    events = spark.readStream.schema(JOB_EVENT).json(f"file://{tmp_path}/in")
    run = files.write_job_snapshots(events, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    run.processAllAvailable()
    spark.createDataFrame([("j1", 4, at.replace(hour=1), "finished", None, True, "w1", None)], JOB_EVENT).write.mode("append").json(f"file://{tmp_path}/in")
    run.processAllAvailable()
    run.stop()
    found = {}
    for folder in sorted(p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")):
        found |= {r["job"]: (r["status"], r["candidates"], r["claimed"], r["succeeded"], r["workers"], r["events"]) for r in spark.read.json(f"file://{folder}").collect()}
    assert found == {"j1": ("running", 5, 1, 1, ["w1=idle"], [1, 2, 4]), "j2": ("failed", 0, 0, 0, [], [3])}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".jobs")]


def test_a_batch_that_comes_again(spark, tmp_path):
    """An attempt that fails before the rename is written anew; a published batch stays as it is."""
    path = f"file://{tmp_path}"
    rows = spark.createDataFrame([("j1", 1)], "job string, claimed int")
    rows.withColumn("batch", F.lit(7)).write.json(f"{path}/.jobs-000000007")  # what the failed attempt left
    assert files.publish_once(rows, path, 7)
    assert not files.publish_once(rows.withColumn("claimed", F.lit(2)), path, 7)
    assert [(r["job"], r["claimed"], r["batch"]) for r in spark.read.json(f"{path}/jobs-000000007").collect()] == [("j1", 1, 7)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["jobs-000000007"]




def test_feeds_of_both_kinds(spark, tmp_path):
    """Items and entries, links as text, attribute and guid, times of both forms; odd ones are passed over."""
    (tmp_path / "rss.xml").write_text("""<?xml version="1.0"?><rss xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>channel</title>
      <item><title>one &amp; only</title><link>https://a.example/1?utm_source=x#top</link><pubDate>Wed, 03 Jan 2024 10:00:00 GMT</pubDate></item>
      <item><title>guid</title><guid isPermaLink="true">https://a.example/2</guid><pubDate>3 Jan 2024 09:00:00 +0200</pubDate></item>
      <item><title>dc</title><link>https://a.example/3</link><dc:date>2024-01-03T08:00:00+00:00</dc:date></item>
      <item><title>no time</title><link>https://a.example/4</link></item><item><pubDate>Wed, 03 Jan 2024 10:00:00 GMT</pubDate></item>
      <item><link>https://a.example/5</link><pubDate>Wed, 03 Jan 2024 06:00:00 GMT</pubDate></item></channel></rss>""")
    (tmp_path / "atom.xml").write_text("""<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>
      <entry><title type="html">two links</title><link rel="self" href="https://b.example/self"/><link rel="alternate" href="https://b.example/1"/><published>2024-01-03T11:00:00Z</published><updated>2024-01-09T11:00:00Z</updated></entry>
      <entry><title>no kind</title><link href="https://b.example/2?fbclid=1"/><updated>2024-01-03T10:30:00+08:00</updated></entry>
      <entry><title>self only</title><link rel="self" href="https://b.example/3"/><updated>2024-01-03T01:00:00Z</updated></entry>
      <entry><title>again</title><link href="https://a.example/1"/><updated>2024-01-03T09:59:00Z</updated></entry>
      <entry><title>early</title><link href="https://b.example/4"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>""")
    got = files.feed_items(spark, str(tmp_path), "2024-01-03", "UTC", 20).collect()
    assert [(r["href"], r["title"], r["published_at"].strftime("%H:%M")) for r in got] == [
        ("https://b.example/1", "two links", "11:00"), ("https://a.example/1", "one & only", "10:00"), ("https://a.example/3", "dc", "08:00"), ("https://a.example/2", "guid", "07:00"),
        ("https://a.example/5", "", "06:00"), ("https://b.example/2", "no kind", "02:30"), ("https://b.example/3", "self only", "01:00"),
    ]
    assert files.feed_items(spark, str(tmp_path), "2024-01-03", "Asia/Kuala_Lumpur", 2).count() == 2


def test_route_takes_the_first_attempt(spark):
    rows = [("u", "adapter", 500, False, None, None, 2), ("u", "adapter", 403, False, None, None, 1), ("u", "generic", 200, False, "t", "b", 1), ("v", "generic", 200, False, "t", "", 1), ("v", "generic", 200, False, "t", "b", 2)]
    df = spark.createDataFrame(rows, "url string, fetcher string, status int, robots boolean, title string, body string, attempt int")
    for k in range(3):
        got = {r["url"]: (r["fetcher"], r["fallback_reason"]) for r in enrichment.route(df.repartition(k + 1)).collect()}
        assert got == {"u": (None, "blocked"), "v": (None, "no adapter")}
