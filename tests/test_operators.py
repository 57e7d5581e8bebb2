"""Operators on small tables: folds against plain loops, snapshots, validation, files, streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import dedup, health, html, portal, ranking, research, stages, stats, store, validate
from newsdesk.sources import files, schemas

START = datetime(2024, 1, 1)


def test_stage_fold(spark):
    rng = random.Random(1)
    rows = [(k, START + timedelta(minutes=k // 2), k % 3, rng.choice(["failed"] * 4 + ["pending", "done"])) for k in range(300)]
    df = spark.createDataFrame([(*r, "e" * 600 if r[3] == "failed" else None) for r in rows], "event_id long, ts timestamp, id long, status string, error string")
    found = {r["event_id"]: r for r in stages.history(df, ["id"], "ts", ["event_id"]).collect()}
    attempts = {}
    for number, ts, key, status in rows:
        attempts[key] = 0 if status in ("done", "skipped") else attempts.get(key, 0) + (status == "failed")
        r = found[number]
        assert r["attempts"] == attempts[key]
        assert r["next_retry_at"] == (ts + timedelta(minutes=min(360, 10 * attempts[key])) if status == "failed" else None)
        assert (r["last_error"] is not None) == (status == "failed") and len(r["last_error"] or "") <= 500


def test_backoff(spark):
    found = [r[0] for r in spark.createDataFrame([(a,) for a in (1, 2, 36, 37)], "a int").select(stages.backoff_minutes(F.col("a"))).collect()]
    assert found == [10, 20, 360, 360]


def test_provider_fold(spark):
    rng = random.Random(2)
    rows = [(k, START + timedelta(seconds=k), f"p{k % 2}", rng.choice(["ok", "slow", "down", "timeout"])) for k in range(200)]
    df = spark.createDataFrame([(*r, None) for r in rows], "event_id long, ts timestamp, provider string, state string, error string")
    found = {r["event_id"]: r for r in health.call_history(df, "ts", ["event_id"]).collect()}
    memory = {}
    for number, ts, name, state in rows:
        m = memory.setdefault(name, {"fails": 0, "error": None, "recent": []})
        ok = state in ("ok", "slow")
        m["fails"] = 0 if ok else m["fails"] + 1
        m["error"] = None if state == "ok" else m["error"] if ok else state
        m["recent"] = (m["recent"] + [ok])[-20:]
        r = found[number]
        assert (r["consecutive_failures"], r["last_error"]) == (m["fails"], m["error"])
        assert abs(r["success_rate"] - sum(m["recent"]) / len(m["recent"])) < 0.0051
    empty = health.overall(df.limit(0).select("provider", "state")).first()
    assert (empty["overall"], empty["providers"]) == ("ok", 0)


def test_ranks_and_blocks(spark):
    rng = random.Random(3)
    ids = rng.sample(range(100_000), 800)
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in ids], "id long, grp string")
    ranked = ranking.rank_in_group(df, ["grp"], "id", [], 5_000)
    for part in ("a", None):
        order = sorted(i for i in ids if ("a" if i % 3 else None) == part)
        got = {r["id"]: r["rank"] for r in ranked.where(F.col("grp").eqNullSafe(F.lit(part))).collect()}
        assert [got[i] for i in order] == list(range(len(order)))
    for n, block in ((3, 50), (70, 20), (0, 7)):
        rows = ranking.in_blocks(spark.range(300).withColumnRenamed("id", "place"), "place", n, block).collect()
        for k in range(-(-300 // block)):
            own = sorted(r["place"] for r in rows if r["_block"] == k and r["_home"])
            assert own == list(range(k * block, min(300, (k + 1) * block)))
            assert sorted(r["place"] for r in rows if r["_block"] == k and not r["_home"]) == list(range(max(0, k * block - n), k * block))


def test_places_over_many_partitions(spark):
    """Every row keeps its place once, whatever the widths of the partitions and however often the result is read."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).selectExpr("id AS ordinal", "CASE WHEN id % 4 = 0 THEN 'soon' WHEN id % 3 = 0 THEN '2024-01-01' ELSE date_add(DATE'2024-01-01', int(id * 7919 % 900)) || '' END AS published", "repeat(chr(97 + id % 26), int(id % 97) * 3) AS wide")
        once = portal.placed(df.repartition(7), portal.newest_first("published"), "place")
        assert once.select(F.spark_partition_id()).distinct().count() >= 4
        twice = portal.placed(once, portal.reader_order("published"), "reader_place")
        for _ in range(2):
            rows = twice.select("ordinal", "published", "place", "reader_place", F.length("wide").alias("n")).collect()
            assert sorted(r["place"] for r in rows) == sorted(r["reader_place"] for r in rows) == list(range(60_000))
            assert all(r["n"] == r["ordinal"] % 97 * 3 for r in rows)
        millis = lambda r: 0 if r["published"] == "soon" else datetime.fromisoformat(r["published"] + "T00:00:00+00:00").timestamp()
        assert [r["ordinal"] for r in sorted(rows, key=lambda r: r["place"])] == [r["ordinal"] for r in sorted(rows, key=lambda r: (-millis(r), r["ordinal"]))]
        by_text = sorted(sorted(rows, key=lambda r: r["ordinal"]), key=lambda r: r["published"], reverse=True)
        assert [r["ordinal"] for r in sorted(rows, key=lambda r: r["reader_place"])] == [r["ordinal"] for r in by_text]
        assert twice.select(F.max("place")).first()[0] == 59_999  # the order's columns pruned
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert portal.placed(df.limit(0), [F.col("ordinal")], "place").count() == 0


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("block", [4, 64, 1000])
def test_best_recent_in_bursts(spark, block):
    """Many articles of one moment, empty gists, several groups: the same as looking at every pool."""
    rng = random.Random(5)
    rows = [(k, rng.choice(["MY", "SG", None]), rng.choice([0, 0, 0, 3600 * rng.randint(0, 90)]), " ".join(rng.sample("abcdefgh", rng.randint(0, 6)))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, country string, at long, gist string").repartition(5)
    got = {r["id"]: (r["match_id"], r["score"]) for r in dedup.best_recent(df, "id", F.lit(None).cast("string"), "country", F.timestamp_seconds("at"), F.col("gist"), block=block).collect()}
    want = {}
    for g in ("MY", "SG"):
        order = sorted((at, k, set(t.split())) for k, c, at, t in rows if c == g)
        for n, (at, k, own) in enumerate(order):
            near = [(_jaccard(own, s), a, i) for a, i, s in order[max(0, n - 20) : n] if a > at - 48 * 3600]
            if near and max(near)[0] >= 0.5:
                want[k] = (max(near)[2], max(near)[0])
    assert got == want and len(want) > 50


@pytest.mark.parametrize(("least", "tokens"), [(0.5, 40), (0.8, 250_000), (0.34, 100)])
def test_all_pairs_are_all(spark, least, tokens):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, rng.choice(["x", "y", None]), " ".join(rng.choices(words[: rng.choice([6, 40])], k=rng.randint(0, 12)))) for k in range(160)]
    df = spark.createDataFrame(rows, "id long, grp string, gist string").repartition(3)
    got = sorted(tuple(r) for r in dedup.all_pairs(df, "id", "grp", F.col("gist"), least, tokens).collect())
    first = {}
    for k, g, t in rows:
        if g and t:
            first.setdefault((g, frozenset(t.split())), k)
    sets = sorted((k, g, s) for (g, s), k in first.items())
    want = [(g, a, b, _jaccard(s, t)) for n, (a, g, s) in enumerate(sets) for b, h, t in sets[n + 1 :] if g == h and _jaccard(s, t) >= least]
    assert got == sorted(want) and want
    assert dedup.all_pairs(df.limit(0), "id", "grp", F.col("gist")).count() == 0


def test_candidates_stay_few(spark):
    """Positions leave a small part of the pairs that share a token of their prefixes, and signatures nearly all but the similar ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    sets = docs.select("lang", F.sort_array(dedup._hashed(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0).distinct().withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("lang", "grp").checkpoint()
    prefix = dedup._indexed(sets, 0.5)
    shared = prefix.alias("a").join(prefix.alias("b"), ["grp", "token"]).where("a.id < b.id AND a.size >= 0.5 * b.size AND b.size >= 0.5 * a.size").count()
    assert dedup.candidates(sets, 0.5).count() * 15 < shared


def test_best_recent(spark):
    gists = ["a b c d", "x y", "a b c e", "a b c d", "", "é"] + [f"q{k} r{k}" for k in range(20)] + ["x y"]
    df = spark.createDataFrame([(k, "g", t) for k, t in enumerate(gists)], "id long, country string, gist string")
    found = {r["id"]: (r["match_id"], r["score"]) for r in dedup.best_recent(df, "id", F.col("id").cast("string"), "country", F.timestamp_seconds(F.col("id") * 60), F.col("gist")).collect()}
    assert found == {2: (0, 0.6), 3: (0, 1.0)}  # the last one's copy is more than twenty back


def test_upserts(spark):
    old = spark.createDataFrame([("a", "t1", "x"), ("b", "t2", "y")], "url string, title string, tags string")
    new = spark.createDataFrame([("b", "u2", None), ("c", "u3", "n")], "url string, title string, tags string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(store.upsert(old, new, "url").fillna("-")) == [("a", "t1", "x"), ("b", "u2", "-"), ("c", "u3", "n")]
    assert got(store.upsert(old, new.drop("tags"), "url").fillna("-")) == [("a", "t1", "x"), ("b", "u2", "y"), ("c", "u3", "-")]
    assert got(store.patch(old, spark.createDataFrame([("a", ""), ("b", "z")], "url string, title string"), "url")) == [("a", "t1", "x"), ("b", "z", "y")]


def test_gate(spark):
    ok = dict(status="enriched", rendered_at=2, packet_at=1, url="u", body="b", title_en="e", title_zh="z", summary_en="e", summary_zh="z", ordinal=0)
    rows = [ok, ok | {"ordinal": 1, "rendered_at": 3}, ok | {"ordinal": 2, "rendered_at": 3}, ok | {"status": "failed", "rendered_at": None}, ok | {"rendered_at": None}, ok | {"rendered_at": 0, "url": ""}, ok | {"title_zh": ""}]
    kinds = "status string, rendered_at int, packet_at int, url string, body string, title_en string, title_zh string, summary_en string, summary_zh string, ordinal int"
    df = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in kinds.split(", ")) for r in rows], kinds)
    assert [r["ordinal"] for r in portal.news_list(df, ["ordinal"]).collect()] == [1]
    assert {r["reason"]: r["n"] for r in portal.skip_tally(df).collect()} == {"notEnriched": 1, "missingRender": 1, "staleMtime": 1, "missingFields": 1, "total": 4}


def test_jobs(spark):
    df = spark.createDataFrame([("running", 1, 0, START), ("succeeded", 2, 3, START), ("running", 1, 0, START - timedelta(minutes=6))], "status string, pid long, articles long, updated_at timestamp")
    got = stats.job_summary(stats.job_status(df, F.lit(START))).first()
    assert tuple(got) == (1, 1, 0, 3, 1)


def content(**changes):
    pair = {"en": "a", "zh": "中"}
    made = {
        "coreNews": {"originalTitle": "T", "displayTitle": pair, "publisher": "p", "publishedAt": "2024-01-01", "sourceUrl": "https://u", "summary": pair, "keyFacts": [{"text": pair, "sourceId": "core"}]},
        "centralInsight": pair, "keyTakeaway": pair,
        "dimensions": [{"title": pair, "relationship": "cause", "insight": pair, "supportingFacts": [{"text": pair, "sourceId": "s1", "confidence": "high"}], "metrics": [], "suggestedPresentation": "bars"}],
        "timeline": [], "whatToWatch": [], "uncertainties": [],
        "sources": [{"id": "core", "title": pair, "publisher": "p", "publishedAt": "2024-01-01", "url": "https://u"}, {"id": "s1", "title": pair, "publisher": "p", "publishedAt": "2023-01-01", "url": "http://v"}],
    }
    return json.dumps(made | changes)


def test_validator(spark):
    pair = {"en": "a", "zh": "中"}
    late = [{"id": "core", "title": pair, "publishedAt": "2024-01-01", "url": "https://u"}, {"id": "s1", "title": pair, "publishedAt": "2024-02-01", "url": "ftp://v"}, {"id": "s1", "title": {"en": "", "zh": "中"}, "url": "https://w"}]
    cases = [content(), content(sources=late), content(timeline=[{"date": "x", "event": {"en": "our country " * 10, "zh": "我国"}, "sourceId": "zz"}]), None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").withColumn("c", F.from_json("c", f"struct<{schemas.CONTENT}>"))
    got = df.select("k", validate.errors(F.col("c"), F.lit("T"), F.lit("https://u"), F.lit("2024-01-05")).alias("e"), validate.warnings(F.col("c")).alias("w")).orderBy("k").collect()
    assert got[0]["e"] == [] and got[0]["w"] == []
    assert got[1]["e"] == ['Source "s1" has an invalid URL', 'Source "s1" title is missing English (en)', 'Duplicate source ID "s1"', 'Source "s1" is newer than the 2024-01-05 research cutoff']
    assert got[2]["e"] == ['Unknown source reference "zz"']
    assert got[2]["w"] == ["timeline event (en) over 12-word target", "Unresolved first-person place deixis (我国, our country)"]
    assert got[3]["e"] == ["Enrichment must be a JSON object"]


def test_evidence(spark):
    docs = spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, "s", "cat", "high"), (1, "", "dog", "sure"), (2, "s", "x", "low")], "doc_id long, statement string, excerpt string, confidence string")
    got = sorted(tuple(r["problems"]) for r in research.evidence(claims, docs).collect())
    assert got == [(), ("no statement", "excerpt is not in the document", "unknown confidence"), ("unknown document",)]


def test_html(spark):
    page = '<title>Plain</title><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"a":1},{"headline":"H","datePublished":"2024-01-02","author":{"name":"N"}}]}</script><p>One <b>two</b><br>three<p>four</p><script>"<p>no</p>"</script>'
    got = html.article(spark.createDataFrame([(1, page)], "id int, html string"), "html").first()
    assert (got["title"], got["published_at"], got["author"], got["paragraphs"]) == ("H", "2024-01-02", "N", ["One two three", "four"])
    rows = spark.createDataFrame([("t", "b", None), ("t", "", None), (None, "b", "d")], "title string, body string, description string")
    assert [r["failure"] for r in html.valid_extraction(rows).collect()] == [None, "no text", "no title"]


def test_files(spark, tmp_path):
    (tmp_path / "crawl").mkdir()
    (tmp_path / "crawl/site-a-2024-01-02.json").write_text(json.dumps({"source": "A", "fetched_at": "x", "articles": [{"title": "t"}]}, indent=1))
    (tmp_path / "crawl/b-2024-01-03.json").write_text("{oops")
    got = {r["site"]: r for r in files.crawl_files(spark, str(tmp_path / "crawl")).collect()}
    assert (got["site-a"]["day"], got["site-a"]["count"], got["site-a"]["unreadable"], got["b"]["unreadable"]) == ("2024-01-02", 1, False, True)
    item = lambda t, u, d: f"<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate></item>"
    (tmp_path / "feed.xml").write_text("<rss><channel>" + item("new", "https://a/1?utm_source=x", "Tue, 02 Jan 2024 16:30:00 GMT") + item("old", "https://a/1", "Tue, 02 Jan 2024 16:10:00 +0000")
        + item("early", "https://a/2", "Tue, 02 Jan 2024 15:59:00 GMT") + item("odd", "https://a/3", "soon") + "</channel></rss>")
    feed = files.feed_items(spark, str(tmp_path / "feed.xml"), "2024-01-03", "Asia/Kuala_Lumpur", 10).collect()
    assert [(r["href"], r["title"]) for r in feed] == [("https://a/1", "new")]
    robots = "User-agent: Bot\nDisallow: /a # why\n# only a comment\nDisallow: /b\n\nUser-agent: *\nDisallow: /c:1\nUser-agent: x\nDisallow:"
    assert spark.range(1).select(files.robots_rules(F.lit(robots), "Bot/1.0 (x)")).first()[0] == ["/a", "/c:1", ""]
    sse = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\n'
    assert spark.range(1).select(files.sse_answer(F.lit(sse))).first()[0]["text"] == "ab"
    packet = {"articles": [{"status": "failed"}, {"status": "enriched"}, {"status": "enriched"}]}
    (tmp_path / "infographic_n.json").write_text(json.dumps(packet))
    names = files.render_names(files.packets(spark, str(tmp_path / "infographic_n.json")))
    assert sorted(r["render_file"] for r in names.collect()) == ["infographic_n-2.dc.html", "infographic_n-3.dc.html"]


def test_streams(spark, tmp_path):
    from newsdesk.streaming import state

    events = [(k, START + timedelta(minutes=k), "view" if k % 3 else "click") for k in range(28)] + [(100 + k, START + timedelta(hours=5), "view") for k in range(7)] + [(200 + k, START + timedelta(hours=9), "view") for k in range(7)]
    got = run_stream(spark, tmp_path, events, "event_id long, ts timestamp, event_type string", state.views_by_window, "views_out", "append")
    closed = {}
    for r in got:
        closed[r["event_type"]] = closed.get(r["event_type"], 0) + r["n"]
    # The last hour stays open, all before it is counted once.
    assert closed == {"click": 10, "view": 18 + 7}
    visits = [(k, START + timedelta(minutes=40 * k if k < 3 else 1), k % 2) for k in range(7)] + [(100 + k, START + timedelta(hours=9), 1) for k in range(7)]
    got = run_stream(spark, tmp_path, visits, "event_id long, ts timestamp, user_id long", state.sessions, "sessions_out", "append")
    assert sum(r["n"] for r in got) == 7


def run_stream(spark, tmp_path, rows, kinds, made, name, mode="update"):
    for k in range(0, len(rows), 7):
        spark.createDataFrame(rows[k : k + 7], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = made(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def out_of_order(rows, ts, late):
    """Rows as they may come in: each up to ``late`` minutes after newer ones."""
    rng = random.Random(8)
    return sorted(rows, key=lambda r: r[ts] + timedelta(minutes=rng.uniform(0, late)))


def test_stage_stream(spark, tmp_path):
    """Events that come late and out of order leave what the batch fold leaves; idle keys start anew."""
    from newsdesk.streaming import state

    rng = random.Random(4)
    rows = [(k, START + timedelta(minutes=k // 2), k % 3, "tag", rng.choice(["failed", "failed", "pending", "done"]), rng.choice([None, "e" * 600, f"error {k}"])) for k in range(40)]
    kinds = "event_id long, ts timestamp, article_id long, stage string, status string, error string"
    end = [(1000 + k, START + timedelta(days=1, hours=k), 99, "tag", "pending", None) for k in range(2)]
    got = run_stream(spark, tmp_path, out_of_order(rows, 1, 8) + end, kinds, lambda e: state.stage_status(e, "10 minutes", "2 days"), "stage_out")
    want = {r["article_id"]: r for r in stages.current(spark.createDataFrame(rows, kinds), ["article_id", "stage"], "ts", ["event_id"]).collect()}
    last = {r["article_id"]: r for r in got}
    for key, w in want.items():
        assert tuple(last[key][c] for c in ("event_id", "ts", "status", "attempts", "last_error", "next_retry_at")) == tuple(w[c] for c in ("event_id", "ts", "status", "attempts", "last_error", "next_retry_at"))
    assert len(got) > len(last)  # several batches told of a key


def test_idle_keys_leave_the_state(spark, tmp_path):
    from newsdesk.streaming import state

    kinds = "event_id long, ts timestamp, article_id long, stage string, status string, error string"
    fails = [(k, START + timedelta(minutes=k), 1, "tag", "failed", None) for k in range(7)]
    others = [(100 + k, START + timedelta(days=3, minutes=k), 2, "tag", "failed", None) for k in range(7)]
    again = [(200, START + timedelta(days=3, minutes=10), 1, "tag", "failed", None), (201, START + timedelta(days=4), 2, "tag", "done", None)]
    got = run_stream(spark, tmp_path, fails + others + again, kinds, lambda e: state.stage_status(e, "1 minute", "1 day"), "idle_out")
    assert [r["attempts"] for r in sorted(got, key=lambda r: r["event_id"]) if r["article_id"] == 1][-1] == 1


def test_health_stream(spark, tmp_path):
    from newsdesk.streaming import state

    rng = random.Random(2)
    calls = [(k, START + timedelta(minutes=k // 3), "ab"[k % 2], rng.choice(["ok", "down", "slow", "timeout"]), rng.choice([None, "told"])) for k in range(60)]
    kinds = "event_id long, ts timestamp, provider string, state string, error string"
    got = run_stream(spark, tmp_path, out_of_order(calls, 1, 5) + [(900, START + timedelta(days=1), "z", "ok", None)], kinds, state.provider_health, "health_out")
    last = {r["provider"]: r for r in got}
    columns = ("state", "consecutive_failures", "last_error", "last_success_at", "success_rate")
    for w in health.snapshot(spark.createDataFrame(calls, kinds), "ts", ["event_id"]).collect():
        assert tuple(last[w["provider"]][c] for c in columns) == tuple(w[c] for c in columns)


def test_job_stream(spark, tmp_path):
    """Counters as the batch fold has them, each worker's state and the last 40 events as a plain loop has them."""
    from newsdesk.operators import crawl
    from newsdesk.streaming import state

    rng = random.Random(3)
    jobs = [(f"j{k % 2}", k, START + timedelta(seconds=k), ["candidates", "started", "finished", "finished"][k // 2 % 4] if k < 98 else "complete", k, rng.choice([True, False]), f"w{rng.randint(0, 3)}" if k % 5 else None, None) for k in range(100)]
    kinds = "job string, event_id long, ts timestamp, kind string, n long, ok boolean, worker string, note string"
    end = [("z", 999, START + timedelta(days=1), "started", None, None, None, None)]
    got = run_stream(spark, tmp_path, out_of_order(jobs, 2, 0.2) + end, kinds, lambda e: state.job_progress(e, idle="2 days"), "jobs_out")
    last = {r["job"]: r for r in got}
    columns = ("candidates", "claimed", "completed", "succeeded", "failed", "status")
    for w in crawl.job_progress(spark.createDataFrame(jobs, kinds).withColumnRenamed("event_id", "seq")).collect():
        assert tuple(last[w["job"]][c] for c in columns) == tuple(w[c] for c in columns)
        own = [r for r in jobs if r[0] == w["job"]]
        workers = {r[6]: "working" if r[3] == "started" else "idle" for r in own if r[6]}
        assert last[w["job"]]["workers"] == [f"{k}={v}" for k, v in sorted(workers.items())] and last[w["job"]]["events"] == [r[1] for r in own][-40:]


def test_session_stream(spark, tmp_path):
    from newsdesk.streaming import state

    asks = [("s", k, START + timedelta(seconds=s), kind, url) for k, (s, kind, url) in enumerate([(0, "search", None), (1, "page", "a"), (2, "page", "a"), (3, "search", None), (4, "search", None), (5, "page", "b"), (6, "page", "c"), (10, "page", "d"), (11, "search", None)])]
    kinds = "session string, event_id long, ts timestamp, kind string, url string"
    end = [("z", 900, START + timedelta(hours=1), "search", None)]
    got = run_stream(spark, tmp_path, asks[::-1] + end, kinds, lambda e: state.research_session(e, max_searches=2, max_pages=2, max_ms=10_000), "research_out")
    assert [v for _, v in sorted((r["event_id"], r["verdict"]) for r in got if r["session"] == "s")] == ["ok", "ok", "duplicate", "ok", "searches", "ok", "pages", "time", "time"]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "lang", "match_id", "score"]
