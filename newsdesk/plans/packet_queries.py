"""Queries on packets, crawl jobs and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators import crawl, enrichment
from newsdesk.plans.flow_queries import order_status
from newsdesk.plans.registry import query, table


@query(
    """WITH e AS (SELECT doc_id // 50 AS packet, doc_id AS ordinal, 'u' || doc_id AS url, CASE WHEN quality = 1 AND toxic = 0 THEN 'enriched' WHEN quality = 0 THEN 'failed' ELSE 'duplicate' END AS status FROM labels)
       SELECT packet, count(*)::INT AS requested, count(*) FILTER (WHERE status = 'enriched')::INT AS count, count(*) FILTER (WHERE status = 'failed')::INT AS failure_count,
         count(*) FILTER (WHERE status = 'duplicate')::INT AS duplicate_count, coalesce(string_agg(url, ',' ORDER BY ordinal) FILTER (WHERE status = 'failed'), '') AS failures,
         coalesce(string_agg(url, ',' ORDER BY ordinal) FILTER (WHERE status = 'duplicate'), '') AS duplicates FROM e GROUP BY 1"""
)
def packet_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("CASE WHEN quality = 1 AND toxic = 0 THEN 'enriched' WHEN quality = 0 THEN 'failed' ELSE 'duplicate' END")
    rows = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 50).alias("packet"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), status.alias("status"))
    found = enrichment.packet_counts(rows, "packet")
    return found.select("packet", "requested", "count", "failure_count", "duplicate_count", F.array_join("failures", ",").alias("failures"), F.array_join("duplicates", ",").alias("duplicates"))


@query(
    """WITH e AS (SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'signup' THEN 'candidates' WHEN 'view' THEN 'started' WHEN 'click' THEN 'finished' WHEN 'error' THEN 'fail' ELSE 'complete' END AS kind,
         floor(value)::BIGINT AS n, event_id % 3 <> 0 AS ok FROM events)
       SELECT job, coalesce(arg_max(n, seq) FILTER (WHERE kind = 'candidates'), 0)::INT AS candidates, count(*) FILTER (WHERE kind = 'started')::INT AS claimed,
         count(*) FILTER (WHERE kind = 'finished')::INT AS completed, count(*) FILTER (WHERE kind = 'finished' AND ok)::INT AS succeeded, count(*) FILTER (WHERE kind = 'finished' AND NOT ok)::INT AS failed,
         coalesce(arg_max(CASE WHEN kind = 'complete' THEN 'succeeded' ELSE 'failed' END, seq) FILTER (WHERE kind IN ('complete', 'fail')), 'running') AS status FROM e GROUP BY 1"""
)
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'candidates' WHEN 'view' THEN 'started' WHEN 'click' THEN 'finished' WHEN 'error' THEN 'fail' ELSE 'complete' END")
    rows = table(spark, d, "events")
    return crawl.job_progress(rows.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), kind.alias("kind"), F.floor("value").alias("n"), (F.col("event_id") % 3 != 0).alias("ok")))


@query(
    r"""WITH a(domain, adapter, place) AS (VALUES ('example.com', 'com', 1), ('example.org', 'org', 2), ('net', 'net', 3), ('example.net', 'late', 4)),
        t AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages)
        SELECT url, arg_min(adapter, place) AS adapter FROM t, a WHERE h = domain OR ends_with(h, '.' || domain) GROUP BY url"""
)
def adapter_by_host(spark: SparkSession, d: str) -> DataFrame:
    rules = [("example.com", "com", 1), ("example.org", "org", 2), ("net", "net", 3), ("example.net", "late", 4)]
    return crawl.adapter_for(table(spark, d, "pages").select("url"), spark.createDataFrame(rules, "domain string, adapter string, place int"))


@query(
    """WITH s AS (SELECT 's' || user_id % 2000 AS site, event_type = 'view' AS running FROM events)
       SELECT 's' || k AS site, bool_or(coalesce(running, FALSE)) AS busy FROM range(0, 2500) t(k) LEFT JOIN s ON s.site = 's' || k GROUP BY 1"""
)
def busy_sites(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    running = F.when(F.col("event_type") == "view", "running").otherwise("succeeded")
    jobs = table(spark, d, "events").select(name(F.col("user_id") % 2000).alias("site"), running.alias("status"))
    return crawl.busy_sites(spark.range(2500).select(name(F.col("id")).alias("site")), jobs)


@query(
    """WITH a AS (SELECT user_id % 50 AS call, event_id, event_type = 'purchase' AS ok, CASE WHEN event_type = 'error' THEN 'stop' WHEN event_type = 'view' THEN 'fail' ELSE 'retry' END AS class,
         row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events),
       f AS (SELECT * FROM a WHERE n = 1), s AS (SELECT * FROM a WHERE n = 2)
       SELECT f.call, CASE WHEN f.ok OR f.class <> 'retry' OR s.call IS NULL THEN 1 ELSE 2 END AS tries, CASE WHEN f.ok OR f.class <> 'retry' OR s.call IS NULL THEN f.ok ELSE s.ok END AS ok,
         CASE WHEN f.ok OR f.class <> 'retry' OR s.call IS NULL THEN f.class ELSE s.class END AS class FROM f LEFT JOIN s USING (call)"""
)
def retry_attempts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "stop").when(F.col("event_type") == "view", "fail").otherwise("retry")
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("call"), "event_id", (F.col("event_type") == "purchase").alias("ok"), kind.alias("class"))
    return enrichment.settled(rows, "call", "event_id")


@query(
    """WITH a AS (SELECT 'u' || p_partkey // 2 AS url, p_partkey % 2 AS k, p_size FROM part),
       m AS (SELECT url, CASE WHEN p_size % 5 = 0 THEN 403 WHEN p_size % 5 = 1 THEN 500 ELSE 200 END AS status, p_size % 7 = 0 AS robots, CASE WHEN p_size % 5 > 2 THEN 't' ELSE '' END AS title FROM a WHERE k = 0),
       g AS (SELECT url, CASE WHEN p_size % 3 > 0 THEN 't' END AS title FROM a WHERE k = 1)
       SELECT coalesce(m.url, g.url) AS url, CASE WHEN m.status IN (403, 429) OR m.robots THEN NULL WHEN m.title <> '' THEN 'adapter' WHEN g.title <> '' THEN 'generic' END AS fetcher,
         CASE WHEN m.status IN (403, 429) OR m.robots THEN 'blocked' WHEN m.title <> '' THEN NULL WHEN m.url IS NULL THEN 'no adapter' ELSE 'adapter failed' END AS fallback_reason
       FROM m FULL JOIN g ON m.url = g.url"""
)
def source_routing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    url = F.concat(F.lit("u"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("url")
    size = F.col("p_size")
    first = F.col("p_partkey") % 2 == 0
    rows = p.select(
        url, F.when(first, "adapter").otherwise("generic").alias("fetcher"), F.when(size % 5 == 0, 403).when(size % 5 == 1, 500).otherwise(200).alias("status"), (first & (size % 7 == 0)).alias("robots"),
        F.when(first, F.when(size % 5 > 2, "t").otherwise("")).otherwise(F.when(size % 3 > 0, "t")).alias("title"), F.lit("b").alias("body"),
    )
    return enrichment.route(rows)


@query(
    """SELECT DISTINCT o_custkey AS article_id, 'distill' AS stage, CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'F' THEN 'done' ELSE 'pending' END AS status, 1 AS attempts FROM
       (SELECT * FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
       UNION ALL SELECT c_custkey, 'tag', 'pending', 0 FROM customer"""
)
def reset_tag_stage(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"))
    return crawl.stage_reset(order_status(spark, d), articles)


@query("SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 AND NOT (doc_id % 3 = 0 AND doc_id % 2 = 0) ORDER BY id LIMIT 50")
def backfill_selector(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "enriched").alias("status"), F.when(F.col("doc_id") % 3 == 0, F.array("source")).alias("tags"), F.when(F.col("doc_id") % 2 == 0, "MY").otherwise("").alias("country")
    )
    return enrichment.backfill(rows, 50).select("id")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, epoch(o_orderdate::DATE + INTERVAL 10 HOUR - INTERVAL 8 HOUR)::BIGINT AS at_s FROM orders")
def loose_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days out of made-up urls and texts."""
    o = table(spark, d, "orders")
    url = F.concat(F.lit("https://a.example/"), F.date_format("o_orderdate", "yyyy/M/d"), F.lit("/slug"))
    text = F.concat(F.lit("Posted "), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(" 10:00 by x"))
    return o.select("o_orderkey", crawl.url_date(url, r"/(\d{4})/(\d{1,2})/(\d{1,2})/").cast("string").alias("day"), F.unix_timestamp(crawl.loose_time(text)).alias("at_s"))
