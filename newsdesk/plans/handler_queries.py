"""Queries on the stages' handlers, what they persist, and how their work is listed and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions import urls
from newsdesk.operators import portal, stages, store
from newsdesk.plans.flow_queries import _ORDERS, _STAGE, customers, order_status
from newsdesk.plans.registry import query, table


@query(
    f"""WITH {_ORDERS.format(stage='tag')} SELECT article_id, max(ts)::DATE::VARCHAR AS changed, string_agg(stage || '=' || status, ',' ORDER BY stage) AS stages
        FROM s JOIN a USING (article_id) GROUP BY 1 ORDER BY max(ts) DESC, article_id LIMIT 200"""
)
def stage_dashboard(spark: SparkSession, d: str) -> DataFrame:
    shown = stages.dashboard(order_status(spark, d), customers(spark, d), 1000)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat_ws("=", e["key"], e["value"]["status"])), ",")
    return shown.select("article_id", F.to_date("updated_at").cast("string").alias("changed"), text.alias("stages"))


@query(
    """WITH done AS (SELECT o_custkey AS article_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), newest AS (SELECT article_id FROM done JOIN customer ON c_custkey = article_id ORDER BY article_id DESC LIMIT 500)
       SELECT article_id FROM newest WHERE article_id % 4 <> 0 ORDER BY article_id DESC LIMIT 100"""
)
def missing_renders(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("article_id"), F.lit("render").alias("stage"), F.lit("done").alias("status")).distinct()
    name = F.concat(F.lit("infographic_"), F.col("c_custkey").cast("string"), F.lit(".dc.html"))
    there = table(spark, d, "customer").where("c_custkey % 4 = 0").select(name.alias("render_file"))
    return stages.missing_renders(done, customers(spark, d), there, 100).select("article_id")


@query(
    f"""WITH e AS (SELECT event_id, {_STAGE} AS stage, event_type <> 'error' AS ok, event_type <> 'click' AS valid, CASE WHEN event_type = 'view' THEN user_id END AS match_id FROM events),
       own AS (SELECT event_id, stage, CASE WHEN ok AND (stage <> 'enrich' OR valid) THEN 'done' ELSE 'failed' END AS status,
         CASE WHEN NOT ok THEN 'e' || event_id WHEN stage = 'enrich' AND NOT valid THEN 'Enrichment validation failed: e' || event_id END AS error FROM e)
       SELECT * FROM own UNION ALL SELECT event_id, s, 'skipped', NULL FROM e, (VALUES ('enrich'), ('render')) v(s) WHERE stage = 'dedup' AND ok AND match_id IS NOT NULL"""
)
def handler_events(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in stages.STAGES])
    kind = F.col("event_type")
    outcomes = table(spark, d, "events").select(
        F.col("event_id").alias("article_id"), F.get(names, (F.col("user_id") % 5).cast("int")).alias("stage"), (kind != "error").alias("ok"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"),
        (kind != "click").alias("valid"), F.when(kind == "view", F.col("user_id")).alias("match_id"),
    )
    return stages.outcome_events(outcomes).withColumnRenamed("article_id", "event_id")


_BATCH = """b AS (SELECT event_id AS seq, CASE WHEN event_id % 17 <> 0 THEN 'u' || user_id END AS url, CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type || '-' || event_id END AS title,
  CASE WHEN event_id % 3 = 0 THEN 't' || event_id END AS tags, CASE WHEN event_id % 3 = 0 THEN 'd' || event_id WHEN event_id % 7 = 0 THEN 'lost' END AS dedup_title,
  CASE WHEN event_id % 5 = 0 THEN 'e' || event_id END AS dedup_error FROM events),
r AS (SELECT * FROM b WHERE title <> '' AND url IS NOT NULL), o AS (SELECT 'u' || c_custkey AS url, c_name AS title, 'old' AS tags, 'od' AS dedup_title FROM customer)"""


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("event_id")
    mark = lambda p: F.concat(F.lit(p), n.cast("string"))
    batch = table(spark, d, "events").select(
        n.alias("seq"), F.when(n % 17 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("url"), F.when(n % 13 == 0, "").otherwise(F.concat_ws("-", "event_type", n.cast("string"))).alias("title"),
        F.when(n % 3 == 0, F.array(mark("t"))).alias("tags"), F.when(n % 3 == 0, mark("d")).when(n % 7 == 0, "lost").alias("dedup_title"), F.when(n % 5 == 0, mark("e")).alias("dedup_error"),
    )
    old = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("title"), F.array(F.lit("old")).alias("tags"), F.lit("od").alias("dedup_title"))
    return old, batch


@query(
    f"""WITH {_BATCH}, l AS (SELECT url, arg_max(title, seq) AS title, arg_max(tags, seq) FILTER (WHERE tags IS NOT NULL) AS tags, arg_max(dedup_title, seq) FILTER (WHERE tags IS NOT NULL) AS dedup_title FROM r GROUP BY 1)
       SELECT coalesce(l.url, o.url) AS url, coalesce(l.title, o.title) AS title, coalesce(l.tags, o.tags) AS tags, CASE WHEN l.tags IS NOT NULL THEN l.dedup_title ELSE o.dedup_title END AS dedup_title FROM o FULL JOIN l ON l.url = o.url"""
)
def persist_batch(spark: SparkSession, d: str) -> DataFrame:
    return store.persist(*_batch(spark, d))[0].withColumn("tags", F.array_join("tags", ","))


@query(
    f"""WITH {_BATCH} SELECT seq, url, CASE WHEN dedup_title IS NOT NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN dedup_title IS NULL THEN dedup_error END AS error
       FROM r WHERE dedup_title IS NOT NULL OR dedup_error IS NOT NULL"""
)
def persist_events(spark: SparkSession, d: str) -> DataFrame:
    return store.persist(*_batch(spark, d))[1].drop("stage")


@query(
    """WITH e AS (SELECT doc_id AS ordinal, 'u' || doc_id // 2 AS url, CASE WHEN doc_id % 11 <> 0 THEN source END AS title, CASE WHEN quality = 1 THEN 'enriched' END AS status, CASE WHEN doc_id % 3 = 0 THEN lang END AS provider,
         CASE WHEN doc_id % 2 = 0 THEN 'm1' END AS model FROM documents LEFT JOIN labels USING (doc_id))
       SELECT (ordinal // 2)::BIGINT AS article_id, coalesce(status, 'unknown') AS status, coalesce(provider, model) AS provider, coalesce(model, 'pm') AS model FROM e WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal DESC) = 1"""
)
def enrichment_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    packets = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        n.alias("ordinal"), F.concat(F.lit("u"), F.floor(n / 2).cast("string")).alias("url"), F.when(n % 11 != 0, F.col("source")).alias("title"), F.when(F.col("quality") == 1, "enriched").alias("status"),
        F.when(n % 3 == 0, F.col("lang")).alias("provider"), F.lit("pm").alias("provider_model"), F.when(n % 2 == 0, "m1").alias("model"), F.lit(None).cast("string").alias("error"),
    )
    articles = table(spark, d, "documents").select(F.floor(n / 2).alias("article_id")).distinct().withColumn("url", F.concat(F.lit("u"), F.col("article_id").cast("string")))
    return store.enrichment_rows(packets, articles)[0].select("article_id", "status", "provider", "model")


@query(
    f"""WITH {_ORDERS.format(stage='tag')} SELECT (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.article_id = a.article_id AND stage = 'tag')
        AND EXISTS (SELECT 1 FROM s WHERE s.article_id = a.article_id AND stage = 'distill' AND status = 'done')) AS seeded"""
)
def seeded_stage(spark: SparkSession, d: str) -> DataFrame:
    return stages.seed_stage(customers(spark, d), order_status(spark, d), "tag", F.current_timestamp())[1]


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 50)::INT AS batch FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def drained_batches(spark: SparkSession, d: str) -> DataFrame:
    """The report of one run: twenty batches of fifty are the feature."""
    work = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return stages.batches(work, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "batch")


@query(
    """WITH u AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey % 6 AS k FROM orders)
       SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN day >= DATE '1995-01-01' THEN 'thestar' END WHEN 1 THEN CASE WHEN day >= DATE '1995-01-01' THEN 'sinchew' END WHEN 2 THEN 'theedge'
         WHEN 3 THEN 'nikkei' WHEN 4 THEN CASE WHEN day >= DATE '1995-01-01' THEN 'nhk' END END AS site FROM u"""
)
def site_links(spark: SparkSession, d: str) -> DataFrame:
    o, key = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    slash, digits = F.date_format("o_orderdate", "yyyy/MM/dd"), F.date_format("o_orderdate", "yyyyMMdd")
    forms = F.array(
        F.concat(F.lit("https://www.thestar.com.my/news/"), slash, F.lit("/s")), F.concat(F.lit("https://www.sinchew.com.my/news/"), digits, F.lit("/a/"), key), F.concat(F.lit("https://theedgemalaysia.com/node/"), key),
        F.concat(F.lit("https://www.nikkei.com/article/"), key), F.concat(F.lit("https://www3.nhk.or.jp/news/html/"), digits, F.lit("/k.html")), F.concat(F.lit("https://x.example/article/"), key),
    )
    url = F.get(forms, (F.col("o_orderkey") % 6).cast("int"))
    return o.select("o_orderkey", urls.known_site_link(url, F.lit("1995-01-01").cast("date")).alias("site"))


@query("SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS place FROM orders GROUP BY 1")
def ranked_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return portal.placed(totals, [F.desc("n"), F.col("o_custkey")], "place")
