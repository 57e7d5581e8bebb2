"""Queries of the front page, the dashboards and the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions import numbers
from newsdesk.functions.text import region
from newsdesk.operators import dedup, portal, research, stats
from newsdesk.plans.registry import query, table

# A country for each nation's key in turn.
COUNTRIES = ("MY", "ID", "SG", "TH", "VN", "CN", "HK", "TW", "JP", "KR", "US", "GB", "FR", "DE", "ES", "BR", "IN", "AU", "ZA", "NG", "PH", "BN", "IT", "NL", "PL")
_COUNTRY = "[" + ", ".join(f"'{c}'" for c in COUNTRIES) + "][(c_nationkey % 25 + 1)::INT]"
_REGION = """CASE WHEN country = 'MY' THEN 'Malaysia' WHEN country IN ('ID', 'SG', 'TH', 'VN', 'PH', 'BN') THEN 'ASEAN' WHEN country IN ('CN', 'HK', 'TW') THEN 'China'
  WHEN country IN ('JP', 'KR') THEN 'Japan & South Korea' WHEN country IN ('US', 'GB', 'FR', 'DE', 'ES', 'IT', 'NL', 'PL') THEN 'Europe & US' ELSE 'World' END"""
_CUSTOMERS = f"a AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS source, {_COUNTRY} AS country, [lower(c_mktsegment), 'k' || c_custkey % 7] AS tags FROM customer)"


def articles(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in COUNTRIES])
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("").alias("summary"), F.col("c_mktsegment").alias("source"),
        F.get(codes, (F.col("c_nationkey") % 25).cast("int")).alias("country"), F.lit(None).cast("string").alias("author"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("k"), (F.col("c_custkey") % 7).cast("string"))).alias("tags"),
    )


@query(f"WITH {_CUSTOMERS} SELECT id, country FROM a WHERE country IN ('MY', 'SG', 'US') AND list_has_any(tags, ['k1', 'k2']) AND contains(lower(title || ' ' || source || ' ' || array_to_string(tags, ' ') || ' ' || country || ' ' || {_REGION}), 'build')")
def portal_filter(spark: SparkSession, d: str) -> DataFrame:
    return portal.filtered(articles(spark, d), " Build", ("MY", "SG", "US"), ("k1", "k2")).select("id", "country")


@query(
    f"""WITH {_CUSTOMERS}, s AS (SELECT {_REGION} AS region FROM a WHERE id <> (SELECT max(id) FROM a))
        SELECT region, list_position(['Malaysia', 'ASEAN', 'China', 'Japan & South Korea', 'Europe & US', 'World'], region)::INT AS place, count(*)::INT AS n FROM s GROUP BY 1, 2"""
)
def region_sections(spark: SparkSession, d: str) -> DataFrame:
    return portal.sections(articles(spark, d), [F.desc("id")])


@query(f"WITH {_CUSTOMERS} SELECT tag, count(*)::INT AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM a) GROUP BY 1")
def tag_facets(spark: SparkSession, d: str) -> DataFrame:
    return portal.facets(articles(spark, d))


@query(f"WITH {_CUSTOMERS} SELECT country, {_REGION} AS region, count(*) AS n FROM a GROUP BY 1, 2")
def country_regions(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).groupBy("country", region(F.col("country")).alias("region")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(strftime(CASE WHEN event_id % 50 <> 0 THEN ts END, '%Y-%m-%d'), 'unknown') AS day, count(*)::INT AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def day_groups(spark: SparkSession, d: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 50 != 0, F.col("ts"))
    return portal.day_groups(table(spark, d, "events"), ts, F.col("event_id"))


# Documents as entries of packets: the label, the render's time and the fields come from the columns.
_ENTRIES = """e AS (SELECT d.doc_id AS ordinal, CASE WHEN l.quality = 1 THEN 'enriched' WHEN l.quality = 0 THEN 'invalid' END AS status,
  CASE WHEN d.doc_id % 11 <> 0 THEN d.n_chars END AS rendered_at, 300 AS packet_at, 'https://x.example/' || d.doc_id // 3 AS url, d.text AS body,
  CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE d.source END AS title_en FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, CASE WHEN coalesce(status, '') <> 'enriched' THEN 'notEnriched' WHEN rendered_at IS NULL THEN 'missingRender' WHEN rendered_at < packet_at THEN 'staleMtime'
  WHEN trim(body) = '' OR title_en = '' THEN 'missingFields' END AS reason FROM e)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "enriched").when(F.col("quality") == 0, "invalid")
    one = F.lit("x")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ordinal"), status.alias("status"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("rendered_at"), F.lit(300).alias("packet_at"),
        F.concat(F.lit("https://x.example/"), F.floor(F.col("doc_id") / 3).cast("string")).alias("url"), F.col("text").alias("body"),
        F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("source")).alias("title_en"), one.alias("title_zh"), one.alias("summary_en"), one.alias("summary_zh"),
    )


_PUBLISHED = "CASE ordinal % 5 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE CAST((DATE '2024-01-01' + (ordinal % 300)::INT) AS VARCHAR) END"


@query(
    f"""WITH {_ENTRIES}, k AS (SELECT url, ordinal, title_en, rendered_at, {_PUBLISHED} AS published_at FROM r WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY rendered_at DESC, ordinal) = 1)
       SELECT url, ordinal, title_en, rendered_at, row_number() OVER (ORDER BY coalesce(epoch_ms(try_cast(published_at AS TIMESTAMP)), 0) DESC, ordinal) - 1 AS place,
         row_number() OVER (ORDER BY coalesce(published_at, '') DESC, ordinal) - 1 AS reader_place FROM k"""
)
def news_list(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("ordinal") % 300).cast("int")).cast("string")
    published = F.when(F.col("ordinal") % 5 == 0, None).when(F.col("ordinal") % 5 == 1, "soon").otherwise(day)
    shown = portal.news_list(entries(spark, d).withColumn("published_at", published), ["url", "ordinal", "title_en", "rendered_at", "published_at"])
    numbered = portal.placed(shown, portal.newest_first("published_at"), "place")
    return portal.placed(numbered, portal.reader_order("published_at"), "reader_place").drop("published_at")


@query(f"WITH {_ENTRIES} SELECT coalesce(reason, 'total') AS reason, count(*)::INT AS n FROM r WHERE reason IS NOT NULL GROUP BY ROLLUP (reason)")
def skip_tally(spark: SparkSession, d: str) -> DataFrame:
    return portal.skip_tally(entries(spark, d))


@query(
    """WITH s AS (SELECT 's' || k AS site FROM range(0, 12) t(k)), days AS (SELECT (DATE '2024-01-20' - (i)::INT) AS day FROM range(0, 7) t(i)),
       c AS (SELECT 's' || user_id % 10 AS site, ts::DATE AS day, floor(value)::BIGINT AS n FROM events),
       g AS (SELECT s.site, days.day, coalesce(sum(c.n), 0)::BIGINT AS n FROM s CROSS JOIN days LEFT JOIN c ON c.site = s.site AND c.day = days.day GROUP BY 1, 2)
       SELECT site, CAST(day AS VARCHAR) AS day, n, sum(n) OVER (PARTITION BY site)::BIGINT AS total,
         CASE WHEN n = 0 THEN 0 WHEN n * 4 < max(n) OVER () THEN 1 WHEN n * 2 < max(n) OVER () THEN 2 WHEN n * 4 < 3 * max(n) OVER () THEN 3 ELSE 4 END AS heat FROM g"""
)
def fetch_heatmap(spark: SparkSession, d: str) -> DataFrame:
    fetches = table(spark, d, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("site"), "ts", F.floor("value").alias("n"))
    sites = spark.range(12).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("site"))
    return stats.heatmap(fetches, sites, F.to_date(F.lit("2024-01-20"))).withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id, event_type, n, floor(100.0 * n / max(n) OVER (PARTITION BY user_id) + 0.5)::INT AS percent FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def normalised_bars(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return stats.bars(counts, "user_id", "n")


@query(
    """WITH v AS (SELECT o_orderkey, (floor(o_totalprice) * 1000 + 7)::BIGINT AS x FROM orders)
       SELECT o_orderkey, CASE WHEN x >= 1e9 THEN regexp_replace(printf('%.1f', x / 1e9), '\\.0$', '') || 'B' WHEN x >= 1e6 THEN regexp_replace(printf('%.1f', x / 1e6), '\\.0$', '') || 'M'
         ELSE format('{:,}', x) END AS en, CASE WHEN x >= 1e8 THEN regexp_replace(printf('%.1f', x / 1e8), '\\.0$', '') || '亿' ELSE regexp_replace(printf('%.1f', x / 1e4), '\\.0$', '') || '万' END AS zh FROM v"""
)
def compact_numbers(spark: SparkSession, d: str) -> DataFrame:
    x = (F.floor("o_totalprice") * 1000 + 7).cast("long")
    return table(spark, d, "orders").select("o_orderkey", numbers.compact_en(x).alias("en"), numbers.compact_zh(x).alias("zh"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS en, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS zh FROM orders")
def date_labels(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", numbers.date_en(ts).alias("en"), numbers.date_zh(ts).alias("zh"))


@query("SELECT event_id, CAST((ts + INTERVAL 8 HOUR)::DATE AS VARCHAR) AS local_day FROM events WHERE (ts + INTERVAL 8 HOUR)::DATE >= DATE '2024-01-10'")
def local_date_floor(spark: SparkSession, d: str) -> DataFrame:
    """Days in the site's time zone, from a first one on."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kuala_Lumpur"))
    return table(spark, d, "events").select("event_id", day.alias("local_day")).where(F.col("local_day") >= F.lit("2024-01-10").cast("date")).select("event_id", F.col("local_day").cast("string").alias("local_day"))


@query(
    """WITH t AS (SELECT event_id, ts, floor(epoch_ms(TIMESTAMP '2024-01-20') / 1000 - epoch_ms(ts) / 1000)::BIGINT AS s0, floor(epoch_ms(ts) / 1000 - epoch_ms(TIMESTAMP '2024-01-20') / 1000 + 0.5)::BIGINT AS u,
         greatest(floor(value * 10)::BIGINT, 0) AS d FROM events), g AS (SELECT *, greatest(s0, 0) AS s FROM t)
       SELECT event_id, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago,
         CASE WHEN u <= 0 THEN 'retry due' WHEN u < 60 THEN 'retry in ' || u || 's' WHEN u < 3600 THEN 'retry in ' || ceil(u / 60.0)::BIGINT || 'm' ELSE 'retry in ' || ceil(u / 3600.0)::BIGINT || 'h' END AS until,
         CASE WHEN d < 60 THEN d || 's' ELSE d // 60 || 'm ' || d % 60 || 's' END AS duration, s // 60 || 'min ago' AS minutes FROM g"""
)
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    as_of, ts = F.lit("2024-01-20").cast("timestamp"), F.col("ts").cast("timestamp")
    end = ts + F.make_dt_interval(secs=F.floor(F.col("value") * 10))
    return table(spark, d, "events").select(
        "event_id", numbers.ago(ts, as_of).alias("ago"), numbers.until(ts, as_of).alias("until"), numbers.duration(ts, end, as_of).alias("duration"), numbers.minutes_ago(ts, as_of).alias("minutes")
    )


_VIEWS = "v AS (SELECT ts, event_id * 31 % 97 AS article, user_id AS visitor, value AS read_time_sec, (props->>'k')::DOUBLE AS scroll_depth, event_type FROM events WHERE event_type IN ('view', 'click'))"


def views(spark: SparkSession, d: str) -> DataFrame:
    depth = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click")).select("ts", (F.col("event_id") * 31 % 97).alias("article"), F.col("user_id").alias("visitor"), F.col("value").alias("read_time_sec"), depth.alias("scroll_depth"), "event_type")


@query(
    f"""WITH {_VIEWS} SELECT count(*) AS total_pageviews, count(*) FILTER (WHERE ts::DATE = DATE '2024-01-20') AS views_today, count(DISTINCT visitor) AS unique_visitors,
        round(avg(scroll_depth), 2) AS avg_scroll_depth, round(avg(read_time_sec), 2) AS avg_read_time_sec FROM v"""
)
def analytics_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.analytics(views(spark, d), F.to_date(F.lit("2024-01-20")))


@query(f"WITH {_VIEWS} SELECT article, count(*) AS n FROM v GROUP BY 1 ORDER BY n DESC, article LIMIT 10")
def top_articles(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d).groupBy("article").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article").limit(10)


@query(f"WITH {_VIEWS} SELECT event_type AS source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM v GROUP BY 1")
def traffic_sources(spark: SparkSession, d: str) -> DataFrame:
    counts = views(spark, d).groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("source", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("share"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k"""
)
def telemetry_sessions(spark: SparkSession, d: str) -> DataFrame:
    """M8, our addition: sessions end after thirty minutes without an event."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("SELECT o_custkey AS id, 'orders' AS origin FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def union_first(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("orders").alias("origin"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    return dedup.union_first([orders, people], "id")


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 480000")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").where(F.col("o_totalprice") > 480000).select("o_custkey"))


@query(
    r"""WITH u AS (SELECT 'q' || page_id % 9 AS query, page_id AS position, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS url FROM pages)
        SELECT query, url, (position + 1)::INT AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY position) = 1"""
)
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    from newsdesk.functions.urls import publisher

    rows = table(spark, d, "pages").select(F.concat(F.lit("q"), (F.col("page_id") % 9).cast("string")).alias("query"), F.col("page_id").alias("position"), "url")
    return research.hits(rows, "query", publisher(F.col("url")))
