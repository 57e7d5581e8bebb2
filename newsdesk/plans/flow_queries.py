"""Queries on logs: stages, providers, jobs, budgets, sessions. Event types stand for statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions import numbers
from newsdesk.operators import health, research, stages, stats, store
from newsdesk.plans.registry import query, table

_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skipped' ELSE 'pending' END"
_STAGE = "['distill', 'tag', 'dedup', 'enrich', 'render'][(user_id % 5 + 1)::INT]"
AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"


def stage_log(spark: SparkSession, d: str) -> DataFrame:
    """Each user is an article at one stage."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    names = F.array(*[F.lit(s) for s in stages.STAGES])
    return events.select(
        "event_id", "ts", F.col("user_id").alias("article_id"), F.get(names, (F.col("user_id") % 5).cast("int")).alias("stage"), F.expr(_STATUS).alias("status"),
        F.when(F.expr(_STATUS) == "failed", F.concat(F.lit("value "), F.floor("value").cast("string"))).alias("error"),
    )


_FOLD = f"""e AS (SELECT event_id, ts, user_id, {_STATUS} AS status, value FROM events),
r AS (SELECT *, sum(CASE WHEN status IN ('done', 'skipped') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS attempts FROM r),
h AS (SELECT event_id, user_id AS article_id, {_STAGE} AS stage, ts, status, attempts, CASE WHEN status = 'failed' THEN 'value ' || floor(value)::BIGINT END AS last_error,
      CASE WHEN status = 'failed' THEN least(10 * attempts, 360) END AS wait FROM f)"""


@query(f"WITH {_FOLD} SELECT event_id, article_id, status, attempts, last_error, floor(epoch(ts + to_minutes(wait::INT)))::BIGINT AS retry_s FROM h")
def stage_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = stages.history(stage_log(spark, d), ["article_id"], "ts", ["event_id"])
    return folded.select("event_id", "article_id", "status", "attempts", "last_error", F.unix_timestamp("next_retry_at").alias("retry_s"))


_NOW = f"{_FOLD}, s AS (SELECT *, ts + to_minutes(wait::INT) AS retry FROM h QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ts DESC, event_id DESC) = 1)"


def _status(spark: SparkSession, d: str) -> DataFrame:
    return stages.current(stage_log(spark, d), ["article_id"], "ts", ["event_id"])


@query(f"WITH {_NOW} SELECT article_id, stage, status, attempts, floor(epoch(retry))::BIGINT AS retry_s FROM s")
def stage_current(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).select("article_id", "stage", "status", "attempts", F.unix_timestamp("next_retry_at").alias("retry_s"))


@query(f"WITH {_NOW} SELECT stage, status, count(*)::INT AS n FROM s GROUP BY 1, 2")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return stages.stage_counts(_status(spark, d))


@query(
    f"""WITH {_NOW} SELECT stage, count(*) FILTER (WHERE status = 'pending')::INT AS pending, count(*) FILTER (WHERE status = 'done')::INT AS done,
        count(*) FILTER (WHERE status = 'failed')::INT AS failed, count(*) FILTER (WHERE status = 'skipped')::INT AS skipped FROM s GROUP BY 1"""
)
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return stages.stage_totals(_status(spark, d))


def order_status(spark: SparkSession, d: str) -> DataFrame:
    """Orders as status rows of customers: each customer's last order of a stage is its row."""
    o = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    named = F.when(F.col("o_orderkey") % 2 == 0, "distill").otherwise("tag")
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'F' THEN 'done' ELSE 'pending' END")
    rows = o.select(F.col("o_custkey").alias("article_id"), named.alias("stage"), "o_orderkey", status.alias("status"), "ts", F.lit(1).alias("attempts"))
    last = rows.groupBy("article_id", "stage").agg(F.max(F.struct("o_orderkey", "status", "ts", "attempts")).alias("x"))
    return last.select("article_id", "stage", "x.status", "x.attempts", F.col("x.ts").alias("updated_at"), F.when(F.col("x.status") == "failed", F.col("x.ts")).alias("next_retry_at"))


_ORDERS = """s AS (SELECT o_custkey AS article_id, CASE WHEN o_orderkey % 2 = 0 THEN 'distill' ELSE 'tag' END AS stage,
  CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'F' THEN 'done' ELSE 'pending' END AS status, o_orderdate AS ts, 1 AS attempts FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'distill' ELSE 'tag' END ORDER BY o_orderkey DESC) = 1),
 a AS (SELECT c_custkey AS article_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2023-01-01' + to_hours((c_custkey % 1000)::INT) END AS fetched_at FROM customer),
 d AS (SELECT a.*, m.status, CASE WHEN m.status = 'failed' THEN m.ts END AS retry FROM a LEFT JOIN s m ON m.article_id = a.article_id AND m.stage = '{stage}')"""


def customers(spark: SparkSession, d: str) -> DataFrame:
    fetched = F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2023-01-01' + make_dt_interval(0, CAST(c_custkey % 1000 AS INT)) END")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"), fetched.alias("fetched_at"))


_DUE = "(status IS NULL OR (status IN ('pending', 'failed') AND (retry IS NULL OR retry <= TIMESTAMP '1996-01-01')))"


@query(
    f"WITH {_ORDERS.format(stage='distill')} SELECT article_id, status FROM d WHERE {_DUE} ORDER BY coalesce(retry, fetched_at) ASC NULLS FIRST, article_id LIMIT 200"
)
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    due = stages.due_work(customers(spark, d), order_status(spark, d), "distill", F.lit("1996-01-01").cast("timestamp"), 200)
    return due.select("article_id", "status")


@query(
    f"""WITH {_ORDERS.format(stage='tag')} SELECT article_id, status FROM d WHERE {_DUE} AND article_id IN (SELECT article_id FROM s WHERE stage = 'distill' AND status = 'done')
        ORDER BY coalesce(retry, fetched_at) ASC NULLS FIRST, article_id LIMIT 200"""
)
def work_queue_prior(spark: SparkSession, d: str) -> DataFrame:
    due = stages.due_work(customers(spark, d), order_status(spark, d), "tag", F.lit("1996-01-01").cast("timestamp"), 200)
    return due.select("article_id", "status")


@query(
    f"""WITH {_ORDERS.format(stage='tag')} SELECT article_id FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.article_id = a.article_id AND stage = 'tag')
        AND EXISTS (SELECT 1 FROM s WHERE s.article_id = a.article_id AND stage = 'distill' AND status = 'done')"""
)
def seed_missing(spark: SparkSession, d: str) -> DataFrame:
    return stages.missing_stage(customers(spark, d), order_status(spark, d), "tag").select("article_id")


@query(
    f"""WITH {_ORDERS.format(stage='tag')} SELECT article_id, epoch(max(ts))::BIGINT AS updated_s,
        max(CASE WHEN stage = 'distill' THEN status END) AS distill, max(CASE WHEN stage = 'tag' THEN status END) AS tag FROM s GROUP BY 1"""
)
def article_stages(spark: SparkSession, d: str) -> DataFrame:
    found = stages.article_stages(order_status(spark, d))
    state = lambda s: F.try_element_at("stages", F.lit(s))["status"]
    return found.select("article_id", F.unix_timestamp("updated_at").alias("updated_s"), state("distill").alias("distill"), state("tag").alias("tag"))


@query(
    f"""SELECT stage, count(*)::INT AS attempted, count(*) FILTER (WHERE status = 'done')::INT AS succeeded, count(*) FILTER (WHERE status <> 'done')::INT AS failed
        FROM (SELECT {_STAGE} AS stage, {_STATUS} AS status FROM events) GROUP BY ROLLUP (stage)"""
)
def retry_totals(spark: SparkSession, d: str) -> DataFrame:
    return stages.retry_totals(stage_log(spark, d).select("stage", (F.col("status") == "done").alias("ok")))


# Ten providers; a call's event type and value give its status, error and latency.
_CALL = """CASE event_type WHEN 'error' THEN [401, 429, 500, 404, NULL][(event_id % 5 + 1)::INT] END AS status,
  CASE WHEN event_type = 'error' AND event_id % 5 = 4 THEN CASE WHEN event_id % 2 = 0 THEN 'Request Timeout' ELSE 'reset' END END AS error"""
_CALLS = f"""c AS (SELECT event_id, ts, 'p' || (user_id % 10) AS provider, {_CALL}, value * 400 AS latency FROM events),
k AS (SELECT *, CASE WHEN status IN (401, 403) THEN 'auth_error' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'down' WHEN status >= 400 THEN 'auth_error'
  WHEN error <> '' AND (lower(error) LIKE '%abort%' OR lower(error) LIKE '%timed out%' OR lower(error) LIKE '%timeout%') THEN 'timeout' WHEN error <> '' THEN 'down'
  WHEN latency > 10000 THEN 'slow' ELSE 'ok' END AS state FROM c)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(c).cast("int") for c in (401, 429, 500, 404, None)])
    error = F.col("event_type") == "error"
    status = F.when(error, F.get(codes, (F.col("event_id") % 5).cast("int")))
    text = F.when(error & (F.col("event_id") % 5 == 4), F.when(F.col("event_id") % 2 == 0, "Request Timeout").otherwise("reset"))
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = events.select("event_id", "ts", F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("provider"), status.alias("status"), text.alias("error"), (F.col("value") * 400).alias("latency"))
    return made.withColumn("state", numbers.health_state(F.col("status"), F.col("error"), F.col("latency")))


@query(f"WITH {_CALLS} SELECT provider, state, count(*) AS n FROM k GROUP BY 1, 2")
def health_states(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).groupBy("provider", "state").agg(F.count("*").alias("n"))


_HISTORY = f"""{_CALLS}, r AS (SELECT *, state IN ('ok', 'slow') AS ok, sum(CASE WHEN state IN ('ok', 'slow') THEN 1 ELSE 0 END) OVER w AS run,
  sum(CASE WHEN state = 'ok' THEN 1 ELSE 0 END) OVER w AS clean FROM k WINDOW w AS (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT event_id, ts, provider, state, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY provider, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS consecutive_failures,
  last_value(CASE WHEN NOT ok THEN coalesce(error, state) END IGNORE NULLS) OVER (PARTITION BY provider, clean ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error,
  epoch(last_value(CASE WHEN ok THEN ts END IGNORE NULLS) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS last_success_s,
  sum(ok::INT) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)::INT AS ok20 FROM r)"""


@query(f"WITH {_HISTORY} SELECT event_id, provider, state, consecutive_failures, last_error, last_success_s FROM h")
def provider_history(spark: SparkSession, d: str) -> DataFrame:
    found = health.call_history(calls(spark, d), "ts", ["event_id"])
    return found.select("event_id", "provider", "state", "consecutive_failures", "last_error", F.rint(F.unix_micros("last_success_at") / 1e6).cast("long").alias("last_success_s"))


_LAST = f"{_HISTORY}, l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"WITH {_LAST} SELECT provider, state, consecutive_failures, last_error, round(ok20 / 20.0, 2) AS success_rate FROM l")
def provider_health(spark: SparkSession, d: str) -> DataFrame:
    return health.snapshot(calls(spark, d), "ts", ["event_id"]).select("provider", "state", "consecutive_failures", "last_error", "success_rate")


@query(
    f"""WITH {_LAST} SELECT CASE WHEN bool_and(state NOT IN ('ok', 'slow')) THEN 'down' WHEN bool_or(state <> 'ok') THEN 'degraded' ELSE 'ok' END AS overall,
        count(*)::INT AS providers FROM l"""
)
def provider_overall(spark: SparkSession, d: str) -> DataFrame:
    return health.overall(health.snapshot(calls(spark, d), "ts", ["event_id"]))


@query(
    f"""WITH {_LAST} SELECT provider, state FROM l ORDER BY list_position(['down', 'auth_error', 'timeout', 'rate_limited', 'slow', 'ok'], state), provider LIMIT 1"""
)
def provider_worst(spark: SparkSession, d: str) -> DataFrame:
    return health.worst(health.snapshot(calls(spark, d), "ts", ["event_id"]))


@query(
    """SELECT event_id, CASE WHEN s = 403 THEN 'stop' WHEN s IS NULL OR s IN (408, 425, 429, 500, 502, 503, 504) THEN 'retry' ELSE 'fail' END AS class
       FROM (SELECT event_id, [403, 408, 425, 429, 500, 502, 503, 504, 404, 200, NULL][(event_id % 11 + 1)::INT] AS s FROM events)"""
)
def retry_classes(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(c).cast("int") for c in (403, 408, 425, 429, 500, 502, 503, 504, 404, 200, None)])
    status = F.get(codes, (F.col("event_id") % 11).cast("int"))
    return table(spark, d, "events").select("event_id", numbers.retry_class(status).alias("class"))


_JOBS = f"""j AS (SELECT event_id AS id, user_id AS pid, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, ts,
  floor(value)::BIGINT AS articles FROM events),
  t AS (SELECT id, pid, articles, CASE WHEN status = 'running' AND ts < {AS_OF} - INTERVAL 5 MINUTE THEN 'stale' ELSE status END AS status FROM j)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END")
    events = table(spark, d, "events")
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("pid"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.floor("value").alias("articles"))
    return stats.job_status(rows, F.expr(AS_OF))


@query(f"WITH {_JOBS} SELECT id, status FROM t")
def stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("id", "status")


@query(
    f"""WITH {_JOBS} SELECT count(*) FILTER (WHERE status = 'running')::INT AS active, count(*) FILTER (WHERE status = 'succeeded')::INT AS completed,
        count(*) FILTER (WHERE status = 'failed')::INT AS failed, sum(articles) FILTER (WHERE status = 'succeeded')::BIGINT AS articles,
        count(DISTINCT pid) FILTER (WHERE status = 'running')::INT AS processes FROM t"""
)
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.job_summary(jobs(spark, d))


@query(
    """WITH b AS (SELECT *, sum(length(text)) OVER w AS spent, count(*) OVER w AS seen FROM conversations
         WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT conv_id, turn, coalesce(spent, 0)::BIGINT AS spent FROM b WHERE seen < 5 AND coalesce(spent, 0) < 1500"""
)
def research_budget(spark: SparkSession, d: str) -> DataFrame:
    return research.within_budget(table(spark, d, "conversations"), "conv_id", "turn", F.char_length("text"), 5, 1500).select("conv_id", "turn", "spent")


@query("SELECT conv_id, turn, row_number() OVER w AS seq, turn * 10 - first_value(turn * 10) OVER w AS elapsed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    found = research.event_sequence(table(spark, d, "conversations"), "conv_id", "turn", F.col("turn") * 10)
    return found.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "elapsed")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 40")
def last_events(spark: SparkSession, d: str) -> DataFrame:
    return research.last_events(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


@query(
    """SELECT user_id, event_id, found_before FROM (SELECT user_id, event_id, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS found_before FROM events) WHERE found_before < 3"""
)
def first_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ok", F.col("event_type") == "purchase")
    return research.first_valid(rows, "user_id", "event_id", 3).select("user_id", "event_id", "found_before")


@query(
    """WITH a AS (SELECT user_id AS call, event_id % 4 AS provider, event_type <> 'error' AS ok FROM events),
       s AS (SELECT call, provider, (provider - call + 4000000) % 4 AS place FROM a WHERE ok)
       SELECT call, provider, (place + 1)::INT AS tries FROM s QUALIFY row_number() OVER (PARTITION BY call ORDER BY place) = 1"""
)
def failover(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("call"), (F.col("event_id") % 4).alias("provider"), (F.col("event_type") != "error").alias("ok"))
    return research.failover(rows, "call", 4)


@query("SELECT count(*)::INT AS cases, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 1) AS passed_rate, round(100.0 * count(*) FILTER (WHERE toxic = 0) / count(*), 1) AS fetched_rate FROM labels")
def benchmark_rates(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "labels").select((F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("fetched"))
    return stats.rates(cases, "passed", "fetched")


_CONTROL = """r AS (SELECT s_suppkey AS route_id, 'task' || s_suppkey % 3 AS task, (s_suppkey // 3)::INT AS position, s_nationkey::BIGINT AS model_id, s_suppkey % 5 <> 0 AS enabled FROM supplier),
m AS (SELECT n_nationkey::BIGINT AS model_id, n_regionkey::BIGINT AS provider_id, n_name AS model, n_nationkey % 4 <> 1 AS enabled FROM nation),
p AS (SELECT r_regionkey::BIGINT AS provider_id, r_name AS provider, r_regionkey <> 2 AS enabled FROM region)"""


def _control(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    routes = s.select(
        F.col("s_suppkey").alias("route_id"), F.concat(F.lit("task"), (F.col("s_suppkey") % 3).cast("string")).alias("task"), F.floor(F.col("s_suppkey") / 3).cast("int").alias("position"),
        F.col("s_nationkey").cast("long").alias("model_id"), (F.col("s_suppkey") % 5 != 0).alias("enabled"),
    )
    models = n.select(F.col("n_nationkey").cast("long").alias("model_id"), F.col("n_regionkey").cast("long").alias("provider_id"), F.col("n_name").alias("model"), (F.col("n_nationkey") % 4 != 1).alias("enabled"))
    providers = r.select(F.col("r_regionkey").cast("long").alias("provider_id"), F.col("r_name").alias("provider"), (F.col("r_regionkey") != 2).alias("enabled"))
    return routes, models, providers


@query(f"WITH {_CONTROL} SELECT task, position, model, provider FROM r JOIN m USING (model_id) JOIN p USING (provider_id) WHERE r.enabled AND m.enabled AND p.enabled")
def route_chain(spark: SparkSession, d: str) -> DataFrame:
    return store.enabled_routes(*_control(spark, d)).select("task", "position", "model", "provider")


@query(f"WITH {_CONTROL} SELECT provider, coalesce(string_agg(model, ',' ORDER BY model), '') AS models FROM p LEFT JOIN (SELECT * FROM m WHERE provider_id <> 4) x USING (provider_id) GROUP BY 1")
def provider_models(spark: SparkSession, d: str) -> DataFrame:
    _, models, providers = _control(spark, d)
    return store.provider_models(providers.select("provider_id", "provider"), models.where("provider_id <> 4")).select("provider", F.array_join("models", ",").alias("models"))


@query(f"WITH {_CONTROL} SELECT task, position, model_id FROM r WHERE task <> 'task1' UNION ALL SELECT 'task1', pos, mid FROM (VALUES (0, 7), (1, 3), (2, 11)) v(pos, mid)")
def replace_chain(spark: SparkSession, d: str) -> DataFrame:
    return store.replace_chain(_control(spark, d)[0], "task1", [7, 3, 11])


@query(f"WITH {_CONTROL} SELECT model_id, provider_id FROM m WHERE provider_id NOT IN (1, 3)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    _, models, providers = _control(spark, d)
    gone = providers.where("provider_id IN (1, 3)").select("provider_id")
    return store.cascade_delete(providers, models, gone, "provider_id", "provider_id")[1].select("model_id", "provider_id")


# The first three quarters of the documents are old, the second half is a batch; some keys come twice.
_ARTICLES = """o AS (SELECT doc_id AS url, source AS title, lang AS country, 'old' AS tags FROM documents WHERE doc_id < {n} * 3 // 4),
b AS (SELECT doc_id AS url, lang || '-' || source AS title, source AS country, n_chars AS at FROM documents WHERE doc_id >= {n} // 2)"""
_N = "(SELECT count(*) FROM documents)"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    n = docs.count()
    old = docs.where(F.col("doc_id") < n * 3 // 4).select(F.col("doc_id").alias("url"), F.col("source").alias("title"), F.col("lang").alias("country"), F.lit("old").alias("tags"))
    new = docs.where(F.col("doc_id") >= n // 2)
    rows = new.select(F.col("doc_id").alias("url"), F.concat_ws("-", "lang", "source").alias("title"), F.col("source").alias("country"), F.lit("new").alias("tags"), F.lit(1).alias("at"))
    twice = rows.withColumns({"title": F.lit("first"), "at": F.lit(0)}).where("url % 10 = 0")
    return old, store.last_per_key(rows.unionByName(twice), "url", "at").drop("at")


@query(
    f"""WITH {_ARTICLES.format(n=_N)} SELECT coalesce(b.url, o.url) AS url, coalesce(b.title, o.title) AS title, coalesce(b.country, o.country) AS country,
        CASE WHEN b.url IS NOT NULL THEN 'new' ELSE 'old' END AS tags FROM o FULL JOIN b ON o.url = b.url"""
)
def upsert_articles(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_snapshots(spark, d), "url")


@query(
    f"""WITH {_ARTICLES.format(n=_N)} SELECT coalesce(b.url, o.url) AS url, coalesce(b.title, o.title) AS title, coalesce(b.country, o.country) AS country, o.tags AS tags
        FROM o FULL JOIN b ON o.url = b.url"""
)
def upsert_keep_tags(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_snapshots(spark, d), "url", keep=("tags",))


@query(
    f"""WITH {_ARTICLES.format(n=_N)} SELECT url, CASE WHEN url % 3 = 0 THEN 'patched' ELSE title END AS title, country, tags FROM o"""
)
def sparse_patch(spark: SparkSession, d: str) -> DataFrame:
    old, _ = _snapshots(spark, d)
    changes = old.select("url", F.when(F.col("url") % 3 == 0, "patched").when(F.col("url") % 3 == 1, "").alias("title"))
    return store.patch(old, changes, "url")
