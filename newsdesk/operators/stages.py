"""The pipeline's stages: how events fold into a status, and which work is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages in order, and the one that must be done before each.
STAGES = ("distill", "tag", "dedup", "enrich", "render")
PREDECESSOR = {"tag": "distill", "dedup": "tag", "enrich": "dedup", "render": "enrich"}
STATUSES = ("pending", "done", "failed", "skipped")


def backoff_minutes(attempts: Column) -> Column:
    """Ten minutes more for each attempt, six hours at most."""
    return F.least(10 * attempts, F.lit(360))


def history(events: DataFrame, key: list[str], ts: str, order: list[str]) -> DataFrame:
    """After each event the attempts and the time of the next one.

    done and skipped start anew; failed counts one attempt more and sets the next time; pending keeps
    the attempts and clears error and time. ``events`` has status and error (text or null).
    """
    w = Window.partitionBy(*key).orderBy(ts, *order)
    resets = F.sum(F.col("status").isin("done", "skipped").cast("int")).over(w)
    runs = events.withColumn("_run", resets)
    failures = F.sum((F.col("status") == "failed").cast("int")).over(Window.partitionBy(*key, "_run").orderBy(ts, *order))
    failed = F.col("status") == "failed"
    return (
        runs.withColumn("attempts", F.coalesce(failures, F.lit(0)).cast("int"))
        .withColumn("last_error", F.when(failed, F.substring("error", 1, 500)))
        .withColumn("next_retry_at", F.when(failed, F.col(ts) + F.make_dt_interval(mins=backoff_minutes(F.col("attempts")))))
        .drop("_run")
    )


def current(events: DataFrame, key: list[str], ts: str, order: list[str]) -> DataFrame:
    """One row for each key, as its last event left it."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts), *[F.desc(o) for o in order])
    return history(events, key, ts, order).withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def due_work(articles: DataFrame, status: DataFrame, stage: str, as_of: Column, limit: int, needs_prior: bool = True) -> DataFrame:
    """Articles whose ``stage`` has no row or is pending or failed and due, and whose
    predecessor is done; the earliest of retry time and fetch time first, nulls before, then id."""
    mine = status.where(F.col("stage") == stage).select("article_id", "status", "attempts", "next_retry_at")
    found = articles.join(mine, "article_id", "left")
    ready = F.col("status").isNull() | (F.col("status").isin("pending", "failed") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)))
    found = found.where(ready)
    if needs_prior and stage in PREDECESSOR:
        prior = status.where((F.col("stage") == PREDECESSOR[stage]) & (F.col("status") == "done")).select("article_id")
        found = found.join(prior, "article_id", "left_semi")
    return found.orderBy(F.coalesce("next_retry_at", "fetched_at").asc_nulls_first(), "article_id").limit(limit)


def missing_stage(articles: DataFrame, status: DataFrame, stage: str) -> DataFrame:
    """Articles without a row for ``stage`` whose predecessor is done."""
    found = articles.join(status.where(F.col("stage") == stage).select("article_id"), "article_id", "left_anti")
    if stage in PREDECESSOR:
        prior = status.where((F.col("stage") == PREDECESSOR[stage]) & (F.col("status") == "done")).select("article_id")
        found = found.join(prior, "article_id", "left_semi")
    return found


def stage_counts(status: DataFrame) -> DataFrame:
    """A1."""
    return status.groupBy("stage", "status").agg(F.count("*").cast("int").alias("n"))


def stage_totals(status: DataFrame) -> DataFrame:
    """A4: a column for each known status."""
    return status.groupBy("stage").agg(*[F.count_if(F.col("status") == s).cast("int").alias(s) for s in STATUSES])


def article_stages(status: DataFrame) -> DataFrame:
    """A2: one row for each article: the last change and a map from stage to its status."""
    entries = F.array_sort(F.collect_list(F.struct("stage", F.struct("status", "attempts").alias("state"))))
    return status.groupBy("article_id").agg(F.max("updated_at").alias("updated_at"), F.map_from_entries(entries).alias("stages"))


def dashboard(status: DataFrame, articles: DataFrame, limit: int = 50) -> DataFrame:
    """Articles that have a status, with their stages, the last changed first (then the
    smaller id), 1 to 200 of them."""
    joined = article_stages(status).join(articles, "article_id")
    return joined.orderBy(F.desc("updated_at"), "article_id").limit(min(200, max(1, limit)))


def done_renders(status: DataFrame, articles: DataFrame, limit: int) -> DataFrame:
    """Articles whose page is done, the largest ids first."""
    done = status.where((F.col("stage") == "render") & (F.col("status") == "done")).select("article_id")
    return articles.join(done, "article_id", "left_semi").orderBy(F.desc("article_id")).limit(limit)


def missing_renders(status: DataFrame, articles: DataFrame, files: DataFrame, limit: int, over: int = 5) -> DataFrame:
    """Of the ``over`` * ``limit`` newest done pages those whose file (render_file) isn't in
    ``files``, the newest ``limit``."""
    if limit <= 0:
        return articles.limit(0)
    name = F.concat(F.lit("infographic_"), F.col("article_id").cast("string"), F.lit(".dc.html"))
    newest = done_renders(status, articles, over * limit).withColumn("render_file", name)
    return newest.join(files.select("render_file"), "render_file", "left_anti").drop("render_file").orderBy(F.desc("article_id")).limit(limit)


def render_work(status: DataFrame, articles: DataFrame, files: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """U-6: due render work, filled up to ``limit`` with done pages whose file is gone, each article once."""
    due = due_work(articles, status, "render", as_of, limit).select(*articles.columns)
    n = due.count()
    return due if n >= limit else due.unionByName(missing_renders(status, articles, files, limit - n).join(due.select("article_id"), "article_id", "left_anti").select(*articles.columns))


def batches(work: DataFrame, order: list[Column], size: int = 50, most: int = 20) -> DataFrame:
    """M7: the due work of a drained queue, with the batch in which each row is taken: ``most`` batches of
    ``size`` rows. What they leave behind, failed again or not reached, is due in the next run."""
    taken = work.orderBy(*order).limit(size * most)
    # size * most rows, which one window may number.
    return taken.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


def outcome_events(outcomes: DataFrame) -> DataFrame:
    """M9: the stage events that the outcomes of a stage's handler give. ``outcomes`` has article_id, stage,
    ok, error, valid (of an enrichment) and match_id (of a duplicate): done or failed for the stage
    itself; an invalid enrichment fails; a duplicate also skips enrich and render."""
    invalid = (F.col("stage") == "enrich") & ~F.coalesce("valid", F.lit(False))
    status = F.when(F.col("ok") & ~invalid, "done").otherwise("failed")
    error = F.when(~F.col("ok"), F.col("error")).when(invalid, F.concat(F.lit("Enrichment validation failed: "), F.coalesce("error", F.lit("invalid output"))))
    own = F.struct("stage", status.alias("status"), error.alias("error"))
    skip = lambda s: F.struct(F.lit(s).alias("stage"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    twice = (F.col("stage") == "dedup") & F.col("ok") & F.col("match_id").isNotNull()
    events = F.when(twice, F.array(own, skip("enrich"), skip("render"))).otherwise(F.array(own))
    return outcomes.select("article_id", F.explode(events).alias("e")).select("article_id", "e.*")


def usable_enrichments(articles: DataFrame, enrichments: DataFrame) -> DataFrame:
    """M9: what render needs: the articles' enrichments that are enriched and have content, else why not."""
    both = articles.join(enrichments.select("article_id", "status", "content"), "article_id", "left")
    fit = (F.col("status") == "enriched") & F.col("content").isNotNull()
    why = F.concat(F.lit("No usable enrichment for article id "), F.col("article_id").cast("string"), F.lit(" (status: "), F.coalesce("status", F.lit("none")), F.lit(")"))
    return both.select("article_id", "content", F.coalesce(fit, F.lit(False)).alias("ok"), F.when(~F.coalesce(fit, F.lit(False)), why).alias("error"))


def seed_stage(articles: DataFrame, status: DataFrame, stage: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The status with a pending row for each article that missing_stage finds, and how many these are."""
    new = missing_stage(articles, status, stage).select(
        "article_id", F.lit(stage).alias("stage"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("next_retry_at"), now.alias("updated_at")
    )
    return status.unionByName(new, allowMissingColumns=True), new.agg(F.count("*").alias("seeded"))


def retry_totals(outcomes: DataFrame) -> DataFrame:
    """A10: attempted, succeeded and failed by stage, and for all stages under a null stage."""
    return outcomes.rollup("stage").agg(
        F.count("*").cast("int").alias("attempted"), F.count_if("ok").cast("int").alias("succeeded"), F.count_if(~F.col("ok")).cast("int").alias("failed")
    )
