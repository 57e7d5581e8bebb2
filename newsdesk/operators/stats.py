"""Jobs, activity by day, bars and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.numbers import half_up, heat_class


def job_status(jobs: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """A running job without a heartbeat for five minutes is stale."""
    old = (F.col("status") == "running") & (F.col("updated_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def job_summary(jobs: DataFrame) -> DataFrame:
    """A5."""
    is_ = lambda s: F.col("status") == s
    return jobs.agg(
        F.count_if(is_("running")).cast("int").alias("active"),
        F.count_if(is_("succeeded")).cast("int").alias("completed"),
        F.count_if(is_("failed")).cast("int").alias("failed"),
        F.coalesce(F.sum(F.when(is_("succeeded"), F.col("articles"))), F.lit(0)).cast("long").alias("articles"),
        F.count_distinct(F.when(is_("running"), F.col("pid"))).cast("int").alias("processes"),
    )


def heatmap(fetches: DataFrame, sites: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """Every known or observed site on each of the last ``days`` days, zeros
    included, with the site's total and the class of each cell. ``days`` is held within 1 to 31."""
    days = max(1, min(31, days))
    span = F.sequence(F.date_sub(last_day, days - 1), last_day)
    ids = sites.select("site").union(fetches.select("site")).distinct()
    grid = ids.select("site", F.explode(span).alias("day"))
    counts = fetches.groupBy("site", F.to_date("ts").alias("day")).agg(F.sum("n").alias("n"))
    cells = grid.join(counts, ["site", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    top = cells.agg(F.max("n").alias("top"))
    total = F.sum("n").over(Window.partitionBy("site"))
    return cells.withColumn("total", total).join(F.broadcast(top)).select("site", "day", "n", "total", heat_class(F.col("n"), F.col("top")).alias("heat"))


def bars(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Whole percents of the group's largest value."""
    most = F.max(F.abs(value)).over(Window.partitionBy(group))
    return rows.withColumn("percent", F.when(most > 0, half_up(100 * F.abs(value) / most)).otherwise(0).cast("int"))


def rates(cases: DataFrame, *flags: str) -> DataFrame:
    """Percent of cases for which each flag holds, one decimal, null without cases."""
    n = F.count("*")
    return cases.agg(n.cast("int").alias("cases"), *[F.round(100 * F.count_if(f) / F.nullif(n, F.lit(0)), 1).alias(f"{f}_rate") for f in flags])


def case_checks(cases: DataFrame, hits: DataFrame, documents: DataFrame) -> DataFrame:
    """What a benchmark asks of each case, and whether it passed.

    ``cases`` has id, query, search_limit, expected_pattern, url, expected_fetcher, expected_status and expect_failure, all
    but id may be null; ``hits`` has query (white space collapsed), url and rank; ``documents`` has url,
    title, final_url, fetcher, retrieved_at, status and failure, one row a url. Checks that a case
    doesn't ask for are null. A blank query and a url without a document are errors; after a
    blank query nothing else is looked at. A case passes without errors and with no check that failed."""
    asked = F.coalesce("query", F.lit("")) != ""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    query = F.trim(F.regexp_replace("query", r"\s+", " "))
    wanted = cases.where(asked).select("id", query.alias("query"), F.coalesce(F.nullif("search_limit", F.lit(0)), F.lit(10)).alias("most"), F.concat(F.lit("(?i)"), "expected_pattern").alias("pattern"))
    seen = wanted.join(hits.select(F.col("query").alias("_q"), F.col("url").alias("hit"), "rank"), (F.col("query") == F.col("_q")) & (F.col("rank") <= F.col("most")), "left")
    found = seen.groupBy("id").agg(F.count("hit").alias("n"), F.coalesce(F.bool_or(F.rlike("hit", F.col("pattern"))), F.lit(False)).alias("relevant"))
    pages = documents.select(F.col("url").alias("_url"), F.struct("title", "final_url", "fetcher", "retrieved_at", "status", "failure").alias("page"))
    both = cases.join(found, "id", "left").join(pages, (F.col("url") == F.col("_url")) & (F.col("url") != ""), "left")
    blank = asked & (query == "")
    both = both.withColumn("page", F.when(~blank, F.col("page")))
    there, failed = F.col("page").isNotNull(), some("page.failure")
    checks = {
        "search_returned": F.when(asked & ~blank, F.col("n") > 0),
        "search_relevant": F.when(asked & ~blank & some("expected_pattern"), F.col("relevant")),
        "fetch_succeeded": F.when(there, ~failed),
        "metadata_complete": F.when(there, some("page.title") & some("page.final_url")),
        "provenance_complete": F.when(there, some("page.fetcher") & F.col("page.retrieved_at").isNotNull()),
        "fetcher_right": F.when(there & some("expected_fetcher"), F.col("page.fetcher").eqNullSafe(F.col("expected_fetcher"))),
        "status_right": F.when(there & (F.col("expected_status") != 0), F.col("page.status").eqNullSafe(F.col("expected_status"))),
        "failure_right": F.when(there & F.col("expect_failure").isNotNull(), failed == F.col("expect_failure")),
    }
    errors = F.array_compact(F.array(F.when(blank, "the query is blank"), F.when(some("url") & ~there & ~blank, "the page has no document")))
    out = both.select("id", *[c.alias(name) for name, c in checks.items()], errors.alias("errors"))
    right = [F.coalesce(F.col(name), F.lit(True)) for name in checks]
    passed = F.size("errors") == 0
    for one in right:
        passed = passed & one
    return out.withColumn("passed", passed)


def case_report(checked: DataFrame) -> DataFrame:
    """Rates over checked cases in percent, those of pages over the cases that have one."""
    rate = lambda flag, of: F.round(100 * F.count_if(flag) / F.nullif(of, F.lit(0)), 1)
    every, pages = F.count("*"), F.count("fetch_succeeded")
    return checked.agg(
        every.cast("int").alias("cases"), F.count_if("passed").cast("int").alias("passed"), rate("passed", every).alias("pass_rate"),
        rate("fetch_succeeded", pages).alias("fetch_rate"), rate("provenance_complete", pages).alias("provenance_rate"), rate("metadata_complete", pages).alias("metadata_rate"),
    )


def analytics(views: DataFrame, day: Column) -> DataFrame:
    """Page views in all and on a day, visitors, means. The definitions are ours."""
    return views.agg(
        F.count("*").alias("total_pageviews"),
        F.count_if(F.to_date("ts") == day).alias("views_today"),
        F.count_distinct("visitor").alias("unique_visitors"),
        F.round(F.avg("scroll_depth"), 2).alias("avg_scroll_depth"),
        F.round(F.avg("read_time_sec"), 2).alias("avg_read_time_sec"),
    )
