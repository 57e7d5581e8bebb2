"""Crawl jobs as folds of their events, and the configuration of sites."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a site adapter must name.
REQUIRED = ("id", "source", "country", "latestUrl", "timezone")


def job_progress(events: DataFrame) -> DataFrame:
    """M3: counters and state of each job from its events (job, seq, kind, n, ok): candidates, started,
    finished, complete or fail. The last of complete and fail decides; without either a job runs."""
    kind = lambda k: F.col("kind") == k
    ends = F.max_by(F.when(kind("complete"), "succeeded").otherwise("failed"), F.when(F.col("kind").isin("complete", "fail"), F.col("seq")))
    return events.groupBy("job").agg(
        F.coalesce(F.max_by("n", F.when(kind("candidates"), F.col("seq"))), F.lit(0)).cast("int").alias("candidates"),
        F.count_if(kind("started")).cast("int").alias("claimed"),
        F.count_if(kind("finished")).cast("int").alias("completed"),
        F.count_if(kind("finished") & F.col("ok")).cast("int").alias("succeeded"),
        F.count_if(kind("finished") & ~F.col("ok")).cast("int").alias("failed"),
        F.coalesce(F.when(F.count_if(F.col("kind").isin("complete", "fail")) > 0, ends), F.lit("running")).alias("status"),
    )


def crawled(sites: DataFrame, crawl: Callable[[dict], list[dict]], article: str) -> DataFrame:
    """Every site's articles in one job: (place, site, article, failure). ``crawl`` takes a site as a dict and
    returns its articles (or captures of them); a site that raises is one row with its failure and stops no
    other. ``place`` (a column of ``sites``) keeps the order; as many sites run at once as there are tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for site in batch.to_dict("records"):
                try:
                    found, failure = crawl(site), None
                except Exception as failed:  # one site's failure is data
                    found, failure = [], str(failed)[:500]
                rows = [(site["place"], site["id"], json.dumps(x, ensure_ascii=False, sort_keys=True), None) for x in found]
                yield pd.DataFrame(rows or [(site["place"], site["id"], None, failure)], columns=["place", "site", "article", "failure"])

    rows = sites.repartition(max(1, sites.count()), "place").mapInPandas(run, "place int, site string, article string, failure string")
    return rows.withColumn("article", F.from_json("article", article))


def busy_sites(sites: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each site and whether a job of it runs."""
    active = jobs.where("status = 'running'").select("site").distinct().withColumn("busy", F.lit(True))
    return sites.join(active, "site", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))


def adapter_for(urls: DataFrame, adapters: DataFrame) -> DataFrame:
    """The first adapter, in registry order, whose domain is the url's host or above it.

    A host meets only the domains that its own suffixes spell, by an equality join, so the registry
    may be of any size."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = urls.where(host.isNotNull()).select("url", F.explode(suffixes).alias("domain"))
    return spread.join(adapters, "domain").groupBy("url").agg(F.min_by("adapter", "place").alias("adapter"))


def config_errors(site: Column) -> Column:
    """What is wrong with a new site's struct: missing fields, a bad id, country or address, limits."""
    blank = lambda c: F.trim(F.coalesce(site[c].cast("string"), F.lit(""))) == ""
    found = [F.when(blank(c), f"{c} is missing") for c in REQUIRED]
    found += [
        F.when(~blank("id") & ~site["id"].rlike("^[a-z0-9-]+$"), "id has other characters than a-z, 0-9 and hyphens"),
        F.when(~blank("country") & ~site["country"].rlike("^[A-Z]{2}$"), "country is no two-letter code"),
        F.when(~blank("latestUrl") & ~site["latestUrl"].rlike("^https?://[^/]+"), "latestUrl is no web address"),
        F.when(site["articleLimit"] <= 0, "articleLimit is not above 0"),
        F.when(site["candidateLimit"] < site["articleLimit"], "candidateLimit is below articleLimit"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def url_date(url: Column, pattern: str) -> Column:
    """A day from a site's own url form, by a pattern with year, month and day; null if it is none."""
    y, m, d = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3))
    return F.when(url.rlike(pattern), F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def loose_time(x: Column, zone: str = "+08:00") -> Column:
    """The first day, and time if there is one, in a text, in a fixed zone."""
    pattern = r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})(?:日)?(?:\s+(\d{1,2}):(\d{2}))?"
    part = lambda k, n: F.lpad(F.coalesce(F.nullif(F.regexp_extract(x, pattern, k), F.lit("")), F.lit("0")), n, "0")
    made = F.concat(part(1, 4), F.lit("-"), part(2, 2), F.lit("-"), part(3, 2), F.lit(" "), part(4, 2), F.lit(":"), part(5, 2), F.lit(zone))
    return F.when(x.rlike(pattern), F.try_to_timestamp(made, F.lit("yyyy-MM-dd HH:mmXXX")))


def reset_tags(articles: DataFrame) -> DataFrame:
    """Articles without tags; each also gets a pending tag stage with no attempts (see stage_reset)."""
    return articles.withColumn("tags", F.array().cast("array<string>"))


def stage_reset(status: DataFrame, articles: DataFrame, stage: str = "tag") -> DataFrame:
    """The status with ``stage`` pending and no attempts for every article."""
    anew = articles.select("article_id", F.lit(stage).alias("stage"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return status.where(F.col("stage") != stage).select("article_id", "stage", "status", "attempts").unionByName(anew)
