"""Enrichment packets: what goes in, what came out, and the columns that a page is made from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.numbers import compact_en, compact_zh, half_up

ENTRY_STATUSES = ("enriched", "invalid", "failed", "duplicate")


def some(c: str) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.col(c), F.lit("")) != ""


def enrichable(articles: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` articles with title, body and url."""
    return articles.where(some("title") & some("body") & some("url")).orderBy(order).limit(limit)


def persistable(articles: DataFrame) -> DataFrame:
    """P3."""
    return articles.where(some("title") & some("url"))


def backfill(articles: DataFrame, limit: int) -> DataFrame:
    """Enriched articles that lack tags or a country."""
    done = (F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0) & some("country")
    return articles.where((F.col("status") == "enriched") & ~done).orderBy("id").limit(limit)


def cutoff_date(published: Column) -> Column:
    """The day of a timestamp in UTC, or the first ten characters of what is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(published), "yyyy-MM-dd"), F.substring(published, 1, 10))


def packet_counts(entries: DataFrame, packet: str) -> DataFrame:
    """Entries of each status and the urls of failures and duplicates, in order."""
    of = lambda s: F.count_if(F.col("status") == s).cast("int")
    urls = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("ordinal", "url")))), lambda x: x["url"])
    return entries.groupBy(packet).agg(
        F.count("*").cast("int").alias("requested"), of("enriched").alias("count"), of("invalid").alias("invalid_count"), of("failed").alias("failure_count"),
        of("duplicate").alias("duplicate_count"), urls("failed").alias("failures"), urls("duplicate").alias("duplicates"),
    )


def clean_sources(sources: Column, cutoff: Column) -> Column:
    """Sources with a web address that are no newer than the cutoff; the core source always stays."""

    def keep(s: Column) -> Column:
        late = F.coalesce(s["publishedAt"].rlike(r"^\d{4}-\d{2}-\d{2}") & (F.substring(s["publishedAt"], 1, 10) > cutoff), F.lit(False))
        return (s["id"] == "core") | (F.coalesce(s["url"].rlike("^https?://"), F.lit(False)) & ~late)

    return F.filter(F.coalesce(sources, F.array()), keep)


def clean_references(facts: Column, sources: Column) -> Column:
    """Facts without references to sources that are gone."""
    ids = F.array_union(F.array(F.lit("core")), F.transform(sources, lambda s: s["id"]))
    return F.transform(facts, lambda f: f.withField("sourceId", F.when(F.array_contains(ids, f["sourceId"]), f["sourceId"])))


def answer_text(items: Column) -> Column:
    """The texts of an answer's items, those of the kind output_text, as lines."""
    parts = F.flatten(F.transform(items, lambda i: F.coalesce(i["content"], F.array())))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: p["text"]), "\n")


def citations(annotations: Column) -> Column:
    """Cited urls in order, the first of each, titled by themselves where they have no title."""
    cited = F.filter(annotations, lambda a: (a["type"] == "url_citation") & F.coalesce(a["url"] != "", F.lit(False)))
    urls = F.transform(cited, lambda a: a["url"])
    first = F.filter(cited, lambda a, i: F.array_position(urls, a["url"]) == i + 1)
    return F.transform(first, lambda a: F.struct(F.coalesce(F.when(a["title"] != "", a["title"]), a["url"]).alias("title"), a["url"].alias("url")))


def hero_metrics(dimensions: Column, most: int = 3) -> Column:
    """The first numeric metric of each dimension, the first three of these."""
    firsts = F.transform(dimensions, lambda d: F.get(F.filter(d["metrics"], lambda m: m["value"].isNotNull()), 0))
    return F.slice(F.filter(firsts, lambda m: m.isNotNull()), 1, most)


def bar_rows(metrics: Column) -> Column:
    """Numeric metrics with their label, shown value and whole percent of the largest."""
    numeric = F.filter(metrics, lambda m: m["value"].isNotNull())
    most = F.array_max(F.transform(numeric, lambda m: F.abs(m["value"])))
    return F.transform(
        numeric,
        lambda m: F.struct(m["label"]["en"].alias("label"), compact_en(m["value"]).alias("shown"), F.when(most > 0, half_up(100 * F.abs(m["value"]) / most)).otherwise(0).cast("int").alias("percent")),
    )


def timeline_items(dimension: Column) -> Column:
    """Metrics that have a period, else the supporting facts."""
    dated = F.filter(dimension["metrics"], lambda m: F.coalesce(m["period"]["en"], F.lit("")) != "")
    shown = F.transform(dated, lambda m: F.concat(m["period"]["en"], F.lit(": "), m["label"]["en"]))
    return F.when(F.size(dated) > 0, shown).otherwise(F.transform(dimension["supportingFacts"], lambda f: f["text"]["en"]))


def numbered(items: Column) -> Column:
    """Two-digit numbers, and which is the last."""
    return F.transform(items, lambda x, i: F.struct(F.lpad((i + 1).cast("string"), 2, "0").alias("number"), (i == F.size(items) - 1).alias("last"), x.alias("item")))


def map_rows(metrics: Column) -> Column:
    """A map card's numeric metrics: label and shown value with unit, in both languages."""
    numeric = F.filter(F.coalesce(metrics, F.array()), lambda m: m["value"].isNotNull())
    unit = lambda m, x: F.coalesce(m["unit"][x], F.lit(""))
    return F.transform(
        numeric,
        lambda m: F.struct(m["label"].alias("label"), F.concat(compact_en(m["value"]), F.lit(" "), unit(m, "en")).alias("en"), F.concat(compact_zh(m["value"]), unit(m, "zh")).alias("zh")),
    )


def quote_card(dimension: Column, sources: Column) -> Column:
    """A quote card: the first supporting fact with the publisher of its source, and the other
    facts; null without facts."""
    facts = F.coalesce(dimension["supportingFacts"], F.array())
    first = F.get(facts, 0)
    source = F.get(F.filter(F.coalesce(sources, F.array()), lambda s: s["id"] == first["sourceId"]), 0)
    card = F.struct(first["text"].alias("text"), source["publisher"].alias("publisher"), F.slice(facts, 2, F.greatest(F.size(facts), F.lit(1))).alias("rest"))
    return F.when(F.size(facts) > 0, card)


def body_kind(dimension: Column) -> Column:
    """Which of the presentations a dimension gets: number, bars, timeline, map, quote or facts. Those
    of numbers need metrics; what isn't known is a list of facts."""
    kind, any_metric = dimension["suggestedPresentation"], F.size(F.coalesce(dimension["metrics"], F.array())) > 0
    shown = F.when(kind.isin("comparison", "chart"), "bars").when(kind.isin("number", "map"), kind)
    return F.coalesce(F.when(kind.isin("timeline", "quote"), kind), F.when(any_metric, shown), F.lit("facts"))


def pages_of(entries: DataFrame) -> DataFrame:
    """K3: (render_file, html, failure) of entries (render_file, entry): an entry without content or a
    title in either language is a failure of its own and stops no other."""
    content = F.col("entry.infographicContent")
    title = F.coalesce(content["coreNews"]["displayTitle"]["en"], content["coreNews"]["displayTitle"]["zh"], F.lit(""))
    failure = F.when(content.isNull(), "no content").when(F.trim(title) == "", "no title")
    return entries.select("render_file", F.when(failure.isNull(), page(content)).alias("html"), failure.alias("failure"))


def answered(articles: DataFrame, provider: Callable[[dict], dict], model: str, key: str = "article_id") -> DataFrame:
    """What an injected provider makes of each article: (key, content as JSON, provider, error). ``provider``
    takes an article as a dict and returns the content; it runs on executors, article by article, and
    what it raises is that article's error. recorded() is the provider of captured answers."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                try:
                    made.append({key: row[key], "content": json.dumps(provider(row), ensure_ascii=False, sort_keys=True), "provider": model, "error": None})
                except Exception as failed:  # one article's failure is data
                    made.append({key: row[key], "content": None, "provider": model, "error": str(failed)[:500]})
            yield pa.RecordBatch.from_pylist(made, pa.schema([(key, pa.int64()), ("content", pa.string()), ("provider", pa.string()), ("error", pa.string())]))

    return articles.withColumn(key, F.col(key).cast("long")).mapInArrow(run, f"{key} long, content string, provider string, error string")


def recorded(articles: DataFrame, answers: DataFrame, model: str, key: str = "article_id") -> DataFrame:
    """X3, the default: recorded answers (key, content) joined to the articles; one without is an error row."""
    both = articles.select(key).join(answers.select(key, "content"), key, "left")
    return both.select(key, "content", F.lit(model).alias("provider"), F.when(F.col("content").isNull(), "no recorded answer").alias("error"))


def route(attempts: DataFrame) -> DataFrame:
    """U4, U8: for each url the page that counts. The site's own fetcher goes first; a block (403,
    429, robots) ends it there, other failures and missing title or body go to the generic fetcher.

    ``attempts`` has url, fetcher (adapter or generic), status, robots, title and body, and may have their number,
    attempt: the first of a fetcher counts, without numbers the smallest row.
    """
    page = F.struct("status", "robots", "title", "body")
    first = F.min_by(page, F.struct("attempt", page) if "attempt" in attempts.columns else page)
    mine = attempts.where(F.col("fetcher") == "adapter").groupBy("url").agg(first.alias("a"))
    other = attempts.where(F.col("fetcher") == "generic").groupBy("url").agg(first.alias("g"))
    both = mine.join(other, "url", "full")
    full = lambda x: (F.coalesce(F.col(f"{x}.title"), F.lit("")) != "") & (F.coalesce(F.col(f"{x}.body"), F.lit("")) != "")
    blocked = F.coalesce(F.col("a.status").isin(403, 429) | F.col("a.robots"), F.lit(False))
    return both.select(
        "url",
        F.when(blocked, None).when(full("a"), "adapter").when(full("g"), "generic").alias("fetcher"),
        F.when(blocked, "blocked").when(full("a"), None).when(F.col("a").isNull(), "no adapter").otherwise("adapter failed").alias("fallback_reason"),
    )


def settled(attempts: DataFrame, key: str, order: str, most: int = 2) -> DataFrame:
    """What a call came to after at most ``most`` tries of its recorded ones: a success or a
    failure that isn't worth another try ends it. ``attempts`` has ok and class (stop, retry or fail)."""
    w = Window.partitionBy(key).orderBy(order)
    ended = F.coalesce(F.max((F.col("ok") | (F.col("class") != "retry")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = attempts.withColumns({"_n": F.row_number().over(w), "_ended": ended}).where((F.col("_n") <= most) & (F.col("_ended") == 0))
    return tried.groupBy(key).agg(F.max("_n").cast("int").alias("tries"), F.max_by("ok", "_n").alias("ok"), F.max_by("class", "_n").alias("class"))


def page(content: Column) -> Column:
    """A plain page of a content's title, summary, facts and main numbers, all escaped. The look is left to style sheets."""
    from newsdesk.functions.text import html_escape

    text = lambda p: html_escape(F.coalesce(p["en"], p["zh"], F.lit("")))
    core = content["coreNews"]
    facts = F.array_join(F.transform(F.coalesce(core["keyFacts"], F.array()), lambda f: F.concat(F.lit("<li>"), text(f["text"]), F.lit("</li>"))), "")
    numbers = F.array_join(F.transform(hero_metrics(content["dimensions"]), lambda m: F.concat(F.lit("<dt>"), text(m["label"]), F.lit("</dt><dd>"), compact_en(m["value"]), F.lit("</dd>"))), "")
    return F.concat(F.lit("<!doctype html><h1>"), text(core["displayTitle"]), F.lit("</h1><p>"), text(core["summary"]), F.lit("</p><ul>"), facts, F.lit("</ul><dl>"), numbers, F.lit("</dl>"))
