"""What the front page shows: the publish gate, filters, sections, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.text import region, region_rank, search_text
from newsdesk.shared import kept

#: Why an article isn't shown, in the order in which the reasons are looked at.
REASONS = ("notEnriched", "missingRender", "staleMtime", "missingFields")


def skip_reason(entry: DataFrame) -> Column:
    """The first reason against an entry, null if there is none. ``entry`` has status, rendered_at,
    packet_at, url, body, title_en, title_zh, summary_en and summary_zh."""
    there = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    complete = there("url") & there("body")
    for c in ("title_en", "title_zh", "summary_en", "summary_zh"):
        complete = complete & (F.coalesce(F.col(c), F.lit("")) != "")
    return (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "enriched", "notEnriched")
        .when(F.col("rendered_at").isNull(), "missingRender")
        .when(F.col("rendered_at") < F.col("packet_at"), "staleMtime")
        .when(~complete, "missingFields")
    )


def news_list(entries: DataFrame, keep: list[str]) -> DataFrame:
    """Entries that pass, the latest render of each url (ties to the earlier entry),
    only the columns of ``keep``. newest_first and reader_order sort them for the two lists."""
    passed = entries.where(skip_reason(entries).isNull()).withColumn("_url", F.trim("url"))
    # The latest is found on the map side too, so a url with very many renders is one row a task.
    shown = F.struct(*keep)
    found = passed.groupBy("_url").agg(F.max_by(shown, F.struct("rendered_at", (-F.col("ordinal")).alias("before"))).alias("_row"))
    return found.select("_row.*")


def newest_first(published: str) -> list[Column]:
    """T5: by the time of publication, newest first; what is no time counts as the epoch; then by place."""
    return [F.desc(F.coalesce(F.unix_millis(F.try_to_timestamp(published)), F.lit(0))), F.col("ordinal")]


def reader_order(published: str) -> list[Column]:
    """The reader's list sorts the text of the time, largest first, and doesn't read it."""
    return [F.desc(F.coalesce(published, F.lit(""))), F.col("ordinal")]


def by_name(total: str, name: str) -> list[Column]:
    """The largest total first, then names in the order of the Unicode collation, as readers expect."""
    return [F.desc(total), F.collate(F.col(name), "UNICODE"), F.col(name)]


def placed(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with their gapless place from 0 in an order.

    The sorted rows are kept once, each with the number that its partition and its place there make, so counts
    and places come from the same partitions however they are read. Nothing is sorted twice, no task
    holds more than its range, and what is sent around is one row a partition. Rows that are equal in the order
    have places beside each other; which of them comes first is decided once.
    """
    # The upper bits are the partition's number in the order, the lower 33 the place in it.
    numbered = kept(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part, own = F.shiftright("_row", 33), F.col("_row").bitwiseAND(2**33 - 1)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = numbered.join(F.broadcast(starts), part == F.col("_part"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], (own + F.col("_start")).cast("long").alias(out))


def skip_tally(entries: DataFrame) -> DataFrame:
    """How many entries each reason holds back, and the total under 'total'."""
    reasons = entries.select(skip_reason(entries).alias("reason")).where("reason IS NOT NULL")
    tally = reasons.rollup("reason").agg(F.count("*").cast("int").alias("n"))
    return tally.select(F.coalesce("reason", F.lit("total")).alias("reason"), "n")


def filtered(articles: DataFrame, query: str = "", countries: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
    """Any of the countries, any of the tags and the query's text, all at once."""
    found = articles
    if countries:
        found = found.where(F.upper(F.coalesce("country", F.lit(""))).isin(*countries))
    if tags:
        found = found.where(F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False)))
    if query.strip():
        text = search_text(F.col("title"), F.col("summary"), F.col("source"), F.array_join("tags", " "), F.col("country"), region(F.col("country")), F.col("author"))
        found = found.where(text.contains(query.strip().lower()))
    return found


def sections(articles: DataFrame, order: list[Column]) -> DataFrame:
    """How many articles each region's section holds, without the top story."""
    top = articles.orderBy(*order).limit(1).select(F.col("id").alias("top_id"))
    rest = articles.join(F.broadcast(top), F.col("id") == F.col("top_id"), "left_anti")
    counted = rest.groupBy(region(F.col("country")).alias("region")).agg(F.count("*").cast("int").alias("n"))
    return counted.select("region", region_rank(F.col("region")).alias("place"), "n")


def day_groups(articles: DataFrame, ts: Column, least: Column) -> DataFrame:
    """Articles by UTC day, 'unknown' without one, with the first id of each day."""
    day = F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))
    return articles.groupBy(day.alias("day")).agg(F.count("*").cast("int").alias("n"), F.min(least).alias("first_id"))


def facets(articles: DataFrame) -> DataFrame:
    """Each tag and how many articles have it."""
    return articles.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").cast("int").alias("n"))
