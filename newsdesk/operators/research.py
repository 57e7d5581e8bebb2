"""Research sessions: events in order, budgets, evidence, search hits, failover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_sequence(events: DataFrame, session: str, order: str, ts: Column) -> DataFrame:
    """Events numbered from 1, with what has passed since the session's first."""
    w = Window.partitionBy(session).orderBy(order)
    return events.withColumn("seq", F.row_number().over(w)).withColumn("elapsed", ts - F.first(ts).over(w))


def within_budget(events: DataFrame, session: str, order: str, cost: Column, requests: int, total: int) -> DataFrame:
    """Events that come before the session's requests or costs reach their limits."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0))
    seen = F.count("*").over(w)
    return events.withColumns({"spent": spent.cast("long"), "_seen": seen}).where((F.col("_seen") < requests) & (F.col("spent") < total)).drop("_seen")


def last_events(events: DataFrame, session: str, order: str, n: int = 40) -> DataFrame:
    """W11."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return events.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def evidence(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Each claim (doc_id, statement, excerpt, confidence) with its id and what speaks against it."""
    known = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    joined = claims.join(known, F.col("doc_id") == F.col("_doc"), "left")
    problems = F.array(
        F.when(F.col("_doc").isNull(), "unknown document"),
        F.when(F.coalesce(F.trim("statement"), F.lit("")) == "", "no statement"),
        F.when(F.col("_doc").isNotNull() & ~F.coalesce(F.contains("_text", "excerpt"), F.lit(False)), "excerpt is not in the document"),
        F.when(~F.coalesce(F.col("confidence").isin("high", "medium", "low"), F.lit(False)), "unknown confidence"),
    )
    number = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "statement", "excerpt"), 256)
    return joined.select("doc_id", "statement", "confidence", number.alias("evidence_id"), F.filter(problems, lambda p: p.isNotNull()).alias("problems"))


def first_valid(candidates: DataFrame, run: str, order: str, limit: int) -> DataFrame:
    """Candidates with ``ok`` in listing order until ``limit`` are found; those looked at on the way come too."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(w), F.lit(0))
    return candidates.withColumn("found_before", before.cast("int")).where(F.col("found_before") < limit)


def failover(attempts: DataFrame, call: str, n_providers: int) -> DataFrame:
    """Calls start at their number modulo the providers and go round; the first success answers."""
    place = F.pmod(F.col("provider") - F.col(call), F.lit(n_providers))
    return attempts.where("ok").groupBy(call).agg(F.min_by("provider", place).alias("provider"), (F.min(place) + 1).cast("int").alias("tries"))


def hits(results: DataFrame, query: str, url: Column) -> DataFrame:
    """Search hits by canonical url, the first of each; ranks keep the gaps of those that go."""
    return results.groupBy(query, url.alias("url")).agg((F.min("position") + 1).cast("int").alias("rank"))
