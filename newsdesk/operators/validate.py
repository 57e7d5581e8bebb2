"""The validator of enrichments: errors that block and warnings that don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.text import cjk_count, place_deixis, word_count

# Relationships, the texts of messages below, and targets in English words and Chinese characters.
RELATIONSHIPS = ("historical-context", "comparison", "cause", "consequence", "stakeholder-impact", "contradiction", "future-signal")
BUDGETS = {
    "displayTitle": (12, 20),
    "summary": (40, 70),
    "keyFact": (20, 35),
    "insight": (30, 50),
    "keyTakeaway": (25, 45),
    "watchItem": (15, 28),
    "uncertainty": (15, 28),
    "timelineEvent": (12, 22),
}


def _some(*messages: Column) -> Column:
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def _each(items: Column, messages) -> Column:
    """The messages of all items of a list, none if it is null."""
    return F.flatten(F.transform(F.coalesce(items, F.array()), messages))


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def pair(p: Column, label: Column) -> Column:
    """What a pair of texts lacks."""
    return _some(
        F.when(_blank(p["en"]), F.concat(label, F.lit(" is missing English (en)"))),
        F.when(_blank(p["zh"]), F.concat(label, F.lit(" is missing Chinese (zh)"))),
    )


def budget(p: Column, kind: str, label: Column) -> Column:
    """Where a pair is longer than its kind's target."""
    en, zh = BUDGETS[kind]
    return _some(
        F.when(word_count(p["en"]) > en, F.concat(label, F.lit(f" (en) over {en}-word target"))),
        F.when(cjk_count(p["zh"]) > zh, F.concat(label, F.lit(f" (zh) over {zh}-character target"))),
    )


def errors(content: Column, title: Column, url: Column, cutoff: Column) -> Column:
    """Distinct messages in the order in which the parts are looked at. ``cutoff`` is YYYY-MM-DD."""
    core, sources, dims = content["coreNews"], content["sources"], content["dimensions"]
    named = lambda d: F.coalesce(d["title"]["en"], F.lit("untitled"))
    quoted = lambda kind, x, rest: F.concat(F.lit(f'{kind} "'), x, F.lit(f'"{rest}'))
    ids = F.transform(F.coalesce(sources, F.array()), lambda s: s["id"])
    declared = F.array_union(F.array(F.lit("core")), ids)
    used = F.concat(
        _each(dims, lambda d: F.concat(F.transform(F.coalesce(d["supportingFacts"], F.array()), lambda f: f["sourceId"]), F.transform(F.coalesce(d["metrics"], F.array()), lambda m: m["sourceId"]))),
        F.transform(F.coalesce(content["timeline"], F.array()), lambda t: t["sourceId"]),
    )
    twice = F.filter(F.array_distinct(ids), lambda i: (i != "core") & (F.size(F.filter(ids, lambda x: x == i)) > 1))
    found = [
        _some(
            F.when(~core["originalTitle"].eqNullSafe(title), "Core-news originalTitle was not preserved exactly"),
            F.when(~core["sourceUrl"].eqNullSafe(url), "Core-news sourceUrl was not preserved exactly"),
        ),
        pair(core["displayTitle"], F.lit("Core-news displayTitle")),
        pair(core["summary"], F.lit("Core-news summary")),
        _some(F.when(F.coalesce(F.size(core["keyFacts"]), F.lit(0)) <= 0, "Core-news key facts are missing")),
        F.flatten(F.transform(F.coalesce(core["keyFacts"], F.array()), lambda f, i: pair(f["text"], F.concat(F.lit("keyFacts["), i.cast("string"), F.lit("].text"))))),
        pair(content["centralInsight"], F.lit("centralInsight")),
        pair(content["keyTakeaway"], F.lit("keyTakeaway")),
        _some(
            F.when(F.coalesce(F.size(dims), F.lit(0)) <= 0, "At least one enrichment dimension is required"),
            F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, "At least the core source is required"),
        ),
        _each(sources, lambda s: F.when(_blank(s["id"]), F.array(F.lit("A source is missing its ID"))).otherwise(
            F.concat(_some(F.when(~F.coalesce(s["url"].rlike("^https?://"), F.lit(False)), quoted("Source", s["id"], " has an invalid URL"))), pair(s["title"], quoted("Source", s["id"], " title"))))),
        F.transform(twice, lambda i: quoted("Duplicate source ID", i, "")),
        _each(dims, lambda d: F.concat(
            pair(d["title"], quoted("Dimension", named(d), " title")),
            _some(F.when(~F.coalesce(d["relationship"].isin(*RELATIONSHIPS), F.lit(False)), F.concat(F.lit('Dimension "'), named(d), F.lit('" has invalid relationship "'), F.coalesce(d["relationship"], F.lit("")), F.lit('"')))),
            pair(d["insight"], quoted("Dimension", named(d), " insight")),
            _each(d["supportingFacts"], lambda f: pair(f["text"], quoted("Dimension", named(d), " supporting fact"))))),
        _each(content["timeline"], lambda t: pair(t["event"], F.lit("A timeline event"))),
        _each(content["whatToWatch"], lambda w: pair(w, F.lit("A whatToWatch item"))),
        _each(content["uncertainties"], lambda w: pair(w, F.lit("An uncertainties item"))),
        F.transform(F.array_except(F.filter(used, lambda u: ~_blank(u)), declared), lambda u: quoted("Unknown source reference", u, "")),
        F.filter(F.transform(F.coalesce(sources, F.array()), lambda s: F.when(s["publishedAt"].rlike(r"^\d{4}-\d{2}-\d{2}") & (F.substring(s["publishedAt"], 1, 10) > cutoff),
            F.concat(F.lit('Source "'), s["id"], F.lit('" is newer than the '), cutoff, F.lit(" research cutoff")))), lambda m: m.isNotNull()),
    ]
    whole = F.array_distinct(F.flatten(F.array(*found)))
    return F.when(content.isNull(), F.array(F.lit("Enrichment must be a JSON object"))).otherwise(whole)


def warnings(content: Column) -> Column:
    """Lengths over target, unplaced home countries, too few sources, too many dimensions."""
    core, dims = content["coreNews"], content["dimensions"]
    facts = F.transform(F.coalesce(core["keyFacts"], F.array()), lambda f: f["text"])
    insights = F.transform(F.coalesce(dims, F.array()), lambda d: d["insight"])
    prose = F.concat(
        F.array(core["displayTitle"], core["summary"], content["centralInsight"], content["keyTakeaway"]), facts, insights,
        F.transform(F.coalesce(dims, F.array()), lambda d: d["title"]), F.coalesce(content["whatToWatch"], F.array()), F.coalesce(content["uncertainties"], F.array()),
        F.transform(F.coalesce(content["timeline"], F.array()), lambda t: t["event"]),
        _each(dims, lambda d: F.transform(F.coalesce(d["supportingFacts"], F.array()), lambda f: f["text"])),
        _each(dims, lambda d: F.flatten(F.transform(F.coalesce(d["metrics"], F.array()), lambda m: F.array(m["label"], m["unit"], m["period"])))),
        F.transform(F.coalesce(content["sources"], F.array()), lambda s: s["title"]),
    )
    home = F.array_distinct(_each(prose, lambda p: place_deixis(p["en"], p["zh"])))
    found = [
        budget(core["displayTitle"], "displayTitle", F.lit("displayTitle")),
        budget(core["summary"], "summary", F.lit("summary")),
        F.flatten(F.transform(facts, lambda f, i: budget(f, "keyFact", F.concat(F.lit("keyFacts["), i.cast("string"), F.lit("]"))))),
        budget(content["keyTakeaway"], "keyTakeaway", F.lit("keyTakeaway")),
        _each(dims, lambda d: budget(d["insight"], "insight", F.concat(F.lit('Dimension "'), F.coalesce(d["title"]["en"], F.lit("untitled")), F.lit('" insight')))),
        _each(content["timeline"], lambda t: budget(t["event"], "timelineEvent", F.lit("timeline event"))),
        _each(content["whatToWatch"], lambda w: budget(w, "watchItem", F.lit("whatToWatch item"))),
        _each(content["uncertainties"], lambda w: budget(w, "uncertainty", F.lit("uncertainties item"))),
        _some(
            F.when(F.size(home) > 0, F.concat(F.lit("Unresolved first-person place deixis ("), F.array_join(home, ", "), F.lit(")"))),
            F.when(F.size(content["sources"]) == 1, "No external supporting sources were added"),
            F.when(F.size(dims) > 8, "More than eight dimensions may be too dense for one infographic"),
        ),
    ]
    return F.array_distinct(F.flatten(F.array(*found)))
