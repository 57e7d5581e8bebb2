"""Numbers and times as they are shown, scores, and how failures are classed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest whole number, halves up, also below zero."""
    return F.floor(x + 0.5)


def _tenths(x: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def _grouped(x: Column) -> Column:
    """Thousands with commas and at most three decimals."""
    return F.regexp_replace(F.format_number(x, 3), r"\.?0+$", "")


def compact_en(x: Column) -> Column:
    """I32: billions and millions with one decimal, else grouped; null is the empty text."""
    size, sign = F.abs(x.cast("double")), F.when(x < 0, "-").otherwise("")
    plain = F.regexp_replace(size.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    made = (
        F.when(size >= 1e9, F.concat(_tenths(size / 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(_tenths(size / 1e6), F.lit("M")))
        .when(size >= 1e3, _grouped(size))
        .otherwise(plain)
    )
    return F.coalesce(F.concat(sign, made), F.lit(""))


def compact_zh(x: Column) -> Column:
    """I32: hundred millions and ten thousands with one decimal, else grouped."""
    size, sign = F.abs(x.cast("double")), F.when(x < 0, "-").otherwise("")
    made = (
        F.when(size >= 1e8, F.concat(_tenths(size / 1e8), F.lit("亿")))
        .when(size >= 1e4, F.concat(_tenths(size / 1e4), F.lit("万")))
        .otherwise(_grouped(size))
    )
    return F.coalesce(F.concat(sign, made), F.lit(""))


def date_en(ts: Column) -> Column:
    """I33."""
    return F.date_format(ts, "d MMM yyyy")


def date_zh(ts: Column) -> Column:
    """I33."""
    return F.concat(F.year(ts).cast("string"), F.lit("年"), F.month(ts).cast("string"), F.lit("月"), F.dayofmonth(ts).cast("string"), F.lit("日"))


def _millis(ts: Column) -> Column:
    """Milliseconds since 1970, rounded to the nearest, halves away from 0; unix_millis() would cut them."""
    us = F.unix_micros(ts)
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


def _seconds(a: Column, b: Column) -> Column:
    return _millis(a) / 1000 - _millis(b) / 1000


def _units(s: Column, *steps: tuple[int, int, str], whole=F.floor) -> Column:
    """The first unit whose limit a number of seconds is below."""
    made = None
    for limit, size, form in steps:
        shown = F.format_string(form, whole(s / size).cast("long"))
        made = F.when(s < limit, shown) if made is None else made.when(s < limit, shown)
    return made


_ENDLESS = 1 << 60


def ago(ts: Column, as_of: Column) -> Column:
    """How long before ``as_of``; a dash without a time."""
    s = F.greatest(F.floor(_seconds(as_of, ts)), F.lit(0))
    steps = ((60, 1, "%ds ago"), (3600, 60, "%dm ago"), (86400, 3600, "%dh ago"), (_ENDLESS, 86400, "%dd ago"))
    return F.when(ts.isNull(), "-").when(s < 5, "just now").otherwise(_units(s, *steps))


def until(ts: Column, as_of: Column) -> Column:
    """When a retry is due; null without a time. Minutes and hours are rounded up."""
    s = half_up(_seconds(ts, as_of))
    steps = ((60, 1, "retry in %ds"), (3600, 60, "retry in %dm"), (_ENDLESS, 3600, "retry in %dh"))
    return F.when(s <= 0, "retry due").otherwise(_units(s, *steps, whole=F.ceil))


def duration(start: Column, end: Column, as_of: Column) -> Column:
    """How long a job took, or has taken so far; a dash without a start."""
    s = F.greatest(half_up(_seconds(F.coalesce(end, as_of), start)), F.lit(0)).cast("long")
    return F.when(start.isNull(), "-").when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60).cast("long"), (s % 60).cast("long")))


def minutes_ago(ts: Column, as_of: Column, language: str = "en") -> Column:
    """Whole minutes before ``as_of`` in the reader's narrow form; empty without a time."""
    m = F.greatest(F.floor(_seconds(as_of, ts) / 60), F.lit(0)).cast("long")
    return F.when(ts.isNull(), "").otherwise(F.format_string("%d分钟前" if language == "cn" else "%dmin ago", m))


def number_or(x: Column, default: int = 0) -> Column:
    """A number that is there and not 0, else the default."""
    return F.coalesce(F.when(~F.isnan(x.cast("double")) & (x != 0), x), F.lit(default))


def percent_done(completed: Column, candidates: Column, target: Column) -> Column:
    """Of the candidates, or of the target where there are none, 100 at most."""
    of = F.coalesce(F.when(candidates > 0, candidates), F.when(target > 0, target), F.lit(1))
    return F.least(F.lit(100), half_up(100 * completed / of)).cast("int")


def heat_class(count: Column, most: Column) -> Column:
    """0 for none, then the quarter of the largest count that a count falls in."""
    ratio = count / F.when(most > 0, most)
    return F.when(F.coalesce(count, F.lit(0)) == 0, 0).when(ratio < 0.25, 1).when(ratio < 0.5, 2).when(ratio < 0.75, 3).otherwise(4)


def extraction_quality(title: Column, published: Column, author: Column, body: Column, final_url: Column) -> Column:
    """A score from 0 to 1 in whole hundredths, halves up: 20 for a title, 15 for a date, 10 for an
    author, up to 45 for the body's length, full at 500 characters, and 10 for a final address."""
    there = lambda c, w: F.when(F.coalesce(c, F.lit("")) != "", w).otherwise(0)
    size = F.char_length(F.coalesce(body, F.lit("")))
    bulk = F.least(F.lit(45), F.floor((2 * size * 45 + 500) / 1000))
    return F.least(F.lit(100), there(title, 20) + there(published, 15) + there(author, 10) + bulk + there(final_url, 10)) / 100


#: Statuses that end a crawl and statuses that are worth another attempt.
HARD_STOP = (403,)
RETRY = (408, 425, 429, 500, 502, 503, 504)


def retry_class(status: Column) -> Column:
    """Stop, retry or fail; no status means that the network failed."""
    return F.when(status.isin(*HARD_STOP), "stop").when(status.isNull() | status.isin(*RETRY), "retry").otherwise("fail")


def health_state(status: Column, error: Column, latency_ms: Column) -> Column:
    """The first that applies, in this order."""
    text = F.lower(error)
    return (
        F.when(status.isin(401, 403), "auth_error")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "down")
        .when(status >= 400, "auth_error")
        .when((error != "") & (text.contains("abort") | text.contains("timed out") | text.contains("timeout")), "timeout")
        .when(error != "", "down")
        .when(latency_ms > 10_000, "slow")
        .otherwise("ok")
    )
