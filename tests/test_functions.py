"""Functions at their edges."""

import pytest
from pyspark.sql import functions as F

from newsdesk.functions import numbers, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.token_set(F.lit("The CAT, the-hat é"))) == ["the", "cat", "hat"]
    assert one(spark, text.token_set(F.lit("é 中"))) == []
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 0.5


def test_cleaning(spark):
    assert one(spark, text.collapse(F.lit(" a  b　c\n"))) == "a b c"
    assert one(spark, text.clean_body(F.lit("Read more: x\n\n a  b \n\n\nc"), ("read MORE",))) == "a b\n\nc"
    assert one(spark, text.clamp_words(F.lit("  a b  c "), 2)) == "a b"
    assert one(spark, text.truncate(F.lit("x" * 230))) == "x" * 230
    assert one(spark, text.truncate(F.lit("x" * 231))) == "x" * 227 + "..."
    assert one(spark, text.cjk_count(F.lit("a中文b"))) == 2


@pytest.mark.parametrize(
    ("raw", "plain"),
    [("&amp;#20154;", "人"), ("&#x1F600;!", "😀!"), ("a&lt;b&gt;&quot;&apos;", "a<b>\"'"), (" x​﻿ ", "x"), ("&#39;", "'"), ("no & entity", "no & entity"), ("�&#65;", "�A")],
)
def test_repair(spark, raw, plain):
    assert one(spark, text.repair(F.lit(raw))) == plain


def test_labels(spark):
    tags = F.array(F.lit(" Hot Topic "), F.lit("hot-topic"), F.lit(None), F.lit("b"))
    assert one(spark, text.normalise_tags(tags)) == ["hot-topic", "b"]
    assert one(spark, text.tag_label(F.lit("hot-topic"))) == "Hot topic"
    assert one(spark, text.country_code(F.lit(" my "))) == "MY" and one(spark, text.country_code(F.lit("mys"))) is None
    pair = F.struct(F.lit("e").alias("en"), F.lit("").alias("zh"))
    assert one(spark, text.pick(pair, "cn")) == "e"
    assert one(spark, text.region(F.lit(None).cast("string"))) == "World" and one(spark, text.region(F.lit("jp"))) == "Japan & South Korea"
    assert one(spark, text.mask_key(F.lit("sk-123456789"))) == "sk-123******6789" and one(spark, text.mask_key(F.lit("abc"))) == "ab******"
    assert one(spark, text.mask_connection(F.lit("db://me:pw@host/x"))) == "db://me:***@host/x"
    assert one(spark, text.place_deixis(F.lit("here at home"), F.lit("我国的"))) == ["我国", "here at home"]


def test_corruption(spark):
    assert one(spark, text.corrupted(F.lit("x &#20; y"))) and one(spark, text.corrupted(F.lit("xÃÂÅ"))) and not one(spark, text.corrupted(F.lit("été")))
    assert one(spark, text.needs_refill(F.lit("a�"))) and not one(spark, text.needs_refill(F.lit(None).cast("string")))


def test_urls(spark):
    assert one(spark, urls.canonical(F.lit("https://a.b/c/?z=1&utm_source=x&a=2&fbclid=q#top"))) == "https://a.b/c/?a=2&z=1"
    assert one(spark, urls.canonical(F.lit("https://a.b/c/"))) == "https://a.b/c"
    assert one(spark, urls.feed_form(F.lit("https://a.b/c/?z=1&UTM_x=1&a=2&mc_cid=3#t"))) == "https://a.b/c/?z=1&a=2&mc_cid=3"
    assert one(spark, urls.publisher(F.lit("https://www.a.b/c"))) == "a.b"
    assert one(spark, urls.date_hint(F.lit("https://a.b/2024/02/30/x"))) == "2024-02-30" and one(spark, urls.date_hint(F.lit("https://a.b/2024/13/01/x"))) is None
    assert one(spark, urls.same_site(F.lit("https://m.a.b/"), F.lit("a.b"))) and not one(spark, urls.same_site(F.lit("https://ba.b/"), F.lit("a.b")))
    blocks = lambda u, r: one(spark, urls.robots_blocks(F.lit(u), F.lit(r)))
    assert blocks("https://a.b/x/y?q=1", "/x*q=") and blocks("https://a.b", "/") and not blocks("https://a.b/x", "") and not blocks("https://a.b/x", "/x$")


@pytest.mark.parametrize(
    ("value", "en", "zh"),
    [(0.0, "0", "0"), (12.5, "12.5", "12.5"), (1234.0, "1,234", "1,234"), (-2_500_000.0, "-2.5M", "-250万"), (3e9, "3B", "30亿"), (None, "", "")],
)
def test_compact(spark, value, en, zh):
    x = F.lit(value).cast("double")
    assert (one(spark, numbers.compact_en(x)), one(spark, numbers.compact_zh(x))) == (en, zh)


@pytest.mark.parametrize(
    ("status", "error", "latency", "state"),
    [(401, None, 20_000, "auth_error"), (404, None, 1, "auth_error"), (429, "x", 1, "rate_limited"), (500, None, 1, "down"), (None, "Aborted", 1, "timeout"), (None, "reset", 1, "down"), (200, None, 10_000, "ok"), (200, None, 10_001, "slow")],
)
def test_health(spark, status, error, latency, state):
    assert one(spark, numbers.health_state(F.lit(status).cast("int"), F.lit(error).cast("string"), F.lit(latency))) == state


def test_small_numbers(spark):
    assert one(spark, numbers.percent_done(F.lit(3), F.lit(0), F.lit(2))) == 100 and one(spark, numbers.percent_done(F.lit(1), F.lit(8), F.lit(0))) == 13
    assert [one(spark, numbers.heat_class(F.lit(n), F.lit(8))) for n in (0, 1, 2, 4, 6, 8)] == [0, 1, 2, 3, 4, 4]
    assert one(spark, text.json_salvage(F.lit("say {\"a\": {\"b\": 1}} ok")).cast("string")) == '{"a":{"b":1}}'
