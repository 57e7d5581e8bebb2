"""Queries on texts, URLs and pages: cleaning, tokens, duplicates, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions import numbers, text, urls
from newsdesk.operators import dedup, html
from newsdesk.plans.registry import query, table



_TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''))"
#: Made-up times: two hours an article, moved by up to ten; one in nineteen has none.
_TS = "CASE WHEN doc_id % 19 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours((2 * doc_id + doc_id * 37 % 11)::INT) END"


@query(
    f"""WITH t AS (SELECT doc_id, 'u' || doc_id AS url, lang, {_TS} AS ts, {_TOKENS} AS tokens FROM documents),
    p AS (SELECT a.doc_id, a.lang, b.doc_id AS match_id, b.ts, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) AS x, len(b.tokens) AS y
          FROM t a JOIN t b ON a.lang = b.lang AND a.url <> b.url AND b.ts > a.ts - INTERVAL 48 HOUR AND (b.ts < a.ts OR b.ts = a.ts AND b.doc_id < a.doc_id)
          QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.ts DESC, b.doc_id DESC) <= 20),
    s AS (SELECT doc_id, lang, match_id, ts, CASE WHEN x = 0 OR y = 0 THEN 0.0 ELSE i::DOUBLE / (x + y - i) END AS score FROM p)
    SELECT doc_id, lang, match_id, score FROM s WHERE score >= 0.5
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ts DESC, match_id DESC) = 1"""
)
def dedup_best_recent(spark: SparkSession, d: str) -> DataFrame:
    hours = (2 * F.col("doc_id") + F.col("doc_id") * 37 % 11).cast("int")
    ts = F.when(F.col("doc_id") % 19 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=hours))
    url = F.concat(F.lit("u"), F.col("doc_id").cast("string"))
    return dedup.best_recent(table(spark, d, "documents"), "doc_id", url, "lang", ts, F.col("text"))


@query(
    f"""WITH t AS (SELECT lang, list_sort({_TOKENS}) AS tokens, min(doc_id) AS id FROM documents GROUP BY 1, 2),
    e AS (SELECT lang, id, unnest(tokens) AS w FROM t), n AS (SELECT id, len(tokens) AS n FROM t),
    c AS (SELECT a.lang, a.id AS a, b.id AS b, count(*) AS i FROM e a JOIN e b ON a.lang = b.lang AND a.w = b.w AND a.id < b.id GROUP BY 1, 2, 3)
    SELECT lang, a, b, i::DOUBLE / (x.n + y.n - i) AS score FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE i::DOUBLE / (x.n + y.n - i) >= 0.5"""
)
def dedup_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.all_pairs(table(spark, d, "documents"), "doc_id", "lang", F.col("text"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def existing_anti(spark: SparkSession, d: str) -> DataFrame:
    return dedup.unseen(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query(
    r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)),
        lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10) || chr(10)) AS cleaned FROM documents"""
)
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_lines(F.col("text")).alias("cleaned"))


@query(
    r"""SELECT doc_id, array_to_string(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')[1:30], ' ') AS gist,
        len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> ''))::INT AS words, 0 AS cjk FROM documents"""
)
def text_clamp(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.clamp_words(x, 30).alias("gist"), text.word_count(x).alias("words"), text.cjk_count(x).alias("cjk"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
        SELECT doc_id, CASE WHEN length(s) <= 230 THEN s ELSE rtrim(left(s, 227)) || '...' END AS summary,
               CASE WHEN length(s) <= 200 THEN s ELSE rtrim(left(s, 197)) || '...' END AS reader FROM t"""
)
def truncate_summary(spark: SparkSession, d: str) -> DataFrame:
    x = text.collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.truncate(x).alias("summary"), text.truncate(x, 200).alias("reader"))


@query(
    r"""WITH t AS (SELECT p_partkey, list_transform([p_name, p_type, p_brand, ' ' || p_name, ''], lambda x: regexp_replace(lower(trim(x)), '\s+', '-', 'g')) AS l FROM part)
        SELECT p_partkey, array_to_string([l[1], l[2], l[3]], ',') AS tags, upper(left(replace(l[1], '-', ' '), 1)) || substr(replace(l[1], '-', ' '), 2) AS label,
               CASE WHEN p_partkey % 3 = 0 THEN 'MY' END AS country FROM t"""
)
def tag_normalise(spark: SparkSession, d: str) -> DataFrame:
    tags = text.normalise_tags(F.array("p_name", "p_type", "p_brand", F.concat(F.lit(" "), "p_name"), F.lit("")))
    raw = F.when(F.col("p_partkey") % 3 == 0, " my").when(F.col("p_partkey") % 3 == 1, "m1")
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(tags, ",").alias("tags"), text.tag_label(F.get(tags, 0)).alias("label"), text.country_code(raw).alias("country")
    )


_SPLIT = r"""WITH t AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') AS base,
  list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '') AS q FROM pages)"""


@query(
    _SPLIT + r""", k AS (SELECT page_id, base, list_sort(list_filter(q, lambda p: NOT regexp_matches(p, '(?i)^(?:utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(?:=|$)'))) AS c,
        list_filter(q, lambda p: NOT regexp_matches(p, '(?i)^(?:utm_[^=]*|fbclid|gclid)(?:=|$)')) AS f FROM t)
    SELECT page_id, regexp_replace(base || CASE WHEN len(c) > 0 THEN '?' || array_to_string(c, '&') ELSE '' END, '/$', '') AS canonical,
           base || CASE WHEN len(f) > 0 THEN '?' || array_to_string(f, '&') ELSE '' END AS feed_form FROM k"""
)
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.feed_form(u).alias("feed_form"))


@query(
    r"""WITH t AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)
        SELECT page_id, regexp_replace(h, '^www\.', '') AS publisher, h = 'example.com' OR ends_with(h, '.example.com') AS same_site,
               (h = 'example.com' OR ends_with(h, '.example.com')) AND regexp_matches(p, '^/(en|de)/\d+') AS is_link,
               CASE WHEN regexp_matches(p, '/(20\d{2})[/-](0[1-9]|1[0-2])[/-]([0-2]\d|3[01])(?:/|$)') THEN '?' END AS date_hint FROM t"""
)
def link_rules(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", urls.publisher(u).alias("publisher"), urls.same_site(u, F.lit("example.com")).alias("same_site"),
        urls.site_link(u, "example.com", r"^/(en|de)/\d+").alias("is_link"), urls.date_hint(u).alias("date_hint"),
    )


@query(
    r"""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y/%m/%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y/%m') ELSE strftime(ts, '%Y/%d/%m') END AS p, event_id % 3 = 0 AS last FROM events)
        SELECT event_id, CASE WHEN regexp_matches(p, '^\d{4}[/-](0[1-9]|1[0-2])[/-]\d\d$') THEN replace(p, '/', '-') END AS date_hint FROM e"""
)
def date_hints(spark: SparkSession, d: str) -> DataFrame:
    """Days in addresses of four forms; those of a month alone, or of a day where the month should be, are none."""
    form = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 4
    day = F.when(k == 0, form("yyyy/MM/dd")).when(k == 1, form("yyyy-MM-dd")).when(k == 2, form("yyyy/MM")).otherwise(form("yyyy/dd/MM"))
    url = F.concat(F.lit("https://news.example/"), day, F.when(F.col("event_id") % 3 == 0, "").otherwise("/story?d=1"))
    return table(spark, d, "events").select("event_id", urls.date_hint(url).alias("date_hint"))


@query(
    r"""WITH r(rule, n) AS (VALUES ('/en/*2', 1), ('', 2), ('/fr', 3), ('/*?page=', 4), ('/es/$', 5)),
        t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS target FROM pages)
        SELECT page_id, n::INT AS rule FROM t, r WHERE rule <> '' AND CASE n WHEN 1 THEN regexp_matches(target, '^/en/.*2') WHEN 3 THEN starts_with(target, '/fr')
            WHEN 4 THEN regexp_matches(target, '^/.*\?page=') ELSE starts_with(target, '/es/$') END"""
)
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    # A robots file has some dozens of rules, so each page meets each as an array's element.
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("n")) for n, r in enumerate(("/en/*2", "", "/fr", "/*?page=", "/es/$"), 1)])
    each = table(spark, d, "pages").select("page_id", "url", F.explode(rules).alias("r"))
    return each.where(urls.robots_blocks(F.col("url"), F.col("r.rule"))).select("page_id", F.col("r.n").alias("rule"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
        p AS (SELECT page_id, trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
          list_filter(list_transform(regexp_extract_all(h, '(?is)<(?:p|h2|h3|li)\b[^>]*>((?:[^<]|<(?:/?(?:b|i|em|strong|a|span)\b[^>]*|br\s*/?)>)*)', 1),
            lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM t)
        SELECT page_id, title, len(ps)::INT AS n_paragraphs, array_to_string(ps, chr(10) || chr(10)) AS body FROM p"""
)
def html_title_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    found = html.article(table(spark, d, "pages"), "html")
    return found.select("page_id", "title", F.size("paragraphs").alias("n_paragraphs"), F.array_join("paragraphs", "\n\n").alias("body"))


@query(
    r"""SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
        '&amp;', '&'), '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>')) AS title FROM pages"""
)
def entity_repair(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", text.repair(title).alias("title"))


@query(
    r"""SELECT doc_id, regexp_matches(text, '&#\d+;|&amp;#\d+;') OR regexp_matches(text, '[ÃÂÅ-ÖØ-öø-ÿ]{3,}') OR contains(text, chr(65533)) AS corrupted,
        contains(text, chr(65533)) AS refill FROM documents"""
)
def corruption_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.corrupted(F.col("text")).alias("corrupted"), text.needs_refill(F.col("text")).alias("refill"))


@query(
    """SELECT doc_id, (20 + CASE WHEN doc_id % 2 = 0 THEN 15 ELSE 0 END + 10 + least(45, (2 * length(text) * 45 + 500) // 1000)) / 100.0 AS quality FROM documents"""
)
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    published = F.when(F.col("doc_id") % 2 == 0, "2024-01-01")
    return table(spark, d, "documents").select("doc_id", numbers.extraction_quality(F.lit("t"), published, F.col("source"), F.col("text"), F.lit("")).alias("quality"))


@query(
    r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
        CASE WHEN length(source) <= 10 THEN left(source, 2) || '******' ELSE left(source, 6) || '******' || right(source, 4) END AS masked FROM documents"""
)
def escape_and_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.html_escape(F.col("text")).alias("escaped"), text.mask_key(F.col("source")).alias("masked"))


@query(
    """SELECT event_id, (props->>'k')::INT AS k FROM events"""
)
def json_salvaged(spark: SparkSession, d: str) -> DataFrame:
    """Answers wrapped as models wrap them give the same object as the plain ones."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(text.json_salvage(wrapped), "$.k", "int").alias("k"))


@query(
    """SELECT doc_id, item_id, 'high' AS confidence, sha256(doc_id || ':passage:' || b.text) AS evidence_id, CASE WHEN contains(d.text, b.text) THEN '' ELSE 'excerpt is not in the document' END AS problems
       FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id"""
)
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    from newsdesk.operators.research import evidence

    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = items.agg(F.count("*").alias("n"))
    claims = docs.select("doc_id").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    claims = claims.join(items.select("item_id", F.col("text").alias("excerpt")), "item_id").select("doc_id", "item_id", F.lit("passage").alias("statement"), "excerpt", F.lit("high").alias("confidence"))
    found = evidence(claims.select("doc_id", "statement", "excerpt", "confidence"), docs)
    return found.join(claims.select("doc_id", "item_id"), "doc_id").select("doc_id", "item_id", "confidence", "evidence_id", F.array_join("problems", ",").alias("problems"))
