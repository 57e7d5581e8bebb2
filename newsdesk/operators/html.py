"""Articles from captured pages, by expressions: no browser and no scoring of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.text import collapse

_INLINE = r"(?:[^<]|<(?:/?(?:b|i|em|strong|a|span)\b[^>]*|br\s*/?)>)*"


def visible(page: Column) -> Column:
    """A page without scripts, styles and comments."""
    return F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</(script|style)>", ""), r"(?s)<!--.*?-->", "")


def title(page: Column) -> Column:
    return F.trim(F.regexp_extract(visible(page), r"(?is)<title[^>]*>(.*?)</title>", 1))


def paragraphs(page: Column) -> Column:
    """The texts of p, h2, h3 and li up to the next block tag, collapsed, without empty ones."""
    # Possessive, so that long paragraphs need no stack.
    blocks = F.regexp_extract_all(visible(page), F.lit(rf"(?is)<(?:p|h2|h3|li)\b[^>]*>({_INLINE}+)"), F.lit(1))
    plain = F.transform(blocks, lambda b: collapse(F.regexp_replace(b, "<[^>]*>", " ")))
    return F.filter(plain, lambda p: p != "")


def json_ld(page: Column) -> Column:
    """The first linked-data entry with a headline or a date, of a graph, a list or a lone object, as a
    variant; broken ones are passed over."""
    blocks = F.regexp_extract_all(page, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    items = lambda v: F.coalesce(F.try_variant_get(v, '$["@graph"]', "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    flat = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), items))
    says = lambda v: F.try_variant_get(v, "$.headline", "string").isNotNull() | F.try_variant_get(v, "$.datePublished", "string").isNotNull()
    return F.get(F.filter(flat, says), 0)


def article(pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` with title, published_at (text), author and paragraphs: linked data first, then the page's own tags."""
    page = F.col(html_col)
    read = pages.withColumn("_ld", json_ld(page))
    ld = lambda path: F.try_variant_get(F.col("_ld"), path, "string")
    meta = lambda name: F.nullif(F.regexp_extract(page, rf'(?is)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))
    return read.select(
        *pages.columns,
        F.coalesce(ld("$.headline"), meta("og:title"), title(page)).alias("title"),
        F.coalesce(ld("$.datePublished"), meta("article:published_time")).alias("published_at"),
        F.coalesce(ld("$.author.name"), ld("$.author[0].name"), meta("author")).alias("author"),
        paragraphs(page).alias("paragraphs"),
    )


def valid_extraction(articles: DataFrame) -> DataFrame:
    """A title and a body or description, else the reason against it; empty counts as missing."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    reason = F.when(~some("title"), "no title").when(~some("body") & ~some("description"), "no text")
    return articles.withColumn("failure", reason)


def listing_links(pages: DataFrame, html_col: str, url_col: str, subdomains: bool = False, limit: int = 50) -> DataFrame:
    """S3: the links of each listing page that stay on its site: href made whole against the page, the
    anchor's text collapsed, each href once in the page's order, at most ``limit`` a page."""
    anchors = F.regexp_extract_all(visible(F.col(html_col)), F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"'#]+)[^>]*>.*?</a>"), F.lit(0))
    part = lambda a, p: F.regexp_extract(a, p, 1)
    page_url = F.col("listing_url")
    origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)

    def whole(href: Column) -> Column:
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(origin, r"^([^/]+)", 1), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/"))), href))
        )

    each = pages.select(F.col(url_col).alias("listing_url"), F.posexplode(anchors).alias("position", "_a")).withColumn("_origin", origin)
    href = whole(F.trim(part(F.col("_a"), r"(?is)^<a\b[^>]*?href\s*=\s*[\"']([^\"'#]+)")))
    links = each.select("listing_url", "_origin", "position", href.alias("href"), collapse(F.regexp_replace(part(F.col("_a"), r"(?is)^<a\b[^>]*>(.*)</a>$"), "<[^>]*>", " ")).alias("title"))
    site = F.regexp_replace(F.lower(F.try_parse_url("_origin", F.lit("HOST"))), r"^www\.", "")
    host = F.lower(F.try_parse_url("href", F.lit("HOST")))
    own = (host == site) | F.endswith(host, F.concat(F.lit("."), site)) if subdomains else F.startswith("href", F.col("_origin"))
    first = links.where(F.coalesce(own, F.lit(False))).groupBy("listing_url", "href").agg(F.min(F.struct("position", "title")).alias("x"))
    w = Window.partitionBy("listing_url").orderBy("position")
    return first.select("listing_url", "href", "x.position", "x.title").withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= limit).drop("_at")
