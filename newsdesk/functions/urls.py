"""URL columns: canonical forms, hosts, dates in paths, site rules and robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(url: Column) -> tuple[Column, Column]:
    """What stands before the query, and the query's parameters."""
    plain = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    return F.regexp_replace(plain, r"\?.*$", ""), F.filter(F.split(query, "&"), lambda p: p != "")


def _joined(base: Column, parameters: Column) -> Column:
    return F.when(F.size(parameters) > 0, F.concat(base, F.lit("?"), F.array_join(parameters, "&"))).otherwise(base)


#: Parameters that only track, and those that go in feeds.
TRACKING = r"(?i)^(?:utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(?:=|$)"
FEED_TRACKING = r"(?i)^(?:utm_[^=]*|fbclid|gclid)(?:=|$)"


def canonical(url: Column) -> Column:
    """No fragment, no tracking parameters, the others sorted, one slash at the end dropped."""
    base, parameters = _parts(url)
    kept = F.array_sort(F.filter(parameters, lambda p: ~p.rlike(TRACKING)))
    return F.regexp_replace(_joined(base, kept), "/$", "")


def feed_form(url: Column) -> Column:
    """As in feeds: fewer parameters go, their order and a last slash stay."""
    base, parameters = _parts(url)
    return _joined(base, F.filter(parameters, lambda p: ~p.rlike(FEED_TRACKING)))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def publisher(url: Column) -> Column:
    """I16: the host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def date_hint(url: Column) -> Column:
    """A date in the path as YYYY-MM-DD, or null."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    # A fixed value: years 20YY, months and days that there are.
    pattern = r"/(20\d{2})[/-](0[1-9]|1[0-2])[/-]([0-2]\d|3[01])(?:/|$)"
    made = F.concat_ws("-", *[F.regexp_extract(path, pattern, k) for k in (1, 2, 3)])
    return F.when(path.rlike(pattern), made)


def same_site(url: Column, site: Column) -> Column:
    """The site's host or a host under it."""
    return F.coalesce((host(url) == site) | F.endswith(host(url), F.concat(F.lit("."), site)), F.lit(False))


def site_link(url: Column, domain: str, path: str) -> Column:
    """One row of a rule table: a host with its subdomains and a pattern of the path."""
    return same_site(url, F.lit(domain)) & F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).rlike(path)


#: How links to articles look on each known site: hosts (those that begin with a dot with all
#: their subdomains), the path, and where a link has a date the path's year, month and day.
SITE_LINKS = {
    "thestar": (("www.thestar.com.my",), "^/", r"/(\d{4})/(\d{2})/(\d{2})/"),
    "sinchew": ((".sinchew.com.my",), r"^/news/\d{8}/[^/]+/\d+$", r"/news/(\d{4})(\d{2})(\d{2})/"),
    "chinapress": (("www.chinapress.com.my",), "^/", r"^/(\d{4})(\d{2})(\d{2})/[^/]+/?$"),
    "theedge": (("theedgemalaysia.com",), r"^/node/\d+$", None),
    "utusan": (("www.utusan.com.my",), r"/\d{4}/\d{2}/[^/]+/?$", None),
    "cnnes": ((".cnnes.cc",), "^/", r"/(\d{4})(\d{2})(\d{2})/\d+\.html$"),
    "xinhua-energy": ((".xinhuanet.com", ".news.cn"), r"(?i)^/energy/\d{8}/[a-f0-9]{32}/c\.html$", r"/energy/(\d{4})(\d{2})(\d{2})/"),
    "cnenergynews": ((".cnenergynews.cn",), r"^/article/[A-Za-z0-9]+$", None),
    "naver": (("n.news.naver.com", "news.naver.com"), "/article/", None),
    "nhk": (("www3.nhk.or.jp",), "^/news/html/", r"/news/html/(\d{4})(\d{2})(\d{2})/"),
    "nikkei": (("www.nikkei.com",), "^/article/", None),
}


def known_site_link(url: Column, since: Column) -> Column:
    """The known site whose article a url is, null if it is none; sites with dated links need a real day
    from ``since`` on."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    found = []
    for name, (hosts, form, dated) in SITE_LINKS.items():
        here = F.lit(False)
        for h in hosts:
            here = here | (same_site(url, F.lit(h[1:])) if h.startswith(".") else F.coalesce(host(url) == h, F.lit(False)))
        fits = here & path.rlike(form)
        if dated:
            day = F.try_to_date(F.concat_ws("-", *[F.regexp_extract(path, dated, k) for k in (1, 2, 3)]), "yyyy-MM-dd")
            fits = fits & path.rlike(dated) & F.coalesce(day >= since, F.lit(False))
        found.append(F.when(fits, name))
    return F.coalesce(*found)


def base_url(url: Column) -> Column:
    """I37."""
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")


def robots_pattern(rule: Column) -> Column:
    """A rule as a pattern: stars are wild, all else is literal, it must match from the start."""
    # The characters that a pattern would read otherwise.
    quoted = F.regexp_replace(rule, r"([.+^${}()|\[\]\\?])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))


def robots_blocks(url: Column, rule: Column) -> Column:
    """Whether a rule matches path and query; an empty rule matches nothing."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    query = F.try_parse_url(url, F.lit("QUERY"))
    target = F.concat(F.when(path == "", "/").otherwise(path), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.coalesce((rule != "") & F.regexp_like(target, robots_pattern(rule)), F.lit(False))
