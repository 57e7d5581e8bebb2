"""Text columns: cleaning, tokens, tags, labels, repair. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# The regions of the front page, in their order, and the countries of each.
REGIONS = ("Malaysia", "ASEAN", "China", "Japan & South Korea", "Europe & US", "World")
REGION_COUNTRIES = {
    "Malaysia": ("MY",),
    "ASEAN": ("ID", "SG", "TH", "VN", "PH", "BN", "KH", "LA", "MM", "TL"),
    "China": ("CN", "HK", "MO", "TW"),
    "Japan & South Korea": ("JP", "KR", "KP"),
    "Europe & US": (
        "US", "CA", "MX", "GB", "IE", "FR", "DE", "IT", "ES", "PT", "NL", "BE", "LU",
        "CH", "AT", "DK", "SE", "NO", "FI", "IS", "PL", "CZ", "SK", "HU", "RO", "BG",
        "GR", "HR", "SI", "EE", "LV", "LT", "UA", "MD", "AL", "BA", "ME", "MK", "RS",
    ),
}


def tokens(x: Column) -> Column:
    """Lower-case ASCII words in order; everything else separates them."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def token_set(x: Column) -> Column:
    """Distinct lower-case ASCII words in order; everything else separates them."""
    return F.array_distinct(tokens(x))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def collapse(x: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_body(x: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Paragraphs collapsed, without empty ones and those that begin with an ignored text."""
    parts = F.transform(F.split(x, r"\n\s*\n"), collapse)
    dull = lambda p: F.exists(F.array(*[F.lit(i.lower()) for i in ignored]), lambda i: F.startswith(F.lower(p), i))
    return F.array_join(F.filter(parts, lambda p: (p != "") & ~(dull(p) if ignored else F.lit(False))), "\n\n")


def clean_lines(x: Column) -> Column:
    """No carriage returns, each line collapsed, lines that are left joined by a blank one."""
    lines = F.transform(F.split(F.regexp_replace(x, "\r", ""), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda p: p != ""), "\n\n")


def words(x: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(x, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def clamp_words(x: Column, n: int) -> Column:
    """I6."""
    return F.array_join(F.slice(words(x), 1, n), " ")


def word_count(x: Column) -> Column:
    """I7."""
    return F.size(words(x))


def cjk_count(x: Column) -> Column:
    """Characters of the two ranges of Chinese characters, which are fixed values."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit("[㐀-鿿豈-﫿]"))


def normalise_tags(tags: Column, most: int = 8) -> Column:
    """I8: trimmed, lower-case, hyphens for spaces, distinct in order, at most ``most``."""
    made = F.transform(tags, lambda t: F.regexp_replace(F.lower(F.trim(F.coalesce(t, F.lit("")))), r"(?U)\s+", "-"))
    return F.slice(F.array_distinct(F.filter(made, lambda t: t != "")), 1, most)


def country_code(x: Column) -> Column:
    """Two letters in upper case, or null."""
    code = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def tag_label(tag: Column) -> Column:
    """I10."""
    label = F.trim(F.regexp_replace(F.coalesce(tag, F.lit("")), "-", " "))
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.char_length(label)))


def truncate(x: Column, most: int = 230) -> Column:
    """What fits stays; else all but the last three characters, the space before them cut, and dots."""
    return F.when(F.char_length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 3)), F.lit("...")))


def pick(pair: Column, language: str) -> Column:
    """The wanted side of an {en, zh} pair, else English, else Chinese; empty counts as missing."""
    first = pair["zh" if language in ("cn", "zh") else "en"]
    some = lambda c: F.when(c != "", c)
    return F.trim(F.coalesce(some(first), some(pair["en"]), some(pair["zh"]), F.lit("")))


def region(country: Column) -> Column:
    """Null and unknown countries belong to the World."""
    code, found = F.upper(F.coalesce(country, F.lit(""))), None
    for name, codes in REGION_COUNTRIES.items():
        found = F.when(code.isin(*codes), name) if found is None else found.when(code.isin(*codes), name)
    return found.otherwise("World")


def region_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in REGIONS]), name).cast("int")


def excerpts(x: Column, n: int = 3, most: int = 500) -> Column:
    """The first paragraphs, each cut."""
    return F.transform(F.slice(F.filter(F.split(x, r"\n\n+"), lambda p: p != ""), 1, n), lambda p: F.substring(p, 1, most))


def search_text(*parts: Column) -> Column:
    """What is there, in lower case, one space between."""
    return F.lower(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def needs_refill(x: Column) -> Column:
    """A replacement character, or its bytes read as Latin-1, means that text was lost."""
    return F.coalesce(x.contains("�") | x.contains("ï¿½"), F.lit(False))


def corrupted(x: Column) -> Column:
    """Lost text, numeric entities or three accented Latin letters in a row."""
    # A fixed value: the accented letters that UTF-8 read as Latin-1 gives.
    accents = "[ÃÂÅ-ÖØ-öø-ÿ]{3,}"
    return needs_refill(x) | F.coalesce(x.rlike(r"&#\d+;|&amp;#\d+;") | x.rlike(accents), F.lit(False))


def _decoded(x: Column, pattern: str, base: int) -> Column:
    """Numeric entities of the basic plane as characters: the text is cut at them and joined again."""
    hits = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    code = lambda h: F.conv(h, base, 16)
    # UTF-32 holds every code point in four bytes; what is no code point stays as it was.
    char = lambda h: F.when((F.length(code(h)) <= 6) & (F.conv(h, base, 10).cast("long") <= 0x10FFFF), F.decode(F.unhex(F.lpad(code(h), 8, "0")), "UTF-32")).otherwise("")
    parts = F.split(x, pattern, -1)
    joined = F.array_join(F.zip_with(parts, hits, lambda p, h: F.concat(F.coalesce(p, F.lit("")), F.coalesce(char(h), F.lit("")))), "")
    return F.when(F.size(hits) == 0, x).otherwise(joined)


def repair(x: Column) -> Column:
    """Entities decoded in the order ampersand, decimal, hexadecimal, named; zero-width characters
    go, no-break spaces become spaces. Replacement characters stay. Surrogate code points become empty."""
    x = F.replace(x, F.lit("&amp;"), F.lit("&"))
    x = _decoded(x, r"&#(\d{1,7});", 10)
    x = _decoded(x, r"&#[xX]([0-9a-fA-F]{1,6});", 16)
    for entity, plain in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    x = F.regexp_replace(x, "[​﻿]", "")
    return F.trim(F.regexp_replace(x, " ", " "))


def html_escape(x: Column) -> Column:
    """Five characters, the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def mask_key(key: Column) -> Column:
    """I35."""
    stars = F.lit("******")
    short = F.concat(F.substring(key, 1, 2), stars)
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "")
        .when(F.char_length(key) <= 10, short)
        .otherwise(F.concat(F.substring(key, 1, 6), stars, F.substring(key, -4, 4)))
    )


def mask_connection(x: Column) -> Column:
    """The password of a connection string."""
    return F.regexp_replace(x, r"://([^:/@]+):[^@]+@", "://$1:***@")


def json_salvage(x: Column) -> Column:
    """A variant from a model's answer: without a code fence, or else what the outermost braces hold."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.coalesce(F.try_parse_json(plain), F.try_parse_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0)))


def tagger_answer(x: Column) -> Column:
    """Tags and country out of a tagger's answer: an object, or a bare list of tags, with or without a code
    fence or words around it; null if there is neither."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    whole = F.coalesce(F.try_parse_json(plain), F.try_parse_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0)), F.try_parse_json(F.regexp_extract(plain, r"(?s)\[.*\]", 0)))
    bare = F.try_variant_get(whole, "$", "array<string>")
    tags = F.coalesce(bare, F.try_variant_get(whole, "$.tags", "array<string>"), F.array().cast("array<string>"))
    return F.when(whole.isNotNull(), F.struct(normalise_tags(tags).alias("tags"), country_code(F.try_variant_get(whole, "$.country", "string")).alias("country")))


def repair_all(value: Column, kind: DataType) -> Column:
    """repair() of every text in a value of a type: in arrays, structs and maps too."""
    if isinstance(kind, StringType):
        return repair(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: repair_all(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: repair_all(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[repair_all(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def place_deixis(en: Column, zh: Column) -> Column:
    """Phrases for the writer's own country, which readers elsewhere can't place."""
    # Fixed values, by language.
    patterns = (
        (zh, "我国|本国|我省|本省|我市|本市|我区|祖国|我们国家"),
        (zh, "我が国|わが国"),
        (zh, r"우리\s?나라"),
        (en, r"(?i)\b(?:our (?:country|nation|people|state)|the motherland|here at home)\b"),
    )
    hits = F.array(*[F.regexp_extract(F.coalesce(text, F.lit("")), p, 0) for text, p in patterns])
    return F.array_distinct(F.filter(hits, lambda h: h != ""))
