"""Fill-in-the-middle: a text is cut at two line ends and its middle moved to the end, behind sentinels.

All of it is expressions: regexp_extract_all makes the lines, digits of a SHA-256 of the id give the cuts,
slice and array_join build the arrangement, and split at the sentinels restores the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A unit: a line with its line feed, or what follows the last one.
UNIT = r"[^\n]*\n|[^\n]+"


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` (8 at most) whole numbers below 2^32 that ``key`` and ``seed`` decide: groups of eight digits of the
    hex SHA-256 of ``<seed>:<key>``. A null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``docs`` with the column ``fim``: struct of n, form, prefix_chars, middle_chars, output.

    n counts the text's units. Of the units 0 to a are the prefix, a to b the middle, the others the suffix; a and b
    are two draws modulo n + 1. form is "plain" for an empty text, a text that holds a sentinel, and 100 - ``rate``
    texts in a hundred; ``spm`` of a hundred others are "spm" (suffix, prefix, middle), the rest "psm" (prefix,
    suffix, middle). output is the arrangement, for "plain" the text itself, whose counts of code points
    are null.

    A null text is an empty one. A null id draws as an empty id; rows that share an id draw alike, each for its
    own text; ids may be of any type that has a text. A text without line feeds is one unit, however long, and every
    text is cut whole. Other columns stay as they are, but one named ``fim`` is replaced. An empty table gives none.
    """
    prefix_mark, suffix_mark, middle_mark = sentinels
    text = F.coalesce(F.col("_row").getField(text_col), F.lit(""))
    h = draws(F.col("_row").getField(id_col), seed)
    rows = docs.select(F.struct("*").alias("_row"))
    # One projection for each step: what a later one uses twice is made once.
    units = rows.select("_row", text.alias("_text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("_units"), F.array(*h).alias("_h"))
    n = F.size("_units")
    at = [F.col("_h")[k] % (n + 1) for k in (0, 1)]
    held = F.lit(False)
    for mark in sentinels:
        held = held | F.col("_text").contains(mark)
    plain = (F.col("_text") == "") | held | (F.col("_h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < spm, "spm").otherwise("psm")
    cuts = units.select("_row", "_text", "_units", n.alias("_n"), F.least(*at).cast("int").alias("_a"), F.greatest(*at).cast("int").alias("_b"), form.alias("_form"))
    part = lambda first, count: F.array_join(F.slice("_units", first, count), "")
    parts = cuts.select(
        "_row", "_text", "_n", "_form", part(F.lit(1), F.col("_a")).alias("_prefix"),
        part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("_middle"), part(F.col("_b") + 1, F.col("_n") - F.col("_b")).alias("_suffix"),
    )
    psm = F.concat(F.lit(prefix_mark), "_prefix", F.lit(suffix_mark), "_suffix", F.lit(middle_mark), "_middle")
    spm_ = F.concat(F.lit(suffix_mark), "_suffix", F.lit(prefix_mark), "_prefix", F.lit(middle_mark), "_middle")
    chars = lambda c: F.when(F.col("_form") != "plain", F.char_length(c).cast("long"))
    made = F.struct(
        F.col("_n").cast("long").alias("n"),
        F.col("_form").alias("form"),
        chars("_prefix").alias("prefix_chars"),
        chars("_middle").alias("middle_chars"),
        F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "psm", psm).otherwise(spm_).alias("output"),
    )
    others = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "fim"]
    return parts.select(*others, made.alias("fim"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of. No sentinel overlaps itself or another, and the text holds none, so the
    three that are found are those that were put in."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
