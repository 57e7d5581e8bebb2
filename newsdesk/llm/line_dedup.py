"""Line dedup [native]: lines that many documents share lose all copies but one.

Normalised lines are exploded, hashed and counted by document; lines over the threshold go, and
what stays is put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import SPACES, ascii_lower, regrouped


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A to Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with ``text_col`` reassembled, and ``_n_lines`` and ``_n_dropped``.

    A text is split at line feeds. A key (see line_key) of at least ``min_chars`` code points found
    in at least ``min_docs`` documents loses all its lines except in the rows with the largest id.

    Null or empty text: one empty line, which stays; null becomes an empty text only where text is
    compared, the column keeps its null. Rows that share an id are one document when documents are
    counted; those with the largest id all keep the line. A null id is smaller than any other, and each
    row with one counts. Columns other than
    the id and the text are carried along under their own names, whatever those are; only
    columns named as the two outputs are replaced. An empty table gives an empty table.
    """
    me, body = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    # An id may repeat with another text: a row is known by its id and a hash of its text.
    split = docs.select(me.alias("id"), F.xxhash64(body).alias("of"), F.split(body, "\n").alias("lines"))
    # Keys are made before explode(), above which filters on them stay: pushed below, they would make them again.
    keyed = split.select("id", "of", F.posexplode(F.transform("lines", line_key)).alias("at", "key"))
    keyed = keyed.where(F.char_length("key") >= min_chars).select(
        "id", "of", "at", F.unhex(F.md5("key")).alias("key")
    )
    # One row for each distinct key of a row, so that a plain count, combined before the shuffle, counts
    # documents; only rows that share an id have to be told apart before.
    keys = split.select("id", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars).select("id", F.unhex(F.md5("key")).alias("key"))
    repeated = docs.where(me.isNotNull()).groupBy(me.alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    if not repeated.isEmpty():
        keys = keys.join(repeated, "id", "left_anti").unionByName(keys.join(repeated, "id", "left_semi").distinct())
    common = (
        keys.groupBy("key")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
        .select(regrouped("key"), "keeper")
    )
    gone = (
        keyed.join(common, "key")
        .where(F.col("id").isNull() | (F.col("id") < F.col("keeper")))
        .groupBy("id", "of")
        .agg(F.collect_set("at").alias("gone"))
    )
    kept = docs.select(F.struct("*").alias("row"), me.alias("id"), F.xxhash64(body).alias("of"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("of").alias("gone_of"), "gone")
    joined = kept.join(
        gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("of") == F.col("gone_of")), "left"
    ).withColumn("lines", F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(
        F.array_join(F.transform(stay, lambda at: F.get(F.col("lines"), at)), "\n")
    )
    others = [
        text.alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")
    ]
    return joined.select(
        *others,
        F.size("lines").cast("long").alias("_n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_dropped"),
    )
