"""Ranks and sliding neighbourhoods within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_group(df: DataFrame, group: list[str], order: str, ties: list[str], width: int, out: str = "rank") -> DataFrame:
    """Gapless ranks from 0 by the whole number ``order``, then ``ties``, in each group.

    A group is cut into slices of ``width`` of the order; slices are counted and ranked apart, so no
    task holds a whole group. Rows whose order is null come first, in a slice of their own.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width).cast("long"))
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(F.asc_nulls_first("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    own = Window.partitionBy(*group, "_slice").orderBy(F.asc_nulls_first(order), *ties)
    same = F.col("_slice").eqNullSafe(F.col("_of"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    ranked = sliced.withColumn("_own", F.row_number().over(own) - 1).join(starts, same)
    return ranked.withColumn(out, (F.col("_own") + F.col("_start")).cast("long")).select(*df.columns, out)


def in_blocks(df: DataFrame, place: str, n: int, block: int = 1000) -> DataFrame:
    """``df`` in blocks of places from 0, each with the ``n`` rows before it: _block, and _home, false for these."""
    home = F.floor(F.col(place) / block)
    # The last n places of a block go to the next one too; n may be larger than a block.
    blocks = F.sequence(home, F.floor((F.col(place) + n) / block))
    return df.withColumn("_at", home).withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_block") == F.col("_at")).drop("_at")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row for each key in the given order, which is rising. min_by combines before the
    shuffle, so a hot key costs a row a task and not a sort."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
