"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes from indivisible groups.

Equal texts form a group. Groups are dealt into lots of bounded size, differencing makes of each lot
one partial partition (a tuple of sums), and the partial partitions of lots are differenced again,
level by level, until one is left. Spark carries every level; no task sees more than one lot.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.llm.common import cut


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions, one a row of ``sums`` (n x k).

    The two with the largest spread are combined again and again, the largest part of one with the
    smallest of the other. Returns ``place`` (n x k: where each part of a row ends) and the sums of
    the k parts, largest first. Ties go to the earlier row, so equal input gives equal output.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    nodes = list(np.take_along_axis(sums, order, axis=1))
    heap = [(int(x[-1] - x[0]), i) for i, x in enumerate(nodes)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = nodes[a] + nodes[b][::-1]
        by = np.argsort(-both, kind="stable")
        both = both[by]
        nodes[a] = nodes[b] = None
        joins.append((a, b, by))
        nodes.append(both)
        heapq.heapreplace(heap, (int(both[-1] - both[0]), len(nodes) - 1))
    total = nodes[-1] if nodes else np.zeros(k, sums.dtype)
    # Walk back: at[node][j] is the final part of the node's j-th largest part.
    at: list[np.ndarray | None] = [None] * len(nodes)
    if nodes:
        at[-1] = np.arange(k)
    for node in range(len(nodes) - 1, n - 1, -1):
        a, b, by = joins[node - n]
        ends = np.empty(k, int)
        ends[by] = at[node]
        at[a], at[b], at[node] = ends, ends[::-1], None
    place = np.empty((n, k), int)
    for i in range(n):
        place[i, order[i]] = at[i]
    return place, total


def _deal(groups: DataFrame, k: int, lot_size: int, fan_in: int) -> DataFrame:
    """(group, shard) of (group, bytes), all groups different."""
    spark = groups.sparkSession
    n_lots = max(1, -(-groups.count() // lot_size))

    def first(key: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["bytes", "group"], ascending=[False, True], kind="stable", ignore_index=True)
        sums = np.zeros((len(lot), k), np.int64)
        sums[:, 0] = lot["bytes"]
        place, _ = difference(sums)
        return pd.DataFrame({"group": lot["group"], "bytes": lot["bytes"], "lot": key[0], "part": place[:, 0]})

    dealt = cut(
        groups.withColumn("lot", F.pmod(F.xxhash64("group"), F.lit(n_lots)))
        .groupBy("lot")
        .applyInPandas(first, "group binary, bytes long, lot long, part int")
    )
    sums = dealt.groupBy("lot", "part").agg(F.sum("bytes").alias("bytes"))
    moves = []
    while n_lots > 1:

        def combine(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            lots, row = np.unique(parts["lot"], return_inverse=True)
            grid = np.zeros((len(lots), k), np.int64)
            grid[row, parts["part"]] = parts["bytes"]
            place, _ = difference(grid)
            rows, part = np.divmod(np.arange(place.size), k)
            return pd.DataFrame({"lot": lots[rows], "part": part, "bytes": grid.ravel(), "up": key[0], "to": place.ravel()})

        step = cut(
            sums.withColumn("up", F.floor(F.col("lot") / fan_in).cast("long"))
            .groupBy("up")
            .applyInPandas(combine, "lot long, part int, bytes long, up long, to int")
        )
        moves.append(step)
        sums = step.groupBy("up", "to").agg(F.sum("bytes").alias("bytes")).withColumnsRenamed({"up": "lot", "to": "part"})
        n_lots = -(-n_lots // fan_in)
    # The moves of all levels, composed from the last: (lot of the first level, part) -> shard.
    where = None
    for step in reversed(moves):
        here = step.select("lot", F.col("part").alias("part"), "up", "to")
        if where is not None:
            above = where.select(F.col("lot").alias("up"), F.col("part").alias("to"), "shard")
            here = here.join(above, ["up", "to"]).select("lot", "part", "shard")
        else:
            here = here.select("lot", "part", F.col("to").alias("shard"))
        where = here
    if where is None:
        return dealt.select("group", F.col("part").alias("shard"))
    return dealt.join(where, ["lot", "part"]).select("group", "shard")


def assign(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", lot_size: int = 20_000, fan_in: int = 200, slice_rows: int = 20_000
) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, shard and slot.

    A row's size is the UTF-8 bytes of its text plus 16; null counts as an empty text. Rows of equal
    text share a shard. Shards have nearly equal bytes, as nearly as a group that is larger than a
    shard allows. Slots are gapless from 0 in each shard, ordered by a slice (a hash), then the id.
    Repeated rows, ids that repeat and null ids are rows like others. An empty table gives none.

    ``lot_size`` groups meet in a task at most (about), and ``fan_in`` lots at the next level.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(body.cast("binary"))).alias("group"),
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    shards = _deal(cut(groups), n_shards, lot_size, fan_in)
    # Rows may be equal in all columns; the number tells them apart.
    placed = cut(rows.join(shards, "group").select("id", "size", "text_crc32", "group", "shard", F.monotonically_increasing_id().alias("row")))
    # Gapless slots without a shard in one task: slices of a shard are numbered apart, then moved up.
    # A group or an id may be a third of the rows, so the slice comes from the row's number.
    slices = max(1, -(-placed.count() // slice_rows))
    sliced = placed.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "slice").orderBy("id", "group", "row")
    return (
        sliced.withColumn("at", F.row_number().over(own) - 1)
        .join(starts, ["shard", "slice"])
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
            (F.col("at") + F.col("start")).cast("long").alias("slot"),
        )
    )
