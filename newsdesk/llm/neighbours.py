"""Approximate nearest neighbours by cosine: an inverted file of coarse centroids whose residuals are
product-quantised, searched with asymmetric distance tables and reranked on the original vectors. How many
lists are opened follows from queries of the table itself, whose neighbours are found by brute force."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.llm.common import cut


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, a block of rows at a time."""
    out, half = np.empty(len(x), np.int32), (centres**2).sum(axis=1) / 2
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (half - x[k : k + 4096] @ centres.T).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; a centre that loses its rows takes a row at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=k)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres.astype(np.float32)


@dataclass
class Quantiser:
    """``coarse`` (lists x dim) and ``fine`` (parts x 256 x dim of a part) centroids, how many lists to open, and the
    middle of the sample: vectors that all point about one way differ too little for single precision without it."""

    coarse: np.ndarray
    fine: np.ndarray
    probes: int
    middle: np.ndarray | float = 0.0

    def moved(self, units: np.ndarray) -> np.ndarray:
        """Unit vectors as the other methods take them."""
        return (units - self.middle).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = _nearest(x, self.coarse)
        rest = self._split(x - self.coarse[of])
        return of, np.stack([_nearest(rest[:, p], self.fine[p]) for p in range(len(self.fine))], axis=1).astype(np.uint8)

    def _split(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.fine.shape
        wide = np.zeros((len(x), parts * width), np.float32)
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), parts, width)

    def order(self, x: np.ndarray) -> np.ndarray:
        """All lists for each row, nearest first."""
        far = (self.coarse**2).sum(axis=1) / 2 - x @ self.coarse.T
        return np.argsort(far, axis=1, kind="stable").astype(np.int32)

    def open(self, x: np.ndarray) -> np.ndarray:
        """The lists to search for each row, nearest first."""
        return self.order(x)[:, : self.probes]

    def terms(self, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What a coded vector adds to its squared distance from any query: |r|^2 + 2 c.r for the
        centre c of its list and its coded residual r."""
        parts, _, width = self.fine.shape
        rest = self.fine[np.arange(parts), codes]
        centre = self._split(self.coarse[of])
        return ((rest + 2 * centre) * rest).sum(axis=(1, 2)).astype(np.float32)

    def errors(self, x: np.ndarray, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far coded vectors are from what their codes stand for."""
        rest = self._split(x - self.coarse[of]) - self.fine[np.arange(len(self.fine)), codes]
        return np.sqrt((rest**2).sum(axis=(1, 2)))

    def distances(self, queries: np.ndarray, of: int, codes: np.ndarray, terms: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Squared distances of queries to a list's coded vectors, by tables of q.r for each part and code."""
        far = ((queries - self.coarse[of]) ** 2).sum(axis=1)[:, None] + terms[None, :]
        for p in range(len(self.fine)):
            far -= 2 * tables[:, p][:, codes[:, p]]
        return far

    def tables(self, queries: np.ndarray) -> np.ndarray:
        return np.einsum("qpw,pcw->qpc", self._split(queries), self.fine).astype(np.float32)


def _chained(centres: np.ndarray) -> np.ndarray:
    """Centres in an order in which each is followed by the nearest one left, so that near lists share blocks."""
    left, order = np.ones(len(centres), bool), [0]
    left[0] = False
    while left.any():
        far = ((centres - centres[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.where(left, far, np.inf).argmin()))
        left[order[-1]] = False
    return centres[order]


def train(sample: np.ndarray, n: int, parts: int = 16, top: int = 5, wanted: float = 0.95, seed: int = 7) -> Quantiser:
    """A quantiser for ``n`` vectors from unit vectors of a sample. There are 2 sqrt(n) lists, or one for
    each eighth vector of the sample: the sample has to grow with the root of n. As many lists are opened as hold
    ``wanted`` of the true ``top`` neighbours of up to 500 sample vectors, and a fifth as many again; search() replaces
    that by what the table's queries need."""
    middle = sample.mean(axis=0)
    sample = (sample - middle).astype(np.float32)
    lists = int(min(max(1, 2 * n**0.5), max(1, len(sample) // 8)))
    coarse = _chained(_kmeans(sample, lists, 10, seed))
    of = _nearest(sample, coarse)
    parts = min(parts, sample.shape[1])
    width = -(-sample.shape[1] // parts)
    made = Quantiser(coarse, np.zeros((parts, 256, width), np.float32), lists, middle)
    rest = made._split(sample - coarse[of])
    made.fine = np.stack([_kmeans(rest[:, p], 256, 8, seed + p) for p in range(parts)])
    asked = sample[:: max(1, len(sample) // 500)][:500]
    alike = asked @ sample.T - (sample**2).sum(axis=1) / 2
    near = np.argpartition(-alike, min(top, len(sample) - 1), axis=1)[:, : top + 1]
    place = np.empty((len(asked), lists), int)
    np.put_along_axis(place, made.open(asked), np.arange(lists)[None].repeat(len(asked), 0), axis=1)
    made.probes = _enough(np.take_along_axis(place, of[near], axis=1).ravel(), wanted, lists)
    return made


def _enough(depth: np.ndarray, wanted: float, lists: int) -> int:
    """How many lists to open for the share ``wanted`` of neighbours at these places, and a fifth as many again."""
    return int(min(lists, 1 + 1.2 * np.sort(depth)[min(len(depth) - 1, int(wanted * len(depth)))]))


def _usable(vector: Column) -> Column:
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fit & F.exists(vector, lambda x: x != 0)


def _rows(batch: pa.Array, dim: int, kind: str) -> np.ndarray:
    """The vectors of a column as an array of ``kind``."""
    return batch.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _read(column: pd.Series, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim)


def _best(places: np.ndarray, cos: np.ndarray, ids: np.ndarray, units: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``places`` the ids of the ``k`` of largest ``cos``, ties to the smaller id, and the cosines, which are equal for equal vectors."""
    near = places[cos >= np.partition(cos, -k)[-k] - 1e-12] if k < len(cos) else places
    exact = (units[near] * query).sum(axis=1)  # a product of matrices rounds equal rows differently
    by = np.lexsort((ids[near], -exact))[:k]
    return ids[near[by]], exact[by]


def _depths(rows: DataFrame, made: Quantiser, kind: str, dim: int, k: int, audit: int) -> np.ndarray:
    """For up to ``audit`` queries, those with the smallest hashes of their ids, the places of their true ``k`` nearest
    rows' lists among the lists in the order in which they are opened."""
    order = F.xxhash64(F.lit("audit"), "id")
    chosen = rows.where("asks").select("id", "vector").orderBy(order, "id").limit(audit).toArrow()
    if not len(chosen):
        return np.empty(0, int)
    units = _unit(_rows(chosen.column("vector").combine_chunks(), dim, kind))
    shared = rows.sparkSession.sparkContext.broadcast((made, units, chosen.column("id").to_numpy()))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, asked, own = shared.value
        best, lists = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int32)
        for batch in batches:
            if len(batch):
                x = _unit(_rows(batch.column("vector"), dim, kind))
                cos = asked @ x.T
                cos[own[:, None] == batch.column("id").to_numpy()[None, :]] = -np.inf
                at = np.argpartition(-cos, min(k, len(x)) - 1, axis=1)[:, :k]
                of = _nearest(q.moved(x[at.ravel()]), q.coarse).reshape(at.shape)
                every, of = np.hstack([best, np.take_along_axis(cos, at, axis=1)]), np.hstack([lists, of])
                at = np.argsort(-every, axis=1, kind="stable")[:, :k]
                best, lists = np.take_along_axis(every, at, axis=1), np.take_along_axis(of, at, axis=1)
        who, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(lists[who, at].astype(np.int32)), pa.array(best[who, at])], ["query", "list", "cos"])

    first = Window.partitionBy("query").orderBy(F.desc("cos"), "list")
    found = rows.select("id", "vector").mapInArrow(nearest, "query int, list int, cos double")
    found = found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k).select("query", "list").toArrow()
    place = np.empty((len(units), len(made.coarse)), int)
    np.put_along_axis(place, made.order(made.moved(units)), np.arange(len(made.coarse))[None].repeat(len(units), 0), axis=1)
    return place[found.column("query").to_numpy(), found.column("list").to_numpy()]


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, rerank: int = 100, max_train: int = 20_000, block: int = 8_000, query_block: int = 16_000,
    audit: int = 200, wanted: float = 0.97,
) -> DataFrame:
    """(query_id, rank, id, score): for each row for which ``queries`` holds its ``k`` nearest other
    rows found, by cosine in double precision on the original vectors, ties to the smaller id.

    Null and zero vectors, those with null or non-finite components, those of another length than
    most and rows without an id take no part. Equal ids are one vector, the best of its rows. The quantiser is fitted on the
    ``max_train`` vectors with the smallest hashes of their ids; every vector is indexed. As many lists are
    opened as hold the share ``wanted`` of the true nearest rows of ``audit`` of the queries, which brute force over all
    rows finds, and a fifth as many again: queries unlike the rows, or rows without groups, open more, all of them if
    need be. In the opened lists codes rule out what their error can't bring among the ``rerank`` nearest of the block;
    the rest is compared in double precision, and each block passes on ``rerank`` candidates of a query. A query for
    which fewer than ``k`` are found is compared with all vectors. An empty table gives no rows.

    Near lists are searched together in blocks of about ``block`` vectors and ``query_block``
    queries; a larger list is several blocks. The number of lists follows the root of the table's size
    up to an eighth of ``max_train``; beyond some 1.5 million vectors ``max_train`` should be raised.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    spark = vectors.sparkSession
    result = f"query_id long, rank int, {id_col} long, score double"
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], result)
    dim, n = lengths["dim"], lengths["count"]
    rows = rows.where(F.size("vector") == dim)
    sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(max_train).select("vector").toArrow()
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    made = train(_unit(_rows(sample.column("vector").combine_chunks(), dim, kind)), n, top=k)
    depths = _depths(rows, made, kind, dim, k, audit)
    if len(depths):
        made.probes = _enough(depths, wanted, len(made.coarse))
    shared = spark.sparkContext.broadcast(made)

    parts = len(made.fine)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if len(batch):
                own = _rows(batch.column("vector"), dim, kind)
                x = q.moved(_unit(own))
                of, codes = q.encode(x)
                arrays = [batch.column("id"), pa.array(of), pa.array(q.terms(of, codes)), pa.array(q.errors(x, of, codes)), _binary(codes), _binary(own)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "list", "term", "error", "codes", "own"])

    index = cut(rows.select("id", "vector").mapInArrow(coded, "id long, list int, term float, error float, codes binary, own binary"))
    # The blocks of each list: a row for each list comes to the driver, an eighth of max_train at most.
    first, many, at, room = {}, {}, 0, block
    for row in index.groupBy("list").count().orderBy("list").collect():
        if row["count"] > room and room < block:
            at, room = at + 1, block
        first[row["list"]], many[row["list"]] = at, max(1, -(-row["count"] // block))
        at, room = (at + many[row["list"]], block) if row["count"] > block else (at, room - row["count"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            own = _rows(batch.column("vector"), dim, kind)
            of, blocks, lists = [], [], []
            for i, opened in enumerate(q.open(q.moved(_unit(own)))):
                here: dict[int, list[int]] = {}
                for n in opened.tolist():
                    for b in range(first.get(n, 0), first.get(n, 0) + many.get(n, 0)):
                        here.setdefault(b, []).append(n)
                for b, found in here.items():
                    of.append(i)
                    blocks.append(b)
                    lists.append(np.array(found, np.int32).tobytes())
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(blocks, pa.int32()), pa.array(lists, pa.binary()), _binary(own).take(at)], ["query", "block", "lists", "asked"])

    probes = rows.where("asks").select("id", "vector").mapInArrow(asked, "query long, block int, lists binary, asked binary")
    # Queries go to the blocks they open. Only a block that many of them open is there once for each
    # ``query_block`` of them, so what moves grows with vectors and opened blocks, not with their product.
    probes = cut(probes)
    crowds = probes.groupBy("block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("crowd"))
    starts = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    widths = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    placed = index.select("list", "id", "term", "error", "codes", "own", (starts[F.col("list")] + F.pmod(F.xxhash64("id"), widths[F.col("list")]).cast("int")).alias("block"))
    # A row for each block.
    left = placed.join(F.broadcast(crowds), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("crowd") - 1))).drop("crowd")
    right = probes.join(F.broadcast(crowds), "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("crowd")).cast("int")).drop("crowd")

    def scan(key: tuple, held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        q, out = shared.value, []
        held = held.sort_values(["list", "id"], kind="stable")
        ids, of, term = held["id"].to_numpy(), held["list"].to_numpy(), held["term"].to_numpy()
        codes, error = _read(held["codes"], parts, np.uint8), held["error"].to_numpy()
        units = _unit(_read(held["own"], dim, kind))
        # What single precision may add to or take from squared distances.
        widest = float((q.moved(units) ** 2).sum(axis=1).max(initial=0))
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else np.zeros(0, int)
        for at in range(0, len(asks) if len(of) else 0, 256):
            some = asks.iloc[at : at + 256]
            queries = _unit(_read(some["asked"], dim, kind))
            x = q.moved(queries)
            opened = [set(np.frombuffer(lists, np.int32).tolist()) for lists in some["lists"]]
            tables, far = q.tables(x), np.full((len(some), len(ids)), np.inf, np.float32)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                who = np.flatnonzero([of[a] in lists for lists in opened])
                if len(who):
                    far[who, a:b] = q.distances(x[who], of[a], codes[a:b], term[a:b], tables[who])
            far[some["query"].to_numpy()[:, None] == ids[None, :]] = np.inf
            slack = 1e-5 * max(widest, float((x**2).sum(axis=1).max()))
            most = np.sqrt(np.maximum(far, 0) + slack) + error
            edge = np.partition(most, min(rerank, len(ids)) - 1, axis=1)[:, min(rerank, len(ids)) - 1, None]
            able = np.isfinite(far) & (np.sqrt(np.maximum(far - slack, 0)) - error <= edge)
            there = np.flatnonzero(able.any(axis=0))
            cos = queries @ units[there].T
            for i, query in enumerate(some["query"]):
                mine = able[i, there]
                near, exact = _best(there[mine], cos[i, mine], ids, units, queries[i], rerank)
                out.append((np.full(len(near), query), near, exact))
        return pd.DataFrame(dict(zip(("query", "id", "cos"), map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame({"query": [], "id": [], "cos": []})

    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(scan, "query long, id long, cos double")
    best = Window.partitionBy("query").orderBy(F.desc("cos"), "id")
    kept = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= rerank).select("query", "id").distinct()
    mine = rows.where("asks").select(F.col("id").alias("query"), F.col("vector").alias("x"))
    theirs = rows.select("id", F.col("vector").alias("y"))
    pairs = kept.join(theirs, "id").join(mine, "query")
    score = _dot("x", "y") / F.sqrt(_dot("x", "x") * _dot("y", "y"))
    scored = pairs.select("query", "id", score.alias("score")).groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = cut(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score"))
    # Queries for which the opened lists hold too few are compared with every vector.
    enough = found.where(F.col("rank") == k).select("query")
    if not mine.join(enough, "query", "left_anti").isEmpty() and (there := min(k, index.select("id").distinct().count() - 1)):
        enough = found.where(F.col("rank") == there).select("query")
        short = mine.join(enough, "query", "left_anti")
        every = short.crossJoin(theirs).where(F.col("query") != F.col("id")).select("query", "id", score.alias("score"))
        exact = every.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
        found = found.join(enough, "query", "left_semi").unionByName(exact.where(F.col("rank") <= k))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
