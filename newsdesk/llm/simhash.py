"""Near-duplicates by SimHash fingerprints and a vantage-point tree over Hamming distances.

Equal fingerprints are one point from the start. The points are dealt into shards by their distances from a
vantage point, which is one of them: the fingerprint is cut into slices, and a shard holds the points with one
distance from the vantage point on each slice. Slices have no bit in common, so by the triangle inequality
two points are at least as far apart as the sum, over the slices, of the differences of these distances. A point
therefore belongs to one shard and visits those whose distances differ by the radius at most in sum; all other
branches are pruned. Of two shards whose points may be near, only one visits the other. Shards that are still
large branch on with a vantage point of their own and slices half as wide, down to single bits, where a shard is
one point; small ones are searched in one task, in the order of the distance from a last vantage point.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import cut, remove, scratch, stored
from newsdesk.llm.near_dups import components

BITS, SEED = 64, 42
#: Bytes of text that are worked on at once, and shingles whose bits are counted at once.
_SLICE_BYTES, _SLICE_SHINGLES = 1 << 20, 1 << 16
#: Cells of a block of comparisons, and rows that a branching batch makes at once.
_CELLS = 1 << 18


def _words(data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of UTF-8 bytes in lower case (A to Z only), one space after each, and where each begins and ends."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    last = solid & ~np.concatenate([solid[1:], [False]])
    spaces = np.concatenate([[False], last[:-1]])  # what stands after a word is white space
    keep = solid | spaces
    ends = np.cumsum(keep)[last]
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return np.where(spaces, 32, data)[keep].tobytes(), begins, ends


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text's shingles of ``words`` words, repeats included: a bit is set if more than half of the
    shingles' XXH64 have it. A text with fewer words is one shingle, one without words has 0."""
    buffer, begins, ends = _words(np.frombuffer(text, np.uint8))
    if not len(begins):
        return 0
    if len(begins) >= words:
        begins, ends = begins[: len(begins) - words + 1], ends[words - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for k in range(0, len(begins), _SLICE_SHINGLES):
        some = zip(begins[k : k + _SLICE_SHINGLES].tolist(), ends[k : k + _SLICE_SHINGLES].tolist(), strict=True)
        hashes = b"".join([digest(buffer[a:b], SEED) for a, b in some])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(begins)).tobytes(), "big")


def _fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(id, f) of (id, text). f holds the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(made, np.uint64).view(np.int64))], ["id", "f"])

    return docs.mapInArrow(run, "id long, f long")


def shown(f: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits in lower case."""
    return F.lpad(F.lower(F.hex(f)), 16, "0")


def gaps(slices: int, radius: int) -> np.ndarray:
    """All whole vectors of ``slices`` places whose absolute values sum up to ``radius`` at most, the zero vector first."""
    found = {(0,) * slices}
    for n in range(1, radius + 1):
        for places in itertools.combinations_with_replacement(range(slices), n):
            for signs in itertools.product((1, -1), repeat=n):
                v = [0] * slices
                for p, s in zip(places, signs, strict=True):
                    v[p] += s
                found.add(tuple(v))
    return np.array(sorted(found, key=lambda v: (sum(map(abs, v)), v)), np.int64)


def _slice_distances(f: np.ndarray, vantage: np.ndarray, slices: int) -> np.ndarray:
    """The Hamming distances from the vantage point on each slice, a row for each fingerprint."""
    width = BITS // slices
    differ = (f ^ vantage).view(np.uint64)
    mask = np.uint64(2**width - 1)
    return np.stack([np.bitwise_count((differ >> np.uint64(width * k)) & mask) for k in range(slices)], axis=1).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _branch(rows: DataFrame, slices: int, radius: int) -> DataFrame:
    """(node, f, own) of the children of (node, vantage, f, own). A child's number is a weighted sum of its
    distances, so those of the children to visit come by adding one number each. A node's own points visit
    the children on one side only, visitors those on both and their own. No point has a distance below 0
    or above a slice's width, so such children aren't visited."""
    width = BITS // slices
    weights = _mix(np.arange(1, slices + 1, dtype=np.uint64)) | np.uint64(1)
    vectors = gaps(slices, radius)
    first = np.argmax(vectors != 0, axis=1)
    ahead = vectors[np.arange(len(vectors)), first] > 0
    steps = (vectors.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    low, high = (-vectors).astype(np.int8), (width - vectors).astype(np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, 8 * _CELLS // vectors.size)
            for k in range(0, len(batch), size):
                part = batch.slice(k, size)
                node, vantage, f = (part.column(c).to_numpy() for c in ("node", "vantage", "f"))
                own = part.column("own").to_numpy(zero_copy_only=False)
                far = _slice_distances(f, vantage, slices)
                at = _mix(node.view(np.uint64)) + (far.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                far = far.astype(np.int8)[:, None, :]
                who, which = np.nonzero(((far >= low) & (far <= high)).all(axis=2) & (ahead | ~own[:, None]))
                nodes = np.concatenate([at[own], at[who] + steps[which]]).view(np.int64)
                points = np.concatenate([f[own], f[who]])
                mine = np.arange(len(nodes)) < int(own.sum())
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(points), pa.array(mine)], ["node", "f", "own"])

    return rows.select("node", "vantage", "f", "own").mapInArrow(run, "node long, f long, own boolean")


def near_points(own: np.ndarray, guests: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all points of ``own`` and ``guests`` that are within ``radius`` of a point of ``own``, as a
    forest: what earlier links have joined isn't linked again. Points are compared in the order of their
    distance from the first one, as far as the triangle inequality lets them be near."""
    points = np.concatenate([own, guests])
    far = np.bitwise_count((points ^ own[0]).view(np.uint64)).astype(np.int64)
    order = np.argsort(far[: len(own)], kind="stable")
    at = np.concatenate([order, len(own) + np.argsort(far[len(own) :], kind="stable")])
    points, far, n = points[at], far[at], len(own)
    root = np.arange(len(points))
    links = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return int(x)

    def compare(a: int, b: int, lo: int, hi: int) -> None:
        near = np.bitwise_count((points[a:b, None] ^ points[None, lo:hi]).view(np.uint64)) <= radius
        x, y = np.nonzero(near)
        x, y = x + a, y + lo
        new = root[x] != root[y]
        for i, j in zip(x[new].tolist(), y[new].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(points[i]), int(points[j])))

    a = 0
    while a < n:
        reach = int(np.searchsorted(far[:n], far[a] + radius, side="right"))
        size = max(1, _CELLS // max(1, reach - a))
        b = min(n, a + size, int(np.searchsorted(far[:n], far[a], side="right")))  # owners at one distance
        compare(a, b, a, reach)
        lo = n + int(np.searchsorted(far[n:], far[a] - radius, side="left"))
        hi = n + int(np.searchsorted(far[n:], far[a] + radius, side="right"))
        for k in range(lo, hi, _CELLS):
            compare(a, b, k, min(hi, k + _CELLS))
        a = b
    return links


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): the links within each node. Nodes stream through sorted partitions, one in memory at a time."""

    def links(node: np.ndarray, f: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int]]:
        cuts = [0, *(np.flatnonzero(np.diff(node)) + 1), len(node)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = own[a:b]
            if b - a > 1 and mine.any():
                yield from near_points(f[a:b][mine], f[a:b][~mine], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, bool)
        held = tuple(np.empty(0, k) for k in kinds)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "f", "own"))
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                if not len(held[0]) or held[0][0] == held[0][-1]:
                    continue
            end = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
            found = np.array(list(links(*(x[:end] for x in held))), np.int64).reshape(-1, 2)
            held = tuple(x[end:] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return rows.select("node", "f", "own").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _slices_for(points: int, leaf: int) -> int:
    """The fewest slices that leave about ``leaf`` points in a shard: a distance on a slice of w bits of unrelated
    points is shared by one pair in about the root of pi * w."""
    slices = 2
    while slices < BITS and (np.pi * BITS / slices) ** (slices / 2) < points / leaf:
        slices *= 2
    return slices


def near_pairs(points: DataFrame, radius: int = 2, leaf: int = 16384) -> DataFrame:
    """(a, b): links that join all of ``points`` (f, distinct) within ``radius`` differing bits, if only through others.

    A shard is searched in one task if its points and visitors are at most four times ``leaf``, or if its slices
    are single bits, where it is one point and those within ``radius`` of it. The number of shards that a point
    visits depends on the slices and the radius alone (20 for four slices and radius 2), not on the table.
    """
    spark = points.sparkSession
    at = scratch(spark, "simhash")
    points = stored(points.select("f"), at)
    first = points.agg(F.count("*").alias("n"), F.min_by("f", F.xxhash64("f")).alias("vantage")).first()
    rows = points.select(F.lit(0).cast("long").alias("node"), "f", F.lit(True).alias("own"))
    found, slices = None, 0
    if first["n"] > leaf:
        slices = _slices_for(first["n"], leaf)
        rows = _branch(rows.withColumn("vantage", F.lit(first["vantage"]).cast("long")), slices, radius)
        rows = stored(rows, at)
        while slices < BITS:
            # A row for each node and task leaves the map side, so hot nodes are few rows.
            sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.count_if("own").alias("owners"), F.min_by(F.when(F.col("own"), F.col("f")), F.when(F.col("own"), F.xxhash64("f"))).alias("vantage"))
            large = stored(sizes.where((F.col("n") > 4 * leaf) & (F.col("owners") > 0)).select("node", "vantage"), at)
            if large.isEmpty():
                break
            small = _searched(rows.join(large, "node", "left_anti"), radius)
            found = small if found is None else found.union(small)
            slices *= 2
            rows = stored(_branch(rows.join(large, "node"), slices, radius), at)
            # Visitors of shards without points of their own go.
            rows = stored(rows.join(rows.where("own").select("node").distinct(), "node", "left_semi"), at)
    last = _searched(rows, radius)
    found = cut((last if found is None else found.union(last)).distinct())
    remove(spark, at)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, leaf: int = 16384) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    Rows are linked if their fingerprints (see fingerprint) differ at ``radius`` bits or fewer; component_id is the
    smallest id that links reach, the row's own included. fingerprint has 16 hexadecimal digits.

    Null and empty texts and texts without words have the fingerprint zero, which is linked like any other. Words are
    runs of other than the six white-space characters, A to Z in lower case; whole texts count, whatever their
    length. Ids are integers. Rows that share an id are one document: what one of their texts is linked
    with is reached from all. A row with a null id is linked with nothing and has a null component_id.
    Columns beside id and text are not looked at, whatever their names. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_rows = cut(_fingerprints(texts, words))
    known = all_rows.where("id IS NOT NULL")
    classes = cut(known.groupBy("f").agg(F.min("id").alias("rep")))
    links = near_pairs(classes, radius, leaf)
    own = lambda side: classes.select(F.col("f").alias(side), F.col("rep").alias(f"rep_{side}"))
    links = links.join(own("a"), "a").join(own("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # An id with several texts links their fingerprints. Ids with one text leave the map side once a task at most.
    several = known.groupBy("id").agg(F.min("f").alias("low"), F.max("f").alias("high")).where("low <> high").select("id")
    twice = known.join(several, "id", "left_semi").distinct().join(classes, "f").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    labels = components(cut(links.union(twice)))
    named = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    # The xor gives this side an exchange of its own, so that adaptive execution can split the rows of a hot fingerprint.
    named = named.select(F.expr("f ^ 1L").alias("g"), F.coalesce("label", "rep").alias("component_id"))
    mine = all_rows.join(named, F.expr("f ^ 1L") == F.col("g"), "left")
    return mine.select(F.col("id").alias(id_col), shown(F.col("f")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
