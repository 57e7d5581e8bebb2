"""Near-duplicates by a chosen-path set similarity join.

Each text is its set of word shingles, each set a sketch of minwise hashes. In several independent
trees, a node's documents branch by the values at two chosen places of their sketches, again and again,
until nodes are small; small nodes are compared exhaustively, and every link is confirmed on the full
sets. As two branches keep a similar pair 1.5 times on average, its chance to stay together somewhere
does not fall with depth, and the number of trees follows from the recall asked for. Stars come first: documents that they link are not compared again. What is left is confirmed
node by node, where the sets of a node's candidates come together once, whatever the number of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsdesk.llm.common import cut, regrouped, remove, scratch, stored

#: Minwise hashes of a set. One byte of each estimates similarities; the first BRANCH are kept whole, to branch by.
PLACES, BRANCH = 256, 60
#: Sketches that agree at fewer places aren't compared in full: at a similarity of 0.75 that happens about
#: once in three million pairs, which is part of the recall. It is the join's own filter; what passes is confirmed exactly.
AGREE = 157
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def _odd(seed: int, n: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, n, dtype=kind) | kind(1)


_ORDER, _TIMES, _PLUS = _odd(1, 64, np.uint64), _odd(2, PLACES, np.uint32), _odd(3, PLACES, np.uint32)
_SLICE_BYTES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _SLICE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; ``data`` holds the texts' UTF-8
    bytes one after another, ``ends`` where each begins and the last ends.

    A to Z are lower-cased, words are runs of other than the six white-space characters. A text with
    fewer than ``words`` words has all of them as its one shingle, a text without words has none.
    """
    n = len(data)
    if not n:
        return [np.empty(0, np.uint64)] * (len(ends) - 1)
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:n]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = _Powers.of(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    word = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(_MASK // 3))
    at = np.searchsorted(first, ends)  # each text's first word
    m = len(word)
    runs = np.zeros(max(0, m - words + 1), np.uint64)
    for k in range(words):
        runs += word[k : k + len(runs)] * _ORDER[k]
    runs = _mix(runs)
    found = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            found.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            found.append(_mix((word[a:b] * _ORDER[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def _sketch(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The first BRANCH minwise hashes and one byte of each of all."""
    best = np.full(PLACES, 2**32 - 1, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(high), 512):
        best = np.minimum(best, (high[k : k + 512, None] * _TIMES + _PLUS).min(axis=0))
    return best[:BRANCH].view(np.int32), ((best >> np.uint32(4)) & np.uint32(255)).astype(np.uint8).tobytes()


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) for each text of a batch, about a megabyte of text at a time."""
    text = batch.column("text").cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + _SLICE_BYTES, side="right")) - 1)
        yield from enumerate(shingle_sets(data[at[row] : at[stop]], at[row : stop + 1] - at[row], words), row)
        row = stop


def _described(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, key, branch, sketch) of (id, text): the set's size, a digest of the set and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, whole, bytes_ = [], [], [], []
            for _, found in _sets(batch, words):
                sizes.append(len(found))
                keys.append(_digest(found.tobytes()))
                a, b = _sketch(found)
                whole.append(a)
                bytes_.append(b)
            flat = np.concatenate(whole) if whole else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BRANCH), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(bytes_, pa.binary())], ["id", "n", "key", "branch", "sketch"])

    return docs.mapInArrow(run, "id long, n long, key binary, branch array<int>, sketch binary")


def _full(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, set) of the vertices in ``wanted`` (vertex, of: a document's id, want: the set's digest), made once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, kept, want = [], [], batch.column("want")
            for k, found in _sets(batch, words):
                blob = found.tobytes()
                if _digest(blob) == want[k].as_py():  # an id may have other texts too
                    kept.append(k)
                    made.append(blob)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int64())), pa.array(made, pa.binary())], ["id", "set"])

    texts = docs.join(wanted, F.col("id") == F.col("of")).select(F.col("vertex").alias("id"), "text", "want")
    return cut(texts.mapInArrow(sets, "id long, set binary"))


def _digest(blob: bytes) -> bytes:
    return hashlib.blake2b(blob, digest_size=16).digest()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough. Each b has one pair, so its set moves once."""
    both = pairs.join(full.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(
        full.select(F.col("id").alias("a"), F.col("set").alias("x")), "a"
    )

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("x"), batch.column("y"), strict=True)
            yes = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, label) for each end of ``links`` (a, b): the smallest end that can be reached.

    Each round takes the smallest label among a vertex and its neighbours, then that label's own
    label, which halves what is left of long chains. Rounds end when no label moves.
    """
    at = scratch(links.sparkSession, "components")
    ends = links.where("a <> b").select("a", "b")
    edges = stored(ends.union(ends.select(F.col("b"), F.col("a"))).distinct(), at)
    labels = stored(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), at)
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        over = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        moved = stored(least.join(over, "next").select("v", "label", F.least("next", "far").alias("next")), at)
        still = moved.where("label <> next").isEmpty()
        labels = moved.select("v", F.col("next").alias("label"))
        if still:
            labels = cut(labels)
            remove(links.sparkSession, at)
            return labels


@F.arrow_udf(returnType=T.IntegerType())
def _agree(x: pa.Array, y: pa.Array) -> pa.Array:
    """At how many places two sketches agree."""
    a, b = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (x, y))
    return pa.array((a == b).sum(axis=1), pa.int32())


def lost(similarity: float, roots: int, depth: int) -> float:
    """The chance that a pair meets in no small node: at each root, and at each of a node's two children, it
    stays together with the chance ``similarity``. Below a node it is lost with q(d) = (1 - s + s q(d-1))^2,
    q(0) = 0, which stays below 1/9 at 0.75 for any depth."""
    q = 0.0
    for _ in range(depth):
        q = (1 - similarity + similarity * q) ** 2
    return (1 - similarity * (1 - q)) ** roots


def roots_for(recall: float, percent: int, depth: int) -> int:
    """The least number of trees by which pairs at the threshold meet with the chance ``recall``."""
    return next(n for n in range(1, 64) if lost(percent / 100, n, depth) <= 1 - recall)


def _again(key: str) -> Column:
    """The number ``key`` made anew: what follows no longer looks partitioned by it (see regrouped)."""
    return F.expr(f"{key} ^ 0L").alias(key)


def _branch(nodes: DataFrame, roots: int) -> DataFrame:
    """The two children of each (node, branch, ...): documents with equal values at one of two places that
    the node chooses stay together. A pair at 0.75 is so expected in 1.5 of them, one at 0.5 in one,
    and less similar ones die out. Places that are roots are not chosen again."""
    width = BRANCH - roots
    one = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(width)).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(1)), F.lit(width - 1)).cast("int"), F.lit(width))
    child = lambda k, place: F.xxhash64("node", F.lit(k), F.get("branch", place + roots))
    return nodes.withColumn("node", F.explode(F.array(child(0, one), child(1, two))))


def _by_node(rows: DataFrame, columns: list[str], work: Callable, out: str) -> DataFrame:
    """``work`` on the rows of each node: a dict of Arrow columns in, a record batch out. Nodes stream
    through sorted partitions; one node is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, part]) if held is not None else part
            node = held.column("node").to_numpy()
            if not len(node) or node[0] == node[-1]:
                continue
            cuts = [0, *(np.flatnonzero(np.diff(node)) + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (made := work(held.slice(a, b - a).combine_chunks())) is not None:
                    yield made
            held = held.slice(cuts[-1])
        if held is not None and len(held):
            if (made := work(held.combine_chunks())) is not None:
                yield made

    return rows.select(*columns).repartition("node").sortWithinPartitions("node", "rep").mapInArrow(run, out)


def _roots_shared(a: np.ndarray, b: np.ndarray, done: np.ndarray) -> np.ndarray:
    """Whether one document shares with each of others a root node that ``done`` (bits of the one) covers."""
    bits = np.int64(1) << np.arange(a.shape[-1], dtype=np.int64)
    return ((a[None, :] == b) * bits & done).any(axis=1)


def _candidates(members: DataFrame, roots: int, percent: int) -> DataFrame:
    """(node, rep, label, n, partners) of each node's documents that have candidates: other labels, alike
    sketches and fitting sizes, not met in another node before. Two documents marked ``minor`` meet
    elsewhere. Partners come as packed ids, each pair once."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        rep, label, n, seen, minor = (t.column(c).to_numpy() for c in ("rep", "label", "n", "seen", "minor"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
        root = t.column("roots").combine_chunks().flatten().to_numpy().reshape(-1, roots)
        partners: dict[int, list[int]] = {}
        for i in range(len(rep) - 1):
            other = np.flatnonzero((label[i + 1 :] != label[i]) & (minor[i + 1 :] + minor[i] < 2)) + i + 1
            other = other[(100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            if not len(other):
                continue
            alike = (sketch[other] == sketch[i]).sum(axis=1, dtype=np.int32)
            order = np.argsort(-alike, kind="stable")
            other = other[order[alike[order] >= AGREE]]
            other = other[~_roots_shared(root[i], root[other], seen[i])]
            if len(other):
                partners[i] = other.tolist()
        if not partners:
            return None
        rows = sorted({*partners, *(k for p in partners.values() for k in p)})
        packed = [rep[partners.get(k, [])].astype(np.int64).tobytes() for k in rows]
        node = t.column("node").to_numpy()[rows]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(rep[rows]), pa.array(label[rows]), pa.array(n[rows]), pa.array(packed, pa.binary())], ["node", "rep", "label", "n", "partners"])

    return _by_node(members, ["node", "rep", "label", "n", "minor", "seen", "roots", "sketch"], work, "node long, rep long, label long, n long, partners binary")


def _bounded(candidates: DataFrame, node_bytes: int) -> DataFrame:
    """``candidates`` with part, low and high. The documents of a node whose full sets are larger than
    ``node_bytes`` are dealt into parts of about that size, and each two parts become a node of their own."""
    sizes = candidates.groupBy("node").agg(F.sum(8 * F.col("n")).alias("bytes")).where(F.col("bytes") > node_bytes)
    zero = F.lit(0)
    if sizes.isEmpty():
        return candidates.withColumns({"part": zero, "low": zero, "high": zero})
    heavy = candidates.join(sizes.select("node"), "node", "left_semi")
    light = candidates.join(sizes.select("node"), "node", "left_anti")
    so_far = F.sum(8 * F.col("n")).over(Window.partitionBy("node").orderBy("rep"))
    parts = heavy.withColumn("part", F.floor((so_far - 1) / node_bytes).cast("int")).join(sizes, "node")
    count = F.ceil(F.col("bytes") / node_bytes).cast("int")
    pairs = parts.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    pairs = pairs.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    pairs = pairs.withColumn("node", F.xxhash64("node", "low", "high")).drop("other", "bytes")
    return light.withColumns({"part": zero, "low": zero, "high": zero}).unionByName(pairs)


def _links(candidates: DataFrame, full: DataFrame, percent: int, node_bytes: int) -> DataFrame:
    """Links (a, b) that join labels within nodes, each confirmed on the full sets. What a node's
    earlier links have joined isn't looked at again."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        rep, label = t.column("rep").to_pylist(), t.column("label").to_pylist()
        sets = {r: np.frombuffer(x, np.uint64) for r, x in zip(rep, t.column("set").to_pylist(), strict=True)}
        of, root = dict(zip(rep, label, strict=True)), {x: x for x in label}
        part, low, high = (t.column(c).to_pylist() for c in ("part", "low", "high"))
        part = dict(zip(rep, part, strict=True))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for a, packed in zip(rep, t.column("partners").to_pylist(), strict=True):
            for b in np.frombuffer(packed, np.int64).tolist():
                if b not in part or (min(part[a], part[b]), max(part[a], part[b])) != (low[0], high[0]):
                    continue  # they meet in another part
                x, y = find(of[a]), find(of[b])
                if x != y and _similar(sets[a], sets[b], percent):
                    root[max(x, y)] = min(x, y)
                    links.append((min(a, b), max(a, b)))
        if not links:
            return None
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in links], pa.int64()), pa.array([k[1] for k in links], pa.int64())], ["a", "b"])

    rows = _bounded(candidates, node_bytes).join(full.select(F.col("id").alias("rep"), "set"), "rep")
    return _by_node(rows, ["node", "rep", "label", "partners", "part", "low", "high", "set"], work, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, recall: float = 1 - 2e-6, leaf: int = 2000, depth: int = 24, node_bytes: int = 256_000_000
) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Two texts are linked if 100 * the size of their sets' intersection is at least ``percent`` * that
    of the union. component_id is the smallest id that links reach, the row's own included. Null and
    empty texts and texts without words have empty sets and no links. Ids are integers below 2^62. Rows
    that share an id and have words are one document: what one of their texts is linked with is reached
    from all. A row with a null id is linked with nothing and has a null component_id. An empty table
    gives no rows.

    Equal sets are one vertex from the start. A node above ``leaf`` documents branches on, at most ``depth``
    levels; where all but ``leaf`` of its documents are known to be linked, the others are compared with
    them instead, block by block. There are as many trees as ``recall`` needs (see lost: 12 for two
    pairs missed in a million at 0.75, at any depth; pairs above that are missed less often, and most
    have other ways to be linked). What is still large after ``depth`` levels, documents that agree at so
    many places without being linked, is compared exhaustively in blocks of ``leaf``. Full sets of a node come
    together in parts of at most ``node_bytes``, two at a time.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_rows = cut(_described(texts, words))
    real = all_rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = real.groupBy("n", "key").agg(F.min("id").alias("own"), F.any_value("branch").alias("branch"), F.any_value("sketch").alias("sketch"))
    grouped = cut(classes.groupBy("own").agg(F.min(F.struct("n", "key", "branch", "sketch")).alias("v"), F.count("*").alias("sets")))
    vertices = grouped.select(F.col("own").alias("rep"), "own", "v.*")
    several = grouped.where("sets > 1").select("own", F.struct("v.n", "v.key").alias("first"))
    more: DataFrame | None = None  # an id's other texts: vertices of their own, linked with the id's
    if not several.isEmpty():
        more = classes.join(several, "own").where(F.struct("n", "key") != F.col("first"))
        more = cut(more.select((F.lit(2**62) + F.xxhash64("n", "key").bitwiseAND(2**61 - 1)).alias("rep"), "own", "n", "key", "branch", "sketch"))
        vertices = vertices.unionByName(more)
    known = texts.where(F.col("id").isNotNull())
    n_roots = roots_for(recall, percent, depth)
    roots = F.array(*[F.xxhash64(F.lit(k), F.get("branch", F.lit(k))) for k in range(n_roots)])

    # Stars: each document meets the smallest one of each of its root nodes; the most alike of these is its parent.
    first = vertices.select("rep", F.explode(roots).alias("node"))
    sizes = first.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    # The other side gets an exchange of its own, so that a hot node's rows can be split.
    met = first.join(sizes.select(_again("node"), "pivot"), "node").where("rep <> pivot").select("rep", "pivot").distinct()
    seen = met.join(vertices.select("rep", "sketch"), "rep").join(vertices.select(F.col("rep").alias("pivot"), F.col("sketch").alias("other")), "pivot")
    seen = seen.select("rep", "pivot", _agree("sketch", "other").alias("agree"))
    parents = seen.groupBy("rep").agg(F.max(F.struct("agree", (-F.col("pivot")).alias("minus"))).alias("best")).where(F.col("best.agree") >= AGREE)
    stars = cut(parents.select((-F.col("best.minus")).alias("a"), F.col("rep").alias("b")))
    want = vertices.select(F.col("rep").alias("vertex"), F.col("own").alias("of"), F.col("key").alias("want"))
    ends = stars.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    links = _confirm(stars, _full(known, ends.join(want, "vertex"), words), percent)
    links = cut(links if more is None else links.union(more.select("own", "rep")))
    labels = components(links)

    # What the stars left open: nodes whose documents are not all known to be linked.
    labelled = vertices.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = cut(labelled.withColumn("roots", F.slice("branch", 1, n_roots)).drop("key", "own"))
    nodes = labelled.select("rep", "label", F.posexplode(roots).alias("root", "node"))
    at = scratch(docs.sparkSession, "nodes")
    met_at = None  # for each document the root nodes in which all its pairs are compared
    found: DataFrame | None = None
    for level in range(depth + 1):
        # Counts by label combine before they are shuffled, so a hot node is a few rows.
        shares = nodes.groupBy("node", "label").agg(F.count("*").alias("n"))
        sizes = shares.groupBy("node").agg(F.sum("n").alias("size"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most"))
        mixed = sizes.where("labels > 1").select(_again("node"), "size", F.col("most.label").alias("major"), (F.col("size") - F.col("most.n")).alias("rest"))
        # Written as a table: the sizes that a checkpoint carries along multiply with every join of the loop.
        keyed = stored(nodes.select("node", "rep", "label", *(["root"] if level == 0 else [])).join(mixed, "node"), at)
        some, large = keyed.where(F.col("size") <= leaf), keyed.where(F.col("size") > leaf)
        none = F.lit(-1).cast("long")
        if level == 0:
            met_at = cut(some.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, root)")).alias("bits")))
            some = some.select("node", "rep", F.expr("shiftleft(1L, root) - 1L").alias("before"), F.lit(0).alias("minor"))
        else:
            some = some.select("node", "rep", none.alias("before"), F.lit(0).alias("minor"))
        # A large node of few documents beside those of one label: these few meet each block of the others.
        few, large = large.where(F.col("rest") <= leaf), large.where(F.col("rest") > leaf)
        blocks = F.ceil((F.col("size") - F.col("rest")) / leaf).cast("int")
        block = F.when(F.col("label") == F.col("major"), F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        few = few.withColumn("block", F.explode(block))
        minor = ((F.col("label") != F.col("major")) & (F.col("block") > 0)).cast("int")
        some = some.union(few.select(F.xxhash64("node", "block"), "rep", none, minor))
        if level == depth:  # blocks of a node that never came apart, each with each
            blocks = F.ceil(2 * F.col("size") / leaf).cast("int")
            mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
            spread = large.select("node", "rep", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            some = some.union(spread.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "rep", none, F.lit(0)))
        members = some.join(labelled.drop("branch"), "rep").join(met_at, "rep", "left")
        members = members.withColumn("seen", F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(F.col("before")))
        here = cut(_candidates(members, n_roots, percent))
        found = here if found is None else found.union(here)
        if level == depth or large.isEmpty():
            break
        nodes = _branch(large.select("node", "rep").join(labelled.select("rep", "label", "branch"), "rep"), n_roots).select("node", "rep", "label").distinct()
    remove(docs.sparkSession, at)
    if not found.isEmpty():
        full = _full(known, found.select(F.col("rep").alias("vertex")).distinct().join(want, "vertex"), words)
        labels = components(links.union(_links(found, full, percent, node_bytes)))

    named = real.groupBy("n", "key").agg(F.min("id").alias("rep")).join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    named = named.select("n", regrouped("key"), F.coalesce("label", "rep").alias("component_id"))
    mine = all_rows.select("id", "n", "key").join(named, ["n", "key"], "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return mine.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"))
