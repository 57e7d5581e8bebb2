"""Fingerprints against their definition, the vantage-point tree against all pairs."""

import re

import duckdb
import numpy as np
import pytest
import xxhash

from newsdesk.llm import registry, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, links):
    """The smallest key that links reach from each."""
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def close(points, radius=2):
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count((points[i + 1 :] ^ points[i]).view(np.uint64)) <= radius) + i + 1:
            yield int(points[i]), int(points[j])


def wanted(rows):
    """(id, fingerprint, component) of (id, text) rows by comparing all of them."""
    prints = [fingerprint(t) for _, t in rows]
    known = [(k, f) for (k, _), f in zip(rows, prints, strict=True) if k is not None]
    of = components([("f", f) for _, f in known] + [("i", k) for k, _ in known], [(("f", f), ("i", k)) for k, f in known])
    points = np.array(sorted({f for _, f in known}), np.uint64)
    joined = components(set(of.values()), [(of["f", a], of["f", b]) for a, b in close(points)])
    least = {}
    for k, _ in known:
        at = joined[of["i", k]]
        least[at] = min(k, least.get(at, k))
    return [(k, f"{f:016x}", None if k is None else least[joined[of["i", k]]]) for (k, _), f in zip(rows, prints, strict=True)]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_simhash_odd(hostile):
    rows = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    got = simhash.near_duplicates(hostile)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and in_order(got.collect()) == in_order(wanted(rows))
    assert simhash.near_duplicates(hostile.limit(0)).count() == 0


def test_simhash_whole_table(spark):
    rows = duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert in_order(registry.op13_simhash(spark, "/root/testdata/sf0.001").collect()) == in_order(wanted(rows))


def test_long_texts_count_in_slices(monkeypatch):
    text = " ".join(f"w{k % 1000}" for k in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_SLICE_SHINGLES", 64)
    assert simhash.fingerprint(text.encode()) == whole == fingerprint(text)


def test_gaps():
    for slices, radius in ((2, 2), (4, 2), (8, 2), (4, 3), (3, 0)):
        found = {tuple(v) for v in simhash.gaps(slices, radius).tolist()}
        sums = np.indices((2 * radius + 1,) * slices).reshape(slices, -1).T - radius
        assert found == {tuple(v) for v in sums.tolist() if sum(map(abs, v)) <= radius}
        assert not simhash.gaps(slices, radius)[0].any()


@pytest.fixture(scope="module")
def points():
    """Unrelated points, pairs at a distance of 2, a chain, and a crowd around one point."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 1500, dtype=np.int64)
    two = rng.permuted(np.tile(np.arange(64), (700, 1)), axis=1)[:, :2]
    near = base[:700] ^ (np.uint64(1) << two[:, 0].astype(np.uint64)).view(np.int64) ^ (np.uint64(1) << two[:, 1].astype(np.uint64)).view(np.int64)
    chain = [int(base[900])]
    for k in range(60):
        chain.append(chain[-1] ^ (1 << (k % 60)) ^ (1 << ((k + 7) % 60)))
    crowd = [int(base[0]) ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(20) for b in range(20, 32) for c in range(32, 44)]
    return np.unique(np.concatenate([base, near, np.array(chain + crowd, np.int64)]))


@pytest.mark.parametrize("leaf", [100_000, 400, 60])
def test_tree_is_exact(spark, points, leaf):
    """The same classes for a single shard, for one level, and for levels of ever finer slices."""
    found = simhash.near_pairs(spark.createDataFrame([(int(x),) for x in points], "f long").repartition(4), leaf=leaf).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in found)
    keys = [int(x) for x in points]
    assert components(keys, [tuple(r) for r in found]) == components(keys, close(points))


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_other_radii(spark, points, radius):
    some = points[::3]
    found = simhash.near_pairs(spark.createDataFrame([(int(x),) for x in some], "f long"), radius=radius, leaf=200).collect()
    keys = [int(x) for x in some]
    assert components(keys, [tuple(r) for r in found]) == components(keys, close(some, radius))


def test_visits_do_not_grow_with_the_table(spark):
    """A point visits as many shards in a large table as in a small one, and shards stay small."""
    for n in (2000, 8000):
        rng = np.random.default_rng(n)
        rows = spark.createDataFrame([(0, 0, int(x), True) for x in rng.integers(-(2**63), 2**63 - 1, n)], "node long, vantage long, f long, own boolean")
        made = simhash._branch(rows, 4, 2)
        assert made.where("own").count() == n and 15 * n < made.where("NOT own").count() <= 20 * n
