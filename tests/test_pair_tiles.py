"""Candidates of the set join, tile by tile."""

import gc
import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import dedup


def test_candidates_are_nearly_the_results(spark):
    """Beside the 71 similar pairs of sf0.01 hardly any pair becomes a row (3,873 did by positions alone)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    sets = docs.groupBy(F.col("lang").alias("grp"), F.sort_array(dedup._hashed(F.col("text"))).alias("tokens")).agg(F.min("doc_id").alias("id")).where(F.size("tokens") > 0)
    assert 71 <= dedup.candidates(sets.checkpoint(), 0.5).count() <= 2 * 71


@pytest.mark.parametrize("least", [0.5, 0.8, 0.34])
@pytest.mark.parametrize("tile", [3, 1000])
def test_tiles_lose_no_pair(spark, least, tile):
    """Sets of 1 to 300 tokens, in families on all sides of the threshold, in tiles of any size: each similar pair comes once."""
    rng = random.Random(8)
    sets = []
    for k in range(40):
        base = rng.sample(range(3000), rng.choice([1, 2, 3, 4, 8, 16, 31, 64, 150, 256, 300]))
        for _ in range(6):
            sets.append((rng.choice("xy"), [t if rng.random() < 0.97 else rng.randrange(3000) for t in base[: rng.randint((len(base) + 1) // 2, len(base))]]))
    rows = [(k, g, sorted({(t + 1) * 0x9E3779B97F4A7C15 % 2**63 for t in s})) for k, (g, s) in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, grp string, tokens array<long>")
    got = [(r["grp"], min(r["a"], r["b"]), max(r["a"], r["b"])) for r in dedup.candidates(df, least, tile, 1000).collect()]
    similar = [(g, a, b) for (a, g, s), (b, h, t) in combinations(rows, 2) if g == h and len({*s} & {*t}) >= least * len({*s} | {*t})]
    assert len(got) == len(set(got)) and set(similar) <= set(got) and len(similar) > 10


def test_a_token_of_all_sets(spark):
    """Words that every set begins with make no pairs of sets that are unlike."""
    texts = [" ".join([*(f"all{i}" for i in range(30)), *(f"own{k}x{i}" for i in range(40))]) for k in range(300)]
    df = spark.createDataFrame([(k, "g", t) for k, t in enumerate(texts)] + [(1000, "g", texts[7] + " more")], "id long, grp string, gist string")
    assert [tuple(r) for r in dedup.all_pairs(df, "id", "grp", F.col("gist")).collect()] == [("g", 7, 1000, 70 / 71)]


def _written(spark):
    """Bytes of shuffles on this machine's disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_sets_are_shuffled_as_often_in_many_blocks(spark):
    """A family of near copies in 20 blocks and a half: each set came to every cell of two blocks that held a candidate of it."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(220)]
    rows = [(k, "g", " ".join(rng.sample(words, 200) + [f"own{k}x{i}" for i in range(10)])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, grp string, gist string").coalesce(1).checkpoint()
    took, pairs = [], []
    for block in (10**9, 3000):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)  # what earlier queries have shuffled goes now rather than meanwhile
        began = _written(spark)
        pairs.append(dedup.all_pairs(df, "id", "grp", F.col("gist"), 0.5, block).count())
        took.append(_written(spark) - began)
    assert pairs == [300 * 299 // 2] * 2
    assert took[1] < 2 * took[0]


@pytest.mark.parametrize(("small", "part"), [(1, 500), (2000, 10**9)])
def test_large_groups_meet_by_partitions(spark, small, part):
    """The same pairs and scores as by groups, whether all groups are large or some."""
    rng = random.Random(9)
    sets = []
    for k in range(30):
        base = rng.sample(range(2000), rng.choice([1, 2, 5, 9, 30, 64, 150]))
        for _ in range(5):
            sets.append((rng.choice("xxxxyz"), sorted({(t + 1) * 0x9E3779B97F4A7C15 % 2**63 for t in base if rng.random() < 0.9})))
    rows = [(f"{k:03}", g, s) for k, (g, s) in enumerate(sets) if s]
    coded = dedup._coded(spark.createDataFrame(rows, "id string, grp string, tokens array<long>")).checkpoint()
    got = sorted((r["grp"], *sorted((r["a"], r["b"])), r["score"]) for r in dedup._similar(coded, 0.5, 4, 1000, small, part).collect())
    score = lambda s, t: len({*s} & {*t}) / len({*s} | {*t})
    assert got == sorted((g, a, b, score(s, t)) for (a, g, s), (b, h, t) in combinations(rows, 2) if g == h and score(s, t) >= 0.5) and len(got) > 50


def test_tokens_without_a_rank(spark, monkeypatch):
    """With 8 ranks, or one, most tokens are compared as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = sorted(map(tuple, dedup.all_pairs(docs, "doc_id", "lang", F.col("text")).collect()))
    assert len(whole) == 71
    for ranked in (8, 1):
        monkeypatch.setattr(dedup, "_RANKED", ranked)
        assert sorted(map(tuple, dedup.all_pairs(docs, "doc_id", "lang", F.col("text")).collect())) == whole
