"""Recall of op6 on rows and queries that are unlike each other, and the audit that it rests on."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import neighbours


def far_queries(r, n, dim):
    """Rows in groups, queries anywhere."""
    x = r.normal(size=(60, dim))[r.integers(0, 60, n)] + 0.2 * r.normal(size=(n, dim))
    x[::50] = r.normal(size=(len(x[::50]), dim))
    return x


def one_way(r, n, dim):
    """All vectors point nearly one way."""
    return 1e5 + r.normal(size=(n, dim))


@pytest.mark.parametrize("made", [far_queries, one_way])
def test_recall(spark, made):
    n = 10_000
    x = made(np.random.default_rng(5), n, 48)
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})).repartition(4)
    found = defaultdict(set)
    for r in neighbours.search(vectors, F.col("vec_id") % 50 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len(set(np.argsort(-cos)[:5].tolist()) & found[q])
    assert hits / (5 * len(range(0, n, 50))) >= 0.95


def test_copies(spark):
    """Of many equal vectors the smallest ids come first, also where they outnumber what a block passes on."""
    x = np.random.default_rng(2).normal(size=(3000, 24))
    x[500:2500] = x[500]
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(3000), "embedding": list(x)}))
    got = neighbours.search(vectors, F.col("vec_id") == 1000, block=400).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [500, 501, 502, 503, 504]
