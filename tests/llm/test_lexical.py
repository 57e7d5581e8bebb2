"""Ranked search against the definition, and MaxScore against scores of everything."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from newsdesk.llm import lexical, registry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    """docs: (id, text) rows, items: (item, text) rows."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms & c.keys())
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_counts_in_slices(monkeypatch):
    text = "Ab aB, çÇ 12x34 _ünï ÀB\0end 中文 x"
    assert lexical.term_counts(text.encode())[1] == {t.encode(): n for t, n in Counter(terms_of(text)).items()}
    whole = lexical.term_counts((text * 50).encode())
    monkeypatch.setattr(lexical, "_SLICE_BYTES", 7)
    assert lexical.term_counts((text * 50).encode()) == whole
    assert lexical.term_counts(text.encode(), {b"ab": 0, b"no": 1}) == (len(terms_of(text)), {b"ab": 2})
    assert lexical.term_counts(b"") == (0, {})


def test_maxscore_is_exact_and_skips():
    """Whatever the threshold, a block gives what sums over all its postings give, and long lists stay unread."""
    rng = np.random.default_rng(1)
    ids, rows = np.arange(500), []
    for _ in ids:
        own = np.unique(rng.zipf(1.4, 30))
        rows.append(own[own < 60])
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms = np.concatenate(rows)
    counts = rng.integers(1, 9, len(terms))
    df = np.bincount(terms, minlength=60)
    weights = np.array([lexical.weight(500, d) for d in df])
    lengths = rng.integers(20, 90, 500)
    block = lexical.Block(ids, lengths, ends, terms, counts, weights, 500, int(lengths.sum()))
    m = 50 + 50 * lengths * 500 // lengths.sum()
    whole = np.zeros((500, 60), np.int64)
    whole[np.repeat(ids, np.diff(ends)), terms] = weights[terms] * (10**9 * counts // (1000 * counts + 20 * np.repeat(m, np.diff(ends))))
    skipped = 0
    for _ in range(60):
        query = rng.choice(60, 12, replace=False)
        sums = whole[:, query].sum(axis=1)
        for least in (1, int(np.sort(sums)[-50]), int(sums.max()), int(sums.max()) + 1):
            docs, scores = block.best(query, max(1, least))
            want = np.flatnonzero(sums >= max(1, least))
            assert docs.tolist() == want.tolist() and scores.tolist() == sums[want].tolist()
        skipped += int((block.sums > 0).sum() < (sums > 0).sum())
    assert skipped > 20


def test_search_odd(spark, hostile):
    items = [(1, "A b one"), (1, "line"), (2, None), (3, "..."), (None, "ünï 中文"), (None, "x"), (4, "w nothing"), (5, "Straße again")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    for k, limit in ((50, 500_000), (2, 500_000), (50, 2)):
        got = lexical.search(hostile, queries, k=k, block_terms=limit)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert in_order(got.collect()) == in_order(brute(docs, items, k))
    assert lexical.search(hostile.limit(0), queries).count() == 0 and lexical.search(hostile, queries.limit(0)).count() == 0
    named = spark.createDataFrame([("é", "one"), ("b", "w")], "item_id string, text string")
    assert {r["item_id"] for r in lexical.search(hostile, named).collect()} == {"é", "b"}


def test_ties_across_parts(spark):
    """Many documents of one score, in many tasks: the smallest ids win."""
    docs = spark.range(9000).selectExpr("9000 - id AS doc_id", "IF(id < 4000, 'same words here', 'nothing of it') AS text", "1 AS score").repartition(16)
    queries = spark.createDataFrame([(1, "words"), (2, "same same here")], "item_id long, text string")
    got = lexical.search(docs, queries, k=7).orderBy("item_id", "rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [(q, n, 5000 + n) for q in (1, 2) for n in range(1, 8)]
    assert len({r["score"] for r in got if r["item_id"] == 1}) == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    found = registry.op12_lexical(spark, f"/root/testdata/{sf}")
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES['op12_lexical']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
