"""Fill-in-the-middle against a plain rewriting of its definition."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import fill_middle, registry


def expected(key, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_middle(spark, hostile, rate, spm):
    made = fill_middle.fill_in_middle(hostile, rate=rate, spm=spm)
    back = fill_middle.restored(F.col("fim.output"), F.col("fim.form"))
    rows = made.select("*", back.alias("back")).collect()
    assert len(rows) == hostile.count() and made.columns == ["doc_id", "text", "id", "_row", "component_id", "fim"]
    for r in rows:
        assert tuple(r["fim"]) == expected(r["doc_id"], r["text"], rate, spm)
        assert r["back"] == (r["text"] or "")
    assert fill_middle.fill_in_middle(hostile.limit(0)).count() == 0


def test_every_row_has_its_own_columns(hostile):
    assert {r["_row"] for r in fill_middle.fill_in_middle(hostile).select("_row").collect()} == {7, 1, None}


def test_text_ids_and_long_lines(spark):
    rows = [("α", "x" * 300_000), ("b", "line\n" * 50_000), (None, "a\nb")]
    for r in fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert tuple(r["fim"]) == expected(r["doc_id"], r["text"])


def test_sentinels_of_other_forms(spark):
    """Sentinels are literal text, and cuts beside characters of a sentinel don't mislead the way back."""
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    texts = ["<|pre\n|>x\n<|suf|\n>", "a\n<|\nb|>\n", "||\n<>\n"]
    docs = spark.createDataFrame([(k, t) for k in range(40) for t in texts], "doc_id long, text string")
    made = fill_middle.fill_in_middle(docs, sentinels=marks)
    back = fill_middle.restored(F.col("fim.output"), F.col("fim.form"), marks)
    assert made.where(back != F.col("text")).count() == 0 and made.select("fim.form").distinct().count() == 2


def test_plan_is_native(spark):
    plan = registry.op11_fill_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = registry.op11_fill_middle(spark, "/root/testdata/sf0.001")
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES['op11_fill_middle']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
