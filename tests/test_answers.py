"""Recorded search answers as a data source."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from newsdesk.sources import answers


@pytest.fixture
def read(spark, tmp_path):
    answers.register(spark)
    hit = lambda n, **more: {"title": f" T{n} ", "url": f"https://www.a.example/{n}?utm_source=x", "snippet": "a \n b"} | more
    (tmp_path / "brave.json").write_text(json.dumps({
        "queries": {"grid  power ": [hit(1), hit(2, url=""), hit(1, title="again"), hit(3, publisher="P", publishedAt=" 2024 "), "junk"], "coal": [hit(n) for n in range(30)]},
        "results": [hit(9)],
    }))
    (tmp_path / "other.json").write_text(json.dumps({"results": [hit(7)]}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "notes.txt").write_text("no answers")

    def go(**options):
        return spark.read.format("search_answers").options(path=str(tmp_path), **options).load()

    return go


def test_hits(read):
    got = answers.search_web(read().where("query = 'grid power'")).orderBy("rank").collect()
    assert [(r["rank"], r["title"], r["url"], r["publisher"], r["published_at"], r["snippet"]) for r in got] == [
        (1, "T1", "https://www.a.example/1", "a.example", None, "a b"), (4, "T3", "https://www.a.example/3", "P", "2024", "a b")
    ]
    assert read(limit="3").where("query = 'coal'").count() == 3 and read().where("query = 'coal'").count() == 10
    broken = read().where("error IS NOT NULL").collect()
    assert [r["provider"] for r in broken] == ["broken"] and answers.search_web(read()).where("provider = 'broken'").count() == 0


def test_asked_queries(read):
    """A query that isn't recorded gets the provider's other results; the empty query is none."""
    got = read(queries=json.dumps(["sun", " grid\tpower", "sun", " "])).where("error IS NULL").groupBy("provider", "query").agg(F.count("*")).collect()
    assert sorted(map(tuple, got)) == [("brave", "grid power", 5), ("brave", "sun", 1), ("other", "grid power", 1), ("other", "sun", 1)]


def test_filters_reach_the_files(read):
    """Spark is left with the filters that the source doesn't answer, and files of other providers aren't opened."""
    plan = read().where("provider = 'other' AND query IN ('coal', 'sun') AND position >= 0")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "position" in plan.split("Filter")[1].split("BatchScan")[0] and "other" not in plan and "coal" not in plan
    reader = answers.AnswerReader({"path": "/nowhere"})
    rest = list(reader.pushFilters([EqualTo(("provider",), "other"), In(("query",), ("a", "b")), EqualTo(("query",), "a"), EqualTo(("position",), 1)]))
    assert rest == [EqualTo(("position",), 1)] and reader.only == {"provider": {"other"}, "query": {"a"}}
    assert read().rdd.getNumPartitions() == 3 and read().where("provider = 'other'").rdd.getNumPartitions() == 1
    assert read().where("provider = 'nobody'").count() == 0
    with pytest.raises(ValueError, match="needs the option path"):
        answers.AnswerReader({})
