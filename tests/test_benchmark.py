"""Checks of benchmark cases, each kind once."""

from newsdesk.operators import stats

CASE = "id int, query string, search_limit int, expected_pattern string, url string, expected_fetcher string, expected_status int, expect_failure boolean"
PAGE = "url string, title string, final_url string, fetcher string, retrieved_at string, status int, failure string"


def test_cases(spark):
    cases = spark.createDataFrame([
        (1, " grid  power ", None, "EXAMPLE\\.org", None, None, None, None), (2, "grid power", 1, "example.org", None, None, None, None), (3, "none", None, "x", None, None, None, None),
        (4, None, None, None, "u", "http", 200, False), (5, None, None, None, "gone", "browser", 200, True), (6, "  ", None, None, "u", None, None, None),
        (7, None, None, None, "absent", None, None, None), (8, None, None, None, None, None, None, None),
    ], CASE)
    hits = spark.createDataFrame([("grid power", "https://a.com/", 1), ("grid power", "https://example.org/", 3), ("coal", "https://x/", 1)], "query string, url string, rank int")
    pages = spark.createDataFrame([("u", "T", "u", "http", "2024", 200, None), ("gone", "", None, "http", None, 404, "not found")], PAGE)
    got = stats.case_checks(cases, hits, pages)
    rows = {r["id"]: r for r in got.collect()}
    assert (rows[1]["search_returned"], rows[1]["search_relevant"], rows[1]["passed"]) == (True, True, True)
    assert (rows[2]["search_returned"], rows[2]["search_relevant"], rows[2]["passed"]) == (True, False, False)
    assert (rows[3]["search_returned"], rows[3]["search_relevant"]) == (False, False)
    assert tuple(rows[4])[3:] == (True, True, True, True, True, True, [], True) and rows[4]["search_returned"] is None
    assert tuple(rows[5])[3:] == (False, False, False, False, False, True, [], False)
    assert rows[6]["errors"] == ["the query is blank"] and rows[6]["fetch_succeeded"] is None and not rows[6]["passed"]
    assert rows[7]["errors"] == ["the page has no document"] and rows[8]["passed"] and len(rows) == 8
    assert tuple(stats.case_report(got).first()) == (8, 3, 37.5, 50.0, 50.0, 50.0)
    assert tuple(stats.case_report(got.limit(0)).first()) == (0, 0, None, None, None, None)
