import datetime as dt

from palimpsest.llm import urls


def day(x):
    return dt.date.fromisoformat(x)


def test_intervals_and_longest_pattern(spark):
    entries = spark.createDataFrame([("Example.com", "review", day("2024-01-01")), ("example.com", "none", day("2024-06-01")), ("bad.example.com/a", "block", day("2024-02-01")), ("bad.example.com", "allow", day("2024-02-01")), (None, "block", day("2024-01-01")), ("x.org", "allow", day("2024-01-01")), ("x.org", "block", day("2024-01-01"))], "pattern string, action string, since date")
    rows = [
        (1, "https://bad.example.com/a/b?q=1", "2024-03-01", "bad.example.com/a", "block"), (2, "http://user@BAD.example.com:80/ab", "2024-03-01", "bad.example.com", "allow"),
        (3, "http://bad.example.com/a", "2024-01-15", "example.com", "review"), (4, "http://example.com", "2024-06-01", None, None), (5, "http://notexample.com/", "2024-03-01", None, None),
        (6, None, "2024-03-01", None, None), (7, "no url", "2024-03-01", None, None), (8, "http://x.org/", "2024-01-01", "x.org", "block"), (9, "http://x.org/", None, None, None), (9, "http://x.org/", None, None, None),
    ]
    captures = spark.createDataFrame([(i, u, t and day(t), "p", "a", "k") for i, u, t, _, _ in rows], "page_id long, url string, fetched date, pattern string, action string, keep string")
    out = urls.judge(captures, entries, "page_id").collect()
    assert sorted((r._id, r.pattern or "", r.action or "", r.keep) for r in out) == sorted((i, p or "", a or "", a != "block") for i, _, _, p, a in rows)
    assert urls.judge(captures.limit(0), entries, "page_id").count() == 0
    assert urls.judge(captures, entries.limit(0), "page_id").where("keep").count() == len(rows)


def test_query_equals_sql(spark, small, oracle, same):
    same(urls.op6_url_filter(spark, small).toPandas(), oracle(urls.SQL))
