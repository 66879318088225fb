"""Every request gets an answer, also one that cannot be counted, looked up or analysed."""

from pyspark.sql import functions as F

from sitelens.functions.urls import cache_key
from sitelens.operators import batch, cache, export, requests

KEY = "a" * 40
ASKED = "id bigint, ip_address string, created_at timestamp, cache_key string, url string"


def asked(spark):
    at = "2024-01-01 10:00:00"
    rows = [(1, "1.1.1.1", at, KEY), (2, None, at, KEY), (3, "1.1.1.1", None, None), (4, "1.1.1.1", at, "bad")]
    df = spark.createDataFrame(rows, "id bigint, ip_address string, created_at string, cache_key string")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_checks_and_admissions(spark):
    checked = {r.id: r for r in requests.rate_limit_check(asked(spark), limit=1).collect()}
    assert [checked[i].allowed for i in (1, 2, 3, 4)] == [False, False, False, False]
    assert [checked[i].current_count for i in (1, 2, 3, 4)] == [1, None, None, 1]
    admitted = {r.id: r.admitted for r in requests.admissions(asked(spark), limit=1).collect()}
    assert admitted == {1: True, 2: False, 3: False, 4: False}
    assert requests.reset_limit(asked(spark), ["1.1.1.1"]).count() == 1


def test_lookups_and_answers(spark):
    entries = spark.sql(
        f"SELECT 9L AS id, '{KEY}' AS cache_key, TIMESTAMP '2024-01-01 09:00:00' AS created_at,"
        " TIMESTAMP '2024-01-01 20:00:00' AS expires_at"
    )
    found = cache.lookup(asked(spark), entries)
    assert {r.id: r.hit for r in found.collect()} == {1: True, 2: True, 3: False, 4: False}
    checked = requests.rate_limit_check(asked(spark), limit=5)
    analyses = spark.sql(
        f"SELECT '{KEY}' AS cache_key, 'u' AS url, 'f' AS final_url, named_struct('t', 'x') AS analysis, 200 AS status_code,"
        " 'text/html' AS content_type, 7L AS content_length, 3L AS fetch_time_ms, 0 AS redirect_count"
    )
    answers = {r.id: r for r in export.responses(checked, found, analyses, 5).collect()}
    assert {i: r.error for i, r in answers.items()} == {
        1: None, 2: "Rate limit exceeded", 3: "Rate limit exceeded", 4: "No analysis of this URL",
    }
    assert answers[1].data.t == "x" and answers[1].meta.http.status_code == 200 and not answers[4].success


def test_every_blocked_address_is_reported(spark):
    urls = spark.createDataFrame([(1, "http://a.example.com/"), (2, "http://b.example.com/")], "id int, url string")
    hosts = spark.createDataFrame(
        [("a.example.com", "10.0.0.2"), ("A.example.com", "10.0.0.1"), ("a.example.com", "8.8.8.8"), ("b.example.com", "8.8.4.4")],
        "host string, ip string",
    )
    found = {r.id: (r.errors, r.blocked) for r in requests.screen_urls(urls, hosts).collect()}
    text = "Access to private IP address {} is not allowed"
    assert found == {1: ([text.format("10.0.0.1"), text.format("10.0.0.2")], 2), 2: ([], 0)}


def test_only_missing_pages_are_analysed(spark):
    html = "<title>t</title><link rel=icon href=/a.png>"
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/", html) for i in range(4)], "page_id int, url string, html string")
    entries = pages.filter("page_id < 2").select(
        cache_key(F.col("url")).alias("cache_key"),
        F.expr("CASE page_id WHEN 0 THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '2020-01-01' END").alias("expires_at"),
    )
    statuses = spark.createDataFrame([("http://h3.example.com/favicon.ico", 200), ("http://h3.example.com/a.png", 404)], "url string, http_code int")
    now = F.lit("2024-01-01").cast("timestamp")
    found = {r.page_id: r for r in batch.analyze_missing(pages, entries, now, statuses).collect()}
    assert {i: r.analysis.favicon for i, r in found.items()} == {1: None, 2: None, 3: "http://h3.example.com/favicon.ico"}
    assert all(r.analysis.meta.title == "t" and len(r.cache_key) == 40 for r in found.values())
    plain = batch.analyze_missing(pages, entries, now).filter("page_id = 3").first()
    assert plain.analysis.favicon == "http://h3.example.com/a.png"
