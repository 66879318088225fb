import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitelens.operators import cache as C
from sitelens.operators import logs as L

NOW = datetime(2024, 3, 1)
K = ["a" * 40, "b" * 40, "c" * 40]


def entries(spark, rows):
    df = spark.createDataFrame(
        [(i, k, NOW + timedelta(seconds=s), ttl) for i, (k, s, ttl) in enumerate(rows)],
        "id long, cache_key string, created_at timestamp, ttl_seconds int",
    )
    return C.with_expiry(df.withColumn("url", F.lit("http://x.example/")))


def test_an_entry_expiring_now_is_kept_but_not_valid(spark):
    df = entries(spark, [(K[0], -100, 100), (K[1], -100, 101), (K[2], -100, 99)])
    now = F.lit(NOW)
    assert [r.id for r in df.filter(C.valid_at(now)).collect()] == [1]
    assert sorted(r.id for r in C.retained(df, "cache", now).collect()) == [0, 1]
    stats = C.cache_stats(df, spark.createDataFrame([(K[0], 2048)], "cache_key string, size long"), now).first()
    assert (stats.total_entries, stats.valid_entries, stats.valid_ratio) == (3, 1, 33.33)
    assert (stats.cache_files, stats.total_file_size_formatted) == (1, "2 KB")
    empty = C.cache_stats(df.limit(0), spark.createDataFrame([], "cache_key string, size long"), now).first()
    assert (empty.total_entries, empty.valid_ratio, empty.total_file_size_bytes) == (0, 0.0, 0)


def test_retention_edges(spark):
    rows = [(1, NOW - timedelta(hours=24)), (2, NOW - timedelta(hours=24, seconds=1)),
            (3, NOW - timedelta(days=30)), (4, NOW - timedelta(days=30, seconds=1))]
    df = spark.createDataFrame(rows, "id int, created_at timestamp")
    assert [r.id for r in C.retained(df, "requests", F.lit(NOW)).collect()] == [1]
    assert [r.id for r in C.retained(df, "logs", F.lit(NOW)).collect()] == [1, 2, 3]


def test_upsert_last_write_wins(spark):
    stored = entries(spark, [(K[0], 0, 10), (K[1], 0, 10), ("not a key", 0, 10)])
    arriving = entries(spark, [(K[0], 5, 10), (K[2], 5, 10), (K[0], 5, 10)])
    got = {r.cache_key: (r.id, r.created_at) for r in C.upsert(stored, arriving).collect()}
    later = NOW + timedelta(seconds=5)
    assert got == {K[0]: (2, later), K[1]: (1, NOW), K[2]: (1, later)}


def test_lookup_sees_the_newest_entry_only(spark):
    rng = random.Random(9)
    made = [(rng.choice(K[:2]), rng.randrange(5000), rng.choice([50, 300, 2000])) for _ in range(300)]
    asked = [(rng.choice(K), rng.randrange(5500)) for _ in range(400)] + [("bad key", 1)]
    requests = spark.createDataFrame(
        [(i, k, NOW + timedelta(seconds=s)) for i, (k, s) in enumerate(asked)],
        "id long, cache_key string, created_at timestamp",
    )
    got = {r.id: (r.entry_id, r.hit) for r in C.lookup(requests, entries(spark, made)).collect()}
    assert len(got) == 401 and got[400] == (None, False)  # a refused key misses
    for i, (k, s) in enumerate(asked[:400]):
        known = [(t, j, ttl) for j, (mk, t, ttl) in enumerate(made) if mk == k and t <= s]
        newest = max(known) if known else None
        hit = bool(newest and newest[0] + newest[2] > s)
        assert got[i] == (newest[1] if hit else None, hit)


def test_cache_replay(spark):
    rows = [(0, 0), (1, 99), (2, 100), (3, 199), (4, 200), (5, 200)]
    df = spark.createDataFrame(
        [(i, K[0], NOW + timedelta(seconds=s)) for i, s in rows],
        "id long, cache_key string, created_at timestamp",
    )
    got = {r.id: r.hit for r in C.cache_replay(df, 100).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_dedup_orphans_exports(spark):
    pages = spark.createDataFrame(
        [(3, "HTTP://x.example"), (1, "x.example/"), (2, "http://y.example/"), (4, "ftp://z")],
        "page_id long, url string",
    )
    got = [(r.page_id, r.copies) for r in C.dedup_urls(pages).orderBy("page_id").collect()]
    assert got == [(1, 2), (2, 1)]
    assert sorted(r.page_id for r in C.first_pages(pages).collect()) == [1, 2]
    key = C.dedup_urls(pages).filter("page_id = 1").first().cache_key
    stored = entries(spark, [(key, -10, 100), (K[1], -500, 100)])
    ready, missing = C.split_exports(pages, stored, F.lit(NOW))
    assert sorted(r.page_id for r in ready.collect()) == [1, 3]
    assert sorted(r.page_id for r in missing.collect()) == [2, 4]
    files = spark.createDataFrame([(key, 1), (K[1], 2), (K[2], 3)], "cache_key string, size long")
    assert sorted(r["size"] for r in C.orphans(files, stored, F.lit(NOW)).collect()) == [2, 3]
    left = C.invalidate(stored, pages).collect()
    assert [r.cache_key for r in left] == [K[1]]


def test_stored_page_size(evaluate):
    sizes = evaluate(["x" * 524_288, "é" * 262_145], F.length(C.storable_html(F.col("x"))))
    assert sizes == [524_288, None]


def test_logs_and_history(spark):
    logs = spark.createDataFrame(
        [(i, lvl, msg, NOW + timedelta(seconds=s)) for i, (lvl, msg, s) in enumerate(
            [("WARN", "SSRF attempt", 5), ("ERROR", "x", 5), ("WARN", "Rate limit exceeded", 9), ("INFO", "ok", 1)])],
        "id long, level string, message string, created_at timestamp",
    )
    assert [r.id for r in L.recent_logs(logs).collect()] == [2, 1, 0, 3]
    assert [r.id for r in L.recent_logs(logs, "warn", limit=1, offset=1).collect()] == [0]
    found = {r.level: (r.lines, r.blocked_lines, r.error_lines) for r in L.log_search(logs).collect()}
    assert found == {"WARN": (2, 2, 0), "ERROR": (1, 0, 1), "INFO": (1, 0, 0)}
    raw = spark.createDataFrame(
        [("info", {"a": "é/"}), ("warn", {}), ("loud", None), ("debug", None)], "level string, context map<string,string>"
    )
    rows = [(r.level, r.context_json) for r in L.log_records(raw).collect()]
    assert rows == [("INFO", '{"a":"é/"}'), ("WARN", None), ("DEBUG", None)]
    history = logs.withColumn("ip_address", F.col("level"))
    plan = L.newest_per_address(history, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "limited before the shuffle as well"
    assert sorted(r.id for r in L.newest_per_address(history, 1).collect()) == [1, 2, 3]
