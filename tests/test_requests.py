import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sitelens.operators import requests as R
from sitelens.operators.admission import replay
from sitelens.operators.running import latest_before, running_sum
from sitelens.plans import url_queries

START = datetime(2024, 1, 1)


def make(spark, rows):
    df = spark.createDataFrame(
        [(i, ip, START + timedelta(seconds=s)) for i, (ip, s) in enumerate(rows)],
        "id long, ip_address string, created_at timestamp",
    )
    return df.withColumn("url", F.lit("u")).repartition(4)


def hot_rows(n, span, seed):
    """A key with more than half of all rows, many of them at the same instant."""
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(4)]
    return [(rng.choice(keys), rng.randrange(span)) for _ in range(n)]


def test_trailing_counts_with_hot_key_and_ties(spark):
    rows = hot_rows(1500, 40_000, 1) + [("edge", 0), ("edge", 3600), ("edge", 3601), ("edge", 7199)]
    got = {r.id: r.previous_requests for r in R.trailing_counts(make(spark, rows), 1).collect()}
    for i, (ip, s) in enumerate(rows):
        want = sum(1 for p, t in rows if p == ip and s - 3600 < t <= s) - 1
        assert got[i] == want, (i, ip, s)
    assert [got[len(rows) - k] for k in (4, 3, 2, 1)] == [0, 0, 1, 2]


def test_running_sum_over_small_cells(spark):
    rows = hot_rows(800, 500, 2)
    df = spark.createDataFrame([(k, t - 250, 1) for k, t in rows], "k string, at long, v int")
    got = running_sum(df, ["k"], "at", "v", "total", cell=7).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.total == sum(1 for k, t in rows if k == r.k and t - 250 <= r.at)


def test_latest_before_over_small_cells(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice([None, t])) for k, t in hot_rows(600, 900, 3)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    for r in latest_before(df, ["k"], "at", "v", "last", cell=5).collect():
        known = [v for k, t, v in rows if k == r.k and t <= r.at and v is not None]
        assert r["last"] == (max(known) if known else None)


def brute(rows, limit, window, earlier=()):
    state, out = {}, {}
    for k, a in sorted(earlier, key=lambda x: x[1]):
        state.setdefault(k, []).append(a)
    for k, a, i in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [x for x in state.get(k, []) if x > a - window]
        out[i] = len(live) < limit
        state[k] = live + [a] if out[i] else live
    return out


@pytest.mark.parametrize(
    "limit,window,span,early", [(1, 50, 400, False), (3, 100, 300, True), (7, 10, 120, False), (2, 7200, 20000, True)]
)
def test_admission_equals_sequential_replay_however_it_is_split(spark, limit, window, span, early):
    rows = [(k, t, i) for i, (k, t) in enumerate(hot_rows(900, span, limit))]
    earlier = [("hot", -1), ("hot", 1 - window)][:limit] if early else []
    want = brute(rows, limit, window, earlier)
    df = spark.createDataFrame(rows, "key string, at long, id long").repartition(5)
    known = spark.createDataFrame(earlier, "key string, at long") if early else None
    for max_session in (1_000_000, 5):
        got = replay(df, limit, window, known, max_session=max_session).collect()
        assert {r.id: r.admitted for r in got} == want and len(got) == len(rows)


def test_whitelisted_addresses_are_not_limited(spark):
    rows = [("10.0.0.1", 0)] * 5 + [("8.8.8.8", 0)] * 5
    got = R.admissions(make(spark, rows), 2, 1, whitelist=["10.0.0.0/8"]).collect()
    counts = {}
    for r in got:
        counts[r.ip_address] = counts.get(r.ip_address, 0) + r.admitted
    assert counts == {"10.0.0.1": 5, "8.8.8.8": 2}


def test_check_and_stats(spark):
    rows = [("a", s) for s in range(0, 3500, 100)] + [("b", 3400), ("c", 10)]
    df = make(spark, rows)
    last = R.rate_limit_check(df.filter("ip_address = 'a'")).orderBy(F.desc("created_at")).first()
    assert (last.allowed, last.remaining, last.current_count) == (False, 0, 34)
    assert last.seconds_until_reset == 200 and last.until_reset == "3m 20s"
    now = F.lit(START + timedelta(seconds=3610))
    stats = R.rate_limit_stats(df, now).first()
    assert tuple(stats) == (30, 35, 2, 1, 1)
    assert [tuple(r) for r in R.top_requesters(df, now).collect()] == [("a", 34, True), ("b", 1, False)]
    assert R.reset_limit(df, ["a"]).count() == 2


def test_screening(spark):
    urls = spark.createDataFrame(
        [(1, "http://ok.example/"), (2, "http://inner.example/"), (3, "http://gone.example/"),
         (4, "http://127.0.0.1/"), (5, "http://OK.example:81/"), (6, None)],
        "id int, url string",
    )
    addresses = spark.createDataFrame(
        [("ok.example", "8.8.8.8"), ("Inner.example", "10.0.0.2"), ("inner.example", "10.0.0.1"),
         ("inner.example", "10.0.0.1"), ("inner.example", "9.9.9.9")],
        "host string, ip string",
    )
    got = {r.id: (r.errors, r.blocked) for r in R.screen_urls(urls, addresses).collect()}
    assert got[1] == ([], 0)
    assert got[2] == ([f"Access to private IP address 10.0.0.{i} is not allowed" for i in (1, 2)], 2)
    assert got[3][0] == ["Could not resolve hostname to IP address"]
    assert got[4][0] == ["Localhost and IP addresses are not allowed"]
    assert got[5][0] == ["Invalid URL format: Port 81 is not allowed"]
    assert got[6][0] == ["URL is required"]
    assert R.blocked_addresses(addresses).count() == 2


def test_screened_messages_are_joined_once_for_a_host(spark):
    """With a separator the text is made before the join: rows carry no list of messages."""
    urls = spark.createDataFrame([(1, "http://a.example/"), (2, "http://b.example/"), (3, "http://127.0.0.1/"), (4, "http://c.example/")], "id long, url string")
    addresses = spark.createDataFrame([("a.example", f"10.0.0.{i}") for i in range(3)] + [("b.example", "8.8.8.8")], "host string, ip string")
    lists = {r.id: ("; ".join(r.errors), r.blocked) for r in R.screen_urls(urls, addresses).collect()}
    joined = R.screen_urls(urls, addresses, separator="; ")
    assert {r.id: (r.errors, r.blocked) for r in joined.collect()} == lists and lists[1][1] == 3
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Access to private" not in plan[: plan.index("Join LeftOuter")]


def test_screened_texts_are_written_once_a_file(spark, tmp_path):
    """Two hosts with 16,384 blocked addresses each: a file holds their texts once, not on every row."""
    rows = spark.range(0, 3840).selectExpr("id AS user_id").filter("user_id % 3 = 2 AND user_id % 20 < 2")
    rows = rows.crossJoin(spark.range(256).withColumnRenamed("id", "event_id")).withColumn("event_type", F.lit("error"))
    views = spark.range(40).selectExpr("id % 2 AS user_id", "id + 1000 AS event_id", "'view' AS event_type")
    rows.unionByName(views).write.parquet(str(tmp_path / "events.parquet"))
    url_queries.ssrf_screen(spark, str(tmp_path)).coalesce(1).write.parquet(str(tmp_path / "out"))
    files = [pq.ParquetFile(f) for f in (tmp_path / "out").glob("*.parquet")]
    columns = [f.metadata.row_group(i).column(1) for f in files for i in range(f.metadata.num_row_groups)]
    texts = [t for f in files for t in f.read(["errors"])["errors"].to_pylist() if t and t.startswith("Access")]
    assert len(texts) == 40 and len(set(texts)) == 2 and min(len(t) for t in texts) > 800_000
    assert sum(c.total_uncompressed_size for c in columns) < 3_000_000
