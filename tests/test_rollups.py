"""Stored daily states against the history rows."""

from datetime import date
from pathlib import Path

import pytest

from sitelens.operators import logs, rollups


def plain(rows):
    return sorted(((r.host, r.day, r.analyses, r.hits, r.hit_rate, r.mean_time_ms) for r in rows), key=repr)


@pytest.fixture
def history(spark):
    # Host 0 holds a third of all rows; rows without a time, a duration or a host are there as well.
    return spark.range(9000).selectExpr(
        "id",
        "CASE WHEN id % 100 <> 7 THEN concat('http://h', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 9 END, '.example/p') END AS url",
        "concat('10.', id % 20, '.', id % 251, '.', id % 7) AS ip_address", "id % 4 = 0 AS cache_hit",
        "CASE WHEN id % 50 <> 1 THEN id % 997 END AS analysis_time_ms",
        "CASE WHEN id % 90 <> 4 THEN timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) END AS created_at",
    )


def test_states_equal_rows(spark, history, tmp_path):
    path = str(tmp_path / "states")
    # Late rows come in the third batch; the second is repeated.
    for batch in (0, 1, 2, 1):
        rollups.add(history.filter(f"id % 3 = {batch}"), path, batch)
    states = rollups.read(spark, path)
    assert plain(rollups.rolled_up(states).collect()) == plain(logs.history_rollup(history).collect())
    rollups.compact(spark, path, str(tmp_path / "small"))
    small = rollups.read(spark, str(tmp_path / "small"))
    assert small.count() < states.count()
    assert plain(rollups.rolled_up(small).collect()) == plain(logs.history_rollup(history).collect())


def test_a_range_reads_its_days_only(spark, history, tmp_path):
    path = str(tmp_path / "states")
    rollups.add(history, path, 0)
    since, until = date(2024, 1, 2), date(2024, 1, 4)
    states = rollups.read(spark, path, since, until)
    rows = history.filter(f"to_date(created_at) BETWEEN date '{since}' AND date '{until}'")
    assert plain(rollups.rolled_up(states).collect()) == plain(logs.history_rollup(rows).collect())
    assert all(f"day={d}" in "".join(states.inputFiles()) for d in (since, until))
    assert "PartitionFilters: [isnotnull(day" in states._jdf.queryExecution().executedPlan().toString()


def test_a_batch_touches_its_days_only(spark, history, tmp_path):
    path = str(tmp_path / "states")
    rollups.add(history.filter("created_at < timestamp '2024-01-03 00:00:00'"), path, 0)
    before = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    rollups.add(history.filter("created_at >= timestamp '2024-01-02 00:00:00'"), path, 1)
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items())


def test_distinct_addresses_within_three_standard_errors(spark, history, tmp_path):
    path = str(tmp_path / "states")
    # Rows without a time would form a second row with the day NULL.
    history = history.filter("created_at IS NOT NULL")
    for batch in (0, 1):
        rollups.add(history.filter(f"id % 2 = {batch}"), path, batch)
    found = {(r.host, r.day): r.addresses for r in rollups.rolled_up(rollups.read(spark, path)).collect() if r.day is None}
    assert len(found) == 9
    by_host = history.selectExpr("regexp_extract(url, '^https?://([^/:?#]*)', 1) AS host", "ip_address").distinct()
    for host, n in by_host.groupBy("host").count().collect():
        if host is not None:
            assert abs(found[host, None] - n) <= 0.025 * n


def test_empty(spark, history, tmp_path):
    rollups.add(history.limit(0), str(tmp_path / "states"), 0)
    assert rollups.daily_states(history.limit(0)).collect() == []
