"""Plans keep their shape: hot keys are split, filters reach the scan."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators import cache as C
from sitelens.operators import requests as R


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tasks(spark):
    """Thresholds scaled down, so that a few thousand rows count as a large table."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_host_is_split_in_screening(spark, small_tasks):
    urls = spark.range(0, 40_000, 1, 8).select(
        "id",
        F.concat(
            F.lit("http://"),
            F.when(F.col("id") % 3 == 0, "hot.example").otherwise(F.concat(F.lit("h"), F.col("id"), F.lit(".example"))),
            F.lit("/"), F.sha2(F.col("id").cast("string"), 256),
        ).alias("url"),
    )
    addresses = spark.range(0, 2_000, 1, 4).select(
        F.when(F.col("id") == 0, "hot.example").otherwise(F.concat(F.lit("h"), F.col("id"), F.lit(".example"))).alias("host"),
        F.concat(F.lit("9.9.9."), F.col("id") % 250).alias("ip"),
    )
    screened = R.screen_urls(urls, addresses)
    assert len(screened.collect()) == 40_000
    assert "skew=true" in plan_of(screened)


def test_rows_without_a_key_do_not_meet(spark):
    urls = spark.range(1_000).select("id", F.lit("ftp://x").alias("url"))
    addresses = spark.createDataFrame([("a", "9.9.9.9")], "host string, ip string")
    plan = R.screen_urls(urls, addresses)
    assert plan.filter("size(errors) = 1 AND blocked = 0").count() == 1_000
    entries = spark.createDataFrame([("k", 1)], "cache_key string, x int").withColumn(
        "expires_at", F.current_timestamp()
    )
    ready, missing = C.split_exports(urls, entries, F.lit("2020-01-01").cast("timestamp"))
    assert ready.count() == 0 and missing.count() == 1_000
    assert missing.columns == ["id", "url", "cache_key"]


def test_no_window_over_all_rows_of_a_key(spark, small_tasks):
    requests = spark.range(0, 1_000, 1, 4).select(
        "id", F.lit("hot").alias("ip_address"), F.lit("u").alias("url"),
        F.timestamp_seconds(F.col("id") * 60).alias("created_at"),
    ).filter("rand() >= 0")
    plan = plan_of(R.trailing_counts(requests))
    windows = [line for line in plan.splitlines() if "+- Window [" in line]
    assert len(windows) == 2
    assert "_cell" in windows[0].split("windowspecdefinition(")[1].split("ASC")[0]
    assert "sum(_value" in windows[1], "the other window is over one value per cell"


def test_time_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(
        "id", F.lit("a").alias("ip_address"), F.timestamp_seconds(F.col("id")).alias("created_at"),
        F.timestamp_seconds(F.col("id") + 10).alias("expires_at"),
    ).write.parquet(path)
    table = spark.read.parquet(path)
    now = F.timestamp_seconds(F.lit(100))
    assert "GreaterThan(created_at" in plan_of(R.recent(table, now, 0.01))
    assert R.recent(table, now, 0.01).count() == 35
    assert "GreaterThan(expires_at" in plan_of(table.filter(C.valid_at(now)))
    assert "GreaterThanOrEqual(created_at" in plan_of(C.retained(table, "requests", now))
