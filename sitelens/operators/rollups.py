"""Roll-ups of the analysis history from stored daily partial states.

A partial state is one row per host and day: counts, sums and a sketch of the
addresses.  States of one host and day can be merged, so rows that come late are added as
another state, and a report over a range of days reads states instead of history rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.urls import domain

SCHEMA = (
    "host STRING, analyses BIGINT, hits BIGINT, timed BIGINT, time_ms BIGINT, addresses BINARY,"
    " day DATE, batch BIGINT"
)
#: log2 of the sketch's registers: a standard error of about 0.8 %, 4 to 16 kB a state.
SKETCH_BITS = 14


def daily_states(history: DataFrame) -> DataFrame:
    """One mergeable state per host and day; rows without a time have the day NULL.

    Aggregated on the map side first, so a hot host sends one row per task and day.
    """
    rows = history.select(
        domain(F.col("url")).alias("host"), F.to_date("created_at").alias("day"),
        "cache_hit", "analysis_time_ms", "ip_address",
    )
    return rows.groupBy("host", "day").agg(
        F.count(F.lit(1)).alias("analyses"),
        F.count_if("cache_hit").alias("hits"),
        F.count("analysis_time_ms").alias("timed"),
        F.sum("analysis_time_ms").cast("bigint").alias("time_ms"),
        F.hll_sketch_agg("ip_address", F.lit(SKETCH_BITS)).alias("addresses"),
    )


def add(history: DataFrame, path: str, batch: int) -> None:
    """Add the states of arriving rows.  A batch that is repeated replaces its own states
    and changes nothing else."""
    states = daily_states(history).withColumn("batch", F.lit(batch).cast("bigint"))
    writer = states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day", "batch").parquet(path)


def read(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Stored states of the days from ``since`` to ``until`` (dates, both included)."""
    states = spark.read.schema(SCHEMA).parquet(path)
    if since is not None:
        states = states.filter(F.col("day") >= F.lit(since))
    if until is not None:
        states = states.filter(F.col("day") <= F.lit(until))
    return states


def compact(spark: SparkSession, path: str, target: str) -> None:
    """One state per host and day, written to a new folder as batch 0."""
    states = spark.read.schema(SCHEMA).parquet(path).groupBy("host", "day").agg(*_sums(), _merged().alias("addresses"))
    states.withColumn("batch", F.lit(0).cast("bigint")).write.partitionBy("day", "batch").parquet(target)


def _sums() -> list[Column]:
    return [F.sum(c).cast("bigint").alias(c) for c in ("analyses", "hits", "timed", "time_ms")]


def _merged() -> Column:
    return F.hll_union_agg("addresses")


def rolled_up(states: DataFrame, addresses: bool = True) -> DataFrame:
    """Per host and day, per host, and overall, as ``logs.history_rollup`` has it from the rows:
    analyses, hits, hit rate and mean time, and an estimate of the distinct ``addresses``."""
    more = [F.hll_sketch_estimate(_merged()).alias("addresses")] if addresses else []
    totals = (
        states.withColumn("day", F.date_format("day", "yyyy-MM-dd")).rollup("host", "day").agg(*_sums(), *more)
    )
    return totals.select(
        "host", "day", "analyses", "hits",
        (F.col("hits") / F.col("analyses") * 100).alias("hit_rate"),
        F.try_divide("time_ms", "timed").alias("mean_time_ms"),
        *(["addresses"] if addresses else []),
    )
