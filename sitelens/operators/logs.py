"""Application logs and the analysis history."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.urls import domain
from ..functions.values import truncate

# Accepted levels, and lengths at which history texts are cut.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
TITLE_LENGTH = 500
DESCRIPTION_LENGTH = 1_000


def log_records(records: DataFrame) -> DataFrame:
    """Level in upper case, an empty context map NULL, else JSON; other levels are
    refused by the table and left out."""
    context = F.when(F.size("context") > 0, F.to_json("context"))
    return (
        records.withColumns({"level": F.upper("level"), "context_json": context})
        .filter(F.col("level").isin(*LEVELS))
        .drop("context")
    )


def recent_logs(
    logs: DataFrame, level: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Newest first (ties by id); a page of ``limit`` rows."""
    kept = logs.filter(F.col("level") == level.upper()) if level else logs
    return kept.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def log_search(logs: DataFrame) -> DataFrame:
    """Per level: all lines, those about blocked requests and those about errors."""
    return logs.groupBy("level").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("message").rlike("SSRF|Rate limit")).alias("blocked_lines"),
        F.count_if(F.col("level") == "ERROR").alias("error_lines"),
    )


def history_records(analyses: DataFrame, requests_info: dict[str, Column]) -> DataFrame:
    """History rows from analysis records: texts cut, hit as 0/1, the rest from
    ``requests_info`` (ip_address, cache_hit, analysis_time_ms, ...)."""
    a = F.col("analysis")
    texts = {
        "title": truncate(a["meta"]["title"], TITLE_LENGTH),
        "meta_description": truncate(a["meta"]["description"], DESCRIPTION_LENGTH),
        "og_title": truncate(a["open_graph"]["title"], TITLE_LENGTH),
        "og_description": truncate(a["open_graph"]["description"], DESCRIPTION_LENGTH),
    }
    info = dict(requests_info)
    if "cache_hit" in info:
        info["cache_hit"] = info["cache_hit"].cast("int")
    return analyses.select(
        "page_id", "url",
        *[c.alias(n) for n, c in texts.items()],
        *[c.alias(n) for n, c in info.items()],
    )


def newest_per_address(history: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` rows of every address (ties by id).

    A rank below a constant is applied before the shuffle as well, so a hot address
    sends no more than ``limit`` rows per task.
    """
    newest = Window.partitionBy("ip_address").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        history.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit)
    )


def history_rollup(history: DataFrame) -> DataFrame:
    """Per host and day, per host, and overall: analyses, hits, hit rate (percent) and mean
    time, not rounded."""
    with_day = history.select(
        domain(F.col("url")).alias("host"),
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        "cache_hit",
        "analysis_time_ms",
    )
    return (
        with_day.rollup("host", "day")
        .agg(
            F.count(F.lit(1)).alias("analyses"),
            F.count_if("cache_hit").alias("hits"),
            (F.count_if("cache_hit") / F.count(F.lit(1)) * 100).alias("hit_rate"),
            F.avg("analysis_time_ms").alias("mean_time_ms"),
        )
    )
