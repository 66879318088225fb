"""The stored tables: schemas, append by day, pruned reads, deletion by day."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMAS = {
    "requests": "id BIGINT, ip_address STRING, url STRING, user_agent STRING, created_at TIMESTAMP",
    "cache": (
        "id BIGINT, cache_key STRING, url STRING, final_url STRING, http_status INT,"
        " content_type STRING, content_length INT, created_at TIMESTAMP, ttl_seconds INT,"
        " expires_at TIMESTAMP"
    ),
    "logs": (
        "id BIGINT, level STRING, message STRING, context_json STRING, ip_address STRING,"
        " user_agent STRING, url STRING, created_at TIMESTAMP"
    ),
    "analysis_history": (
        "id BIGINT, ip_address STRING, url STRING, final_url STRING, http_status INT,"
        " title STRING, meta_description STRING, og_title STRING, og_description STRING,"
        " cache_hit INT, analysis_time_ms INT, created_at TIMESTAMP"
    ),
}


def append(rows: DataFrame, path: str) -> None:
    """Append to a table partitioned by the day of ``created_at``, so that reads of a
    time span, and retention, touch only the days concerned."""
    dated = rows.withColumn("day", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, kind: str, since=None, until=None) -> DataFrame:
    """A stored table, of the days from ``since`` to ``until`` (dates, both included)."""
    table = spark.read.schema(SCHEMAS[kind] + ", day DATE").parquet(path)
    if since is not None:
        table = table.filter(F.col("day") >= F.lit(since))
    if until is not None:
        table = table.filter(F.col("day") <= F.lit(until))
    return table.drop("day")


def delete(spark: SparkSession, path: str, kind: str, gone: Column, until=None) -> None:
    """Delete rows of a stored table for which ``gone`` holds.

    Only days that hold such rows change: a day that keeps none loses its folder, the
    others are written anew, and the files of all other days stay as they are.  Days after
    ``until`` (a date) are not even read.  Rows for which ``gone`` is null stay.  A day is
    exchanged when all its new files are written; a repeat deletes nothing more.
    """
    table = spark.read.schema(SCHEMAS[kind] + ", day DATE").parquet(path)
    if until is not None:
        table = table.filter(F.col("day") <= F.lit(until))
    gone = F.coalesce(gone, F.lit(False))
    # One row for each day concerned, as many as there are folders.
    touched = (
        table.groupBy("day")
        .agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("kept"))
        .filter("gone > 0")
        .collect()
    )
    shrunk = [r.day for r in touched if r.kept]
    if shrunk:
        concerned = F.col("day").isin([d for d in shrunk if d is not None])
        if None in shrunk:
            concerned = concerned | F.col("day").isNull()
        rows = table.filter(concerned & ~gone)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in touched:
        if not row.kept:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/day={row.day or '__HIVE_DEFAULT_PARTITION__'}")
            folder.getFileSystem(conf).delete(folder, True)
