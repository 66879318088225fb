"""All registered queries."""

from pyspark.sql import DataFrame, SparkSession

from . import (
    cache_queries,
    export_queries,
    page_queries,
    request_queries,
    stream_queries,
    url_queries,
)

MODULES = (
    page_queries,
    url_queries,
    request_queries,
    cache_queries,
    export_queries,
    stream_queries,
)


def _in_utc(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Stored times have no zone; the data model is UTC throughout.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def queries():
    return {name: _in_utc(fn) for m in MODULES for name, fn in m.QUERIES.items()}


def oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
