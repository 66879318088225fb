"""The main path for a whole crawl: only pages without a valid cached analysis are parsed."""

from pyspark.sql import Column, DataFrame, functions as F

from .cache import split_exports
from .joins import join_unique
from .pages import analyze, reachable_icons


def analyze_missing(
    pages: DataFrame, entries: DataFrame, now: Column, statuses: DataFrame | None = None, **options: bool
) -> DataFrame:
    """Analyses of the ``pages`` (page_id, url, html) whose key has no valid entry.

    The pages are anti-joined with the valid keys before anything is parsed, and a
    page whose URL has no key is analysed.  With a crawl status table the icon in the
    record is the first reachable one.  The result has ``cache_key`` and ``analysis``
    beside the other columns of ``pages``, ready for ``upsert`` and ``history_records``.
    """
    _, missing = split_exports(pages, entries, now)
    analysed = analyze(missing, **options)
    if statuses is None:
        return analysed
    icons = reachable_icons(missing, statuses)
    joined = join_unique(analysed, icons, "page_id", "left")
    return joined.withColumn("analysis", F.col("analysis").withField("favicon", F.col("favicon"))).drop("favicon")
