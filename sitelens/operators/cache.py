"""The analysis cache: keyed entries with a time to live.

Entries have ``id``, ``cache_key``, ``url``, ``created_at``, ``ttl_seconds`` and
``expires_at``; an entry is valid while ``expires_at`` is after (not at) the moment.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import cache_key, is_cache_key
from ..functions.values import format_bytes, from_micros, micros, own_key, seconds_interval
from .chain import admit_one
from .joins import join_unique
from .running import latest_before

# Default time to live, largest stored page, retention periods.
TTL_SECONDS = 21_600
MAX_STORED_BYTES = 524_288
REQUEST_HOURS = 24
LOG_DAYS = 30
SECOND = 1_000_000


def with_expiry(entries: DataFrame) -> DataFrame:
    expires = F.col("created_at") + seconds_interval(F.col("ttl_seconds"))
    return entries.withColumn("expires_at", expires)


def storable_html(html: Column) -> Column:
    """The page itself is kept only up to the size limit."""
    return F.when(F.octet_length(html) <= MAX_STORED_BYTES, html)


def latest_entries(entries: DataFrame) -> DataFrame:
    """One entry per key, the last written (by ``created_at``, then ``id``).

    A partial aggregate keeps one row per key and task, so a hot key is reduced
    before the shuffle.
    """
    rest = [c for c in entries.columns if c != "cache_key"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id"))
    return (
        entries.filter(is_cache_key(F.col("cache_key")))
        .groupBy("cache_key")
        .agg(newest.alias("_e"))
        .select("cache_key", "_e.*")
    )


def upsert(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Stored entries replaced by arriving ones of the same key."""
    return latest_entries(stored.unionByName(arriving, allowMissingColumns=True))


def dedup_urls(pages: DataFrame) -> DataFrame:
    """The page to keep per cache key: cache_key, page_id (the lowest), copies.

    Only keys and ids are shuffled.  Pages whose URL is not valid have no key and are
    left out.
    """
    keyed = pages.select(cache_key(F.col("url")).alias("cache_key"), "page_id")
    return (
        keyed.filter("cache_key IS NOT NULL")
        .groupBy("cache_key")
        .agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies"))
    )


def first_pages(pages: DataFrame) -> DataFrame:
    """``pages`` without later copies of a URL."""
    return pages.join(dedup_urls(pages).select("page_id"), "page_id", "left_semi")


def valid_at(now: Column) -> Column:
    return F.col("expires_at") > now


def lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """For each request (id, cache_key, created_at) the entry in the cache at that
    moment: entry_id and hit.  The cache holds the newest entry of a key; it is a hit
    only while valid.  A request whose key is not well formed, or without a time, misses."""
    possible = F.coalesce(is_cache_key(F.col("cache_key")), F.lit(False)) & F.col("created_at").isNotNull()
    asked = requests.filter(possible).select(
        "cache_key", micros(F.col("created_at")).alias("at"), "id",
        F.lit(None).cast("struct<at:bigint,id:bigint,expires:bigint>").alias("entry"),
        F.lit(True).alias("asked"),
    )
    written = entries.select(
        "cache_key", micros(F.col("created_at")).alias("at"), F.lit(None).cast("bigint").alias("id"),
        F.struct(
            micros(F.col("created_at")).alias("at"),
            F.col("id").cast("bigint").alias("id"),
            micros(F.col("expires_at")).alias("expires"),
        ).alias("entry"),
        F.lit(False).alias("asked"),
    )
    found = latest_before(asked.unionByName(written), ["cache_key"], "at", "entry", "newest")
    hit = F.coalesce(F.col("newest.expires") > F.col("at"), F.lit(False))
    answered = found.filter("asked").select(
        "id", "cache_key", from_micros(F.col("at")).alias("created_at"),
        F.when(hit, F.col("newest.id")).alias("entry_id"), hit.alias("hit"),
    )
    refused = requests.filter(~possible).select(
        "id", "cache_key", from_micros(micros(F.col("created_at"))).alias("created_at"),
        F.lit(None).cast("bigint").alias("entry_id"), F.lit(False).alias("hit"),
    )
    return answered.unionByName(refused)


def cache_replay(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Requests (id, cache_key, created_at) in time order: a hit while the last
    refresh of the key is valid, else a refresh.

    A refresh is the only admission of its time to live (see ``chain``).  A request without
    key or time cannot hit.
    """
    keyed = requests.select(
        F.col("cache_key").alias("key"), micros(F.col("created_at")).alias("at"), "id"
    )
    decided = admit_one(keyed, ttl_seconds * SECOND)
    possible = F.col("key").isNotNull() & F.col("at").isNotNull()
    return decided.select(
        "id", F.col("key").alias("cache_key"), from_micros(F.col("at")).alias("created_at"),
        (possible & ~F.col("admitted")).alias("hit"),
    )


def split_exports(urls: DataFrame, entries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """URLs that can be exported (a valid analysis is cached) and those that must be
    analysed first."""
    keyed = urls.withColumn("cache_key", cache_key(F.col("url")))
    valid = valid_keys(entries, now)
    ready = join_unique(keyed, valid, "cache_key", "left_semi")
    # Rows of an invalid URL have no key; they are missing whatever is cached.
    spread = keyed.withColumnRenamed("cache_key", "_key").withColumn(
        "cache_key", own_key(F.col("_key"), *urls.columns)
    )
    missing = join_unique(spread, valid, "cache_key", "left_anti")
    return ready, missing.drop("cache_key").withColumnRenamed("_key", "cache_key")


def valid_keys(entries: DataFrame, now: Column) -> DataFrame:
    return entries.filter(valid_at(now)).select("cache_key").distinct()


def orphans(files: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Stored files (cache_key, size) without a valid entry."""
    return join_unique(files, valid_keys(entries, now), "cache_key", "left_anti")


def invalidate(entries: DataFrame, urls: DataFrame) -> DataFrame:
    """Entries without those of the given URLs."""
    keys = urls.select(cache_key(F.col("url")).alias("cache_key")).distinct()
    gone = keys.filter("cache_key IS NOT NULL")
    return join_unique(entries, gone, "cache_key", "left_anti")


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns side by side, without a join."""
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def cache_stats(entries: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Entries, valid ones and their share in percent; stored files and their size."""
    counts = entries.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(valid_at(now)).alias("valid_entries"),
    )
    sizes = files.agg(
        F.count(F.lit(1)).alias("cache_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_file_size_bytes"),
    )
    share = F.when(F.col("total_entries") == 0, 0.0).otherwise(
        F.round(F.col("valid_entries") / F.greatest("total_entries", F.lit(1)) * 100, 2)
    )
    return one_row(counts, sizes).select(
        "*",
        format_bytes(F.col("total_file_size_bytes")).alias("total_file_size_formatted"),
        share.alias("valid_ratio"),
    )


def store_stats(
    requests: DataFrame, entries: DataFrame, logs: DataFrame, now: Column
) -> DataFrame:
    return one_row(
        requests.agg(F.count(F.lit(1)).alias("total_requests")),
        entries.agg(
            F.count(F.lit(1)).alias("total_cache_entries"),
            F.count_if(valid_at(now)).alias("valid_cache_entries"),
        ),
        logs.agg(F.count(F.lit(1)).alias("total_logs")),
    )


def expired(kind: str, now: Column) -> Column:
    """What a clean-up deletes.  An entry expiring exactly now is kept, though it can
    no longer be looked up."""
    if kind == "cache":
        return F.col("expires_at") < now
    if kind == "requests":
        return F.col("created_at") < now - seconds_interval(REQUEST_HOURS * 3_600)
    if kind == "logs":
        return F.col("created_at") < now - seconds_interval(LOG_DAYS * 86_400)
    raise ValueError(f"unknown table kind: {kind}")


def retained(table: DataFrame, kind: str, now: Column) -> DataFrame:
    return table.filter(~expired(kind, now))


def retention_counts(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """Deleted and kept rows per table."""
    out = None
    for kind, table in tables.items():
        row = table.agg(
            F.count_if(expired(kind, now)).alias("deleted"),
            F.count_if(~expired(kind, now)).alias("kept"),
        ).select(F.lit(kind).alias("table_name"), "deleted", "kept")
        out = row if out is None else out.unionByName(row)
    return out
