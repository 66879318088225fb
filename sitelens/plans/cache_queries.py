"""Queries on the analysis cache and on retention."""

from pyspark.sql import functions as F

from ..operators import cache as C
from ..sources import tables
from . import standin as S
from .request_queries import fold_sql
from .shared import shared_dir

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


KEY = f"sha1({S.ENTRY_URL})"
# Purchases and sign-ups write the page of a user to the cache; every event asks for it.
USER_URL = "concat('http://site', user_id % 20, '.example.com/', user_id)"
USER_KEY = f"sha1({USER_URL})"
WRITES = "event_type IN ('purchase', 'signup')"
NOW = "(SELECT max(ts) FROM events)"
TTL = "INTERVAL 21600 SECOND"
FILES = f"""
    {KEY} AS cache_key,
    max(CAST(floor(value * 1000) AS BIGINT)) AS size"""


# 1024 of a unit are still shown in it; two decimals, without zeros at the end.
SIZE_TEXT = "CASE " + " ".join(
    f"WHEN bytes <= {1024 ** (i + 1)} THEN"
    f" regexp_replace(printf('%.2f', round(bytes / {1024**i}, 2)), '\\.?0+$', '') || ' {unit}'"
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB"))
) + " END"


def asked(spark, sf):
    return S.select(
        S.events(spark, sf), f"event_id AS id, {USER_KEY} AS cache_key, ts AS created_at"
    )


def written(spark, sf):
    rows = S.events(spark, sf).filter(WRITES)
    return C.with_expiry(
        S.select(
            rows,
            f"event_id AS id, {USER_URL} AS url, {USER_KEY} AS cache_key, ts AS created_at,"
            " 21600 AS ttl_seconds",
        )
    )


def files(spark, sf):
    size = F.floor(F.col("value") * 1000).cast("bigint")
    return (
        S.events(spark, sf)
        .groupBy(F.expr(KEY).alias("cache_key"))
        .agg(F.max(size).alias("size"))
    )


def with_now(spark, sf):
    entries = S.entries(spark, sf)
    return entries, S.now(entries, "created_at")


@query(
    "cache_lookup",
    f"""WITH w AS (SELECT event_id AS entry, {USER_KEY} AS k, ts FROM events WHERE {WRITES}),
    r AS (SELECT event_id AS id, {USER_KEY} AS k, ts FROM events)
    SELECT r.id, r.k AS cache_key,
           CASE WHEN w.ts + {TTL} > r.ts THEN w.entry END AS entry_id,
           coalesce(w.ts + {TTL} > r.ts, false) AS hit
    FROM r ASOF LEFT JOIN w ON r.k = w.k AND r.ts >= w.ts""",
)
def cache_lookup(spark, sf):
    found = C.lookup(asked(spark, sf), written(spark, sf))
    return found.select("id", "cache_key", "entry_id", "hit")


@query(
    "cache_replay",
    fold_sql(KEY, 1, 21_600_000_000)
    + " SELECT id, k AS cache_key, NOT admitted AS hit FROM fold",
)
def cache_replay(spark, sf):
    requests = S.entries(spark, sf).select("id", "cache_key", "created_at")
    return C.cache_replay(requests).select("id", "cache_key", "hit")


@query(
    "cache_upsert",
    f"""SELECT {KEY} AS cache_key, arg_max(event_id, (ts, event_id)) AS id,
       strftime(max(ts) + {TTL}, '%Y-%m-%d %H:%M:%S.%f') AS expires_at FROM events GROUP BY 1""",
)
def cache_upsert(spark, sf):
    entries, now = with_now(spark, sf)
    cut = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    stored = entries.filter(F.col("created_at") < cut)
    arriving = entries.filter(F.col("created_at") >= cut)
    return C.upsert(stored, arriving).select(
        "cache_key", "id",
        F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("expires_at"),
    )


@query(
    "cache_stats",
    f"""WITH f AS (SELECT {FILES} FROM events GROUP BY 1),
    n AS (SELECT count(*) AS total_entries,
                 count(*) FILTER (WHERE ts + {TTL} > {NOW}) AS valid_entries FROM events),
    s AS (SELECT count(*) AS cache_files, CAST(sum(size) AS BIGINT) AS bytes FROM f)
    SELECT total_entries, valid_entries, cache_files, bytes AS total_file_size_bytes,
           {SIZE_TEXT} AS total_file_size_formatted,
           round(valid_entries / total_entries * 100, 2) AS valid_ratio FROM n, s""",
)
def cache_stats(spark, sf):
    entries, now = with_now(spark, sf)
    return C.cache_stats(entries, files(spark, sf), now)


@query(
    "cache_orphans",
    f"""SELECT cache_key, size FROM (SELECT {FILES} FROM events GROUP BY 1)
    WHERE cache_key NOT IN (SELECT {KEY} FROM events WHERE ts + {TTL} > {NOW})""",
)
def cache_orphans(spark, sf):
    entries, now = with_now(spark, sf)
    return C.orphans(files(spark, sf), entries, now)


@query(
    "cache_invalidate",
    f"""SELECT event_id AS id, {KEY} AS cache_key FROM events
    WHERE {KEY} NOT IN (SELECT {KEY} FROM events WHERE event_type = 'error')""",
)
def cache_invalidate(spark, sf):
    entries = S.entries(spark, sf)
    failed = S.select(
        S.events(spark, sf).filter("event_type = 'error'"), f"upper({S.ENTRY_URL}) AS url"
    )
    urls = failed.select(F.regexp_replace(F.lower("url"), "^http://", "").alias("url"))
    return C.invalidate(entries, urls).select("id", "cache_key")


@query(
    "export_missing",
    f"""SELECT event_id AS id, {KEY} AS cache_key, {KEY} IN (
         SELECT {KEY} FROM events WHERE ts + {TTL} > {NOW}) AS ready FROM events""",
)
def export_missing(spark, sf):
    entries, now = with_now(spark, sf)
    ready, missing = C.split_exports(entries.select("id", "url"), entries, now)
    marked = ready.withColumn("ready", F.lit(True)).unionByName(
        missing.withColumn("ready", F.lit(False))
    )
    return marked.select("id", "cache_key", "ready")


@query(
    "store_stats",
    f"""SELECT count(*) AS total_requests, count(*) AS total_cache_entries,
       count(*) FILTER (WHERE ts + {TTL} > {NOW}) AS valid_cache_entries, count(*) AS total_logs
    FROM events""",
)
def store_stats(spark, sf):
    entries, now = with_now(spark, sf)
    return C.store_stats(S.requests(spark, sf), entries, S.logs(spark, sf), now)


# A moment at which all three periods cut: cache 6 h, requests 24 h, logs 30 days.
LATER = "INTERVAL 10 DAY"


@query(
    "retention",
    "".join(
        f"""{union}SELECT '{name}' AS table_name, count(*) FILTER (WHERE {gone}) AS deleted,
            count(*) FILTER (WHERE NOT ({gone})) AS kept FROM events"""
        for union, name, gone in (
            ("", "cache", f"ts + {TTL} < {NOW}"),
            (" UNION ALL ", "requests", f"ts < {NOW} - INTERVAL 24 HOUR"),
            (" UNION ALL ", "logs", f"ts < {NOW} + {LATER} - INTERVAL 30 DAY"),
        )
    ),
)
def retention(spark, sf):
    entries, now = with_now(spark, sf)
    counts = C.retention_counts({"cache": entries, "requests": S.requests(spark, sf)}, now)
    later = now + F.expr(LATER)
    return counts.unionByName(C.retention_counts({"logs": S.logs(spark, sf)}, later))


RESET = "10.2."


@query(
    "stored_clean_up",
    f"""SELECT 'requests' AS table_name, event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at
    FROM (SELECT {S.REQUESTS}, event_id, ts FROM events)
    WHERE ts >= {NOW} - INTERVAL 24 HOUR AND NOT starts_with(ip_address, '{RESET}')
    UNION ALL SELECT 'cache', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') FROM events
    WHERE ts + {TTL} >= {NOW} AND event_type <> 'error'
    UNION ALL SELECT 'logs', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') FROM events
    WHERE ts >= {NOW} + {LATER} - INTERVAL 30 DAY""",
)
def stored_clean_up(spark, sf):
    """Stored tables, appended in two parts, after expiry, the reset of addresses and the
    invalidation of pages have changed them."""
    entries, now = with_now(spark, sf)
    ends = {"requests": now, "cache": now, "logs": now + F.expr(LATER)}
    rows = {"requests": S.requests(spark, sf), "cache": entries, "logs": S.logs(spark, sf)}
    more = {
        "requests": F.col("ip_address").startswith(RESET),
        "cache": F.col("url").contains("/error/"),
    }
    out = None
    for kind, table in rows.items():
        path = shared_dir(spark, f"stored-{kind}")
        for half in (0, 1):
            tables.append(table.filter(F.col("id") % 2 == half), path)
        tables.delete(spark, path, kind, C.expired(kind, ends[kind]))
        if kind in more:
            tables.delete(spark, path, kind, more[kind])
        left = tables.read(spark, path, kind).select(
            F.lit(kind).alias("table_name"), "id",
            F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        )
        out = left if out is None else out.unionByName(left)
    return out
