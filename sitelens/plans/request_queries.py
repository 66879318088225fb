"""Queries on request logs, application logs and the analysis history."""

from datetime import date

from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import ranges as N
from ..operators import requests as R
from ..operators import rollups
from ..sources import crawl
from ..functions.text import log_line
from . import standin as S
from .shared import shared_dir

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


LIMIT, HOURS = 5, 24
WINDOW_US = HOURS * 3_600_000_000
TRAILING = f"""(count(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL {WINDOW_US - 1} MICROSECONDS PRECEDING AND CURRENT ROW) - 1)"""


@query(
    "trailing_requests",
    f"SELECT event_id AS id, concat('', user_id) AS ip_address, {TRAILING} AS previous_requests"
    " FROM events",
)
def trailing_requests(spark, sf):
    counted = R.trailing_counts(S.client_requests(spark, sf), HOURS)
    return counted.select("id", "ip_address", "previous_requests")


SECONDS_LEFT = "(3600 - (epoch_us(ts) // 1000000) % 3600)"


@query(
    "rate_limit_check",
    f"""SELECT id, n < {LIMIT} AS allowed, greatest(0, {LIMIT} - n) AS remaining, n AS current_count,
       strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS reset_at,
       s AS seconds_until_reset,
       CASE WHEN s >= 3600 THEN '1h 0m' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's'
            ELSE s || 's' END AS until_reset
    FROM (SELECT event_id AS id, ts, {TRAILING} AS n, {SECONDS_LEFT} AS s FROM events)""",
)
def rate_limit_check(spark, sf):
    checked = R.rate_limit_check(S.client_requests(spark, sf), LIMIT, HOURS)
    return checked.select(
        "id", "allowed", "remaining", "current_count",
        F.date_format("reset_at", "yyyy-MM-dd HH:mm:ss").alias("reset_at"),
        "seconds_until_reset", "until_reset",
    )


# Every 7th request has no address and every 11th no time.
UNKNOWN = "(event_id % 7 = 0 OR event_id % 11 = 0)"


def _partly_unknown(spark, sf):
    return S.client_requests(spark, sf).withColumns(
        {
            "ip_address": F.when(F.col("id") % 7 != 0, F.col("ip_address")),
            "created_at": F.when(F.col("id") % 11 != 0, F.col("created_at")),
        }
    )


@query(
    "rate_limit_unknown",
    f"""SELECT event_id AS id, n < {LIMIT} AS allowed, greatest(0, {LIMIT} - n) AS remaining, n AS current_count
    FROM (SELECT event_id, {TRAILING} AS n FROM events WHERE NOT {UNKNOWN})
    UNION ALL SELECT event_id, false, 0, NULL FROM events WHERE {UNKNOWN}""",
)
def rate_limit_unknown(spark, sf):
    checked = R.rate_limit_check(_partly_unknown(spark, sf), LIMIT, HOURS)
    return checked.select("id", "allowed", "remaining", "current_count")


@query(
    "request_reset",
    "SELECT event_id AS id, concat('', user_id) AS ip_address FROM events WHERE user_id >= 100",
)
def request_reset(spark, sf):
    requests = S.client_requests(spark, sf)
    return R.reset_limit(requests, [str(i) for i in range(100)]).select("id", "ip_address")


@query(
    "quota_status",
    f"""SELECT id, CASE WHEN n >= {LIMIT} THEN 'warning' WHEN {LIMIT} - n <= 2 THEN 'notice' END AS status
    FROM (SELECT event_id AS id, {TRAILING} AS n FROM events)""",
)
def quota_status(spark, sf):
    checked = R.rate_limit_check(S.client_requests(spark, sf), LIMIT, HOURS)
    return checked.select(
        "id", R.quota_status(F.col("allowed"), F.col("remaining"), few=2).alias("status")
    )


def fold_sql(key, limit, window_us):
    """Admission replay as a recursive query: one step per request of a key."""
    return f"""WITH RECURSIVE seq AS (
      SELECT event_id AS id, {key} AS k, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
    fold AS (
      SELECT id, k, n, true AS admitted, [t] AS taken FROM seq WHERE n = 1
      UNION ALL
      SELECT id, k, n, len(live) < {limit},
             CASE WHEN len(live) < {limit} THEN list_append(live, t) ELSE live END
      FROM (SELECT s.id, s.k, s.n, s.t, list_filter(f.taken, lambda x: x > s.t - {window_us}) AS live
            FROM fold f JOIN seq s ON s.k = f.k AND s.n = f.n + 1))"""


@query(
    "rate_limit_admission",
    fold_sql("concat('', user_id)", LIMIT, WINDOW_US)
    + " SELECT id, k AS ip_address, admitted FROM fold",
)
def rate_limit_admission(spark, sf):
    decided = R.admissions(S.client_requests(spark, sf), LIMIT, HOURS)
    return decided.select("id", "ip_address", "admitted")


PER_USER = f"""per_user AS (
    SELECT concat('', user_id) AS ip_address, count(*) AS request_count FROM events
    WHERE ts > (SELECT max(ts) FROM events) - INTERVAL {HOURS} HOUR GROUP BY user_id)"""


@query(
    "top_requesters",
    f"""WITH {PER_USER} SELECT ip_address, request_count, request_count >= {LIMIT} AS rate_limited
    FROM per_user ORDER BY request_count DESC, ip_address LIMIT 10""",
)
def top_requesters(spark, sf):
    requests = S.client_requests(spark, sf)
    return R.top_requesters(requests, S.now(requests, "created_at"), HOURS, 10, LIMIT)


@query(
    "rate_limit_stats",
    f"""WITH {PER_USER}, top AS (
      SELECT * FROM per_user ORDER BY request_count DESC, ip_address LIMIT 10)
    SELECT CAST({LIMIT} AS BIGINT) AS limit_per_hour,
      (SELECT CAST(sum(request_count) AS BIGINT) FROM per_user) AS requests_last_hour,
      (SELECT count(*) FROM per_user) AS unique_ips_last_hour,
      (SELECT count(*) FROM top WHERE request_count >= {LIMIT}) AS rate_limited_count,
      (SELECT count(*) FROM per_user WHERE request_count >= {LIMIT}) AS all_rate_limited""",
)
def rate_limit_stats(spark, sf):
    requests = S.client_requests(spark, sf)
    stats = R.rate_limit_stats(requests, S.now(requests, "created_at"), HOURS, 10, LIMIT)
    return stats.withColumn("limit_per_hour", F.col("limit_per_hour").cast("long"))


TIME = "%Y-%m-%d %H:%M:%S"


@query(
    "log_records",
    f"""SELECT event_id AS id, {S.LEVEL} AS level, {S.MESSAGE} AS message,
       CASE WHEN event_type <> 'view' THEN '{{"event":"' || event_type || '","user":"' || user_id || '"}}'
       END AS context_json FROM events""",
)
def log_records(spark, sf):
    context = F.when(
        F.col("event_type") != "view",
        F.create_map(
            F.lit("event"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    raw = S.events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.lower(F.expr(S.LEVEL)).alias("level"),
        F.expr(S.MESSAGE).alias("message"),
        context.alias("context"),
    )
    return L.log_records(raw)


@query(
    "recent_logs",
    f"""SELECT id, level, message, strftime(created_at, '{TIME}') AS created_at FROM (
      SELECT {S.LOGS} FROM events) WHERE level = 'WARN'
    ORDER BY logs_at DESC, id DESC LIMIT 100 OFFSET 20""".replace("logs_at", "created_at"),
)
def recent_logs(spark, sf):
    page = L.recent_logs(S.logs(spark, sf), "warn", limit=100, offset=20)
    return page.select(
        "id", "level", "message",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query(
    "log_search",
    f"""SELECT level, count(*) AS lines,
       count(*) FILTER (WHERE message LIKE '%SSRF%' OR message LIKE '%Rate limit%') AS blocked_lines,
       count(*) FILTER (WHERE level = 'ERROR') AS error_lines
    FROM (SELECT {S.LOGS} FROM events) GROUP BY level""",
)
def log_search(spark, sf):
    return L.log_search(S.logs(spark, sf))


@query(
    "parse_log_lines",
    f"""SELECT event_id AS id, strftime(ts, '{TIME}') AS created_at, {S.LEVEL} AS level,
       {S.MESSAGE} AS message, CASE WHEN event_type <> 'view' THEN props END AS context FROM events""",
)
def parse_log_lines(spark, sf):
    written = S.spread(S.logs(spark, sf)).select(
        "id",
        log_line(
            F.col("created_at"), F.col("level"), F.col("message"), F.col("context")
        ).alias("line"),
    )
    return crawl.parse_log_lines(written).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    "history_topn",
    f"""SELECT id, ip_address, position FROM (
      SELECT event_id AS id, concat('', user_id) AS ip_address,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position
      FROM events) WHERE position <= 50""",
)
def history_topn(spark, sf):
    newest = L.newest_per_address(S.history(spark, sf), 50)
    return newest.select("id", "ip_address", F.col("position").cast("long").alias("position"))


@query(
    "history_rollup",
    f"""SELECT host, day, count(*) AS analyses, count(*) FILTER (WHERE cache_hit) AS hits,
       count(*) FILTER (WHERE cache_hit) / count(*) * 100 AS hit_rate,
       avg(analysis_time_ms) AS mean_time_ms
    FROM (SELECT regexp_extract(url, '^https?://([^/:?#]*)', 1) AS host,
                 strftime(created_at, '%Y-%m-%d') AS day, cache_hit, analysis_time_ms
          FROM (SELECT {S.HISTORY} FROM events))
    GROUP BY ROLLUP (host, day)""",
)
def history_rollup(spark, sf):
    return L.history_rollup(S.history(spark, sf))


SINCE, UNTIL = date(2024, 1, 5), date(2024, 1, 20)


@query(
    "history_rollup_stored",
    f"""SELECT host, day, count(*) AS analyses, count(*) FILTER (WHERE cache_hit) AS hits,
       count(*) FILTER (WHERE cache_hit) / count(*) * 100 AS hit_rate,
       avg(analysis_time_ms) AS mean_time_ms
    FROM (SELECT regexp_extract(url, '^https?://([^/:?#]*)', 1) AS host,
                 strftime(created_at, '%Y-%m-%d') AS day, cache_hit, analysis_time_ms
          FROM (SELECT {S.HISTORY} FROM events)
          WHERE CAST(created_at AS DATE) BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}')
    GROUP BY ROLLUP (host, day)""",
)
def history_rollup_stored(spark, sf):
    """From daily states that three batches left behind, one of them late and one repeated."""
    history, path = S.history(spark, sf), shared_dir(spark, "rollup")
    for batch in (0, 1, 2, 1):
        rollups.add(history.filter(F.col("id") % 3 == batch), path, batch)
    return rollups.rolled_up(rollups.read(spark, path, SINCE, UNTIL), addresses=False)


# -- ranges that are a table --------------------------------------------------------

# A range from every order line, 8 to 32 bits long; from every part one of IPv6.
LINE_BITS = "(8 + 4 * (l_orderkey % 7))"
LINE_NET = """concat(l_partkey % 200 + 1, '.', l_suppkey % 256, '.', l_orderkey % 256, '.', l_linenumber * 16)"""
PART_BITS = "(32 + 8 * (p_partkey % 3))"
LOOKED_UP = """CASE WHEN event_type = 'purchase' THEN concat('2001:db8:', {hex}, '::', user_id % 9 + 1)
    ELSE concat(user_id % 240 + 1, '.', event_id % 256, '.', (user_id + event_id) % 256, '.', event_id % 128) END"""


def range_table(spark, sf):
    lines = S.select(S.table(spark, sf, "lineitem"), f"concat({LINE_NET}, '/', {LINE_BITS}) AS cidr")
    v6 = f"concat('2001:db8:', lower(hex(p_partkey % 65536)), '::/', {PART_BITS}) AS cidr"
    return lines.unionByName(S.select(S.table(spark, sf, "part"), v6))


def looked_up(spark, sf):
    ip = LOOKED_UP.format(hex="lower(hex(user_id % 65536))")
    return S.select(S.events(spark, sf), f"event_id AS id, {ip} AS ip_address")


V4_NUMBER = "({0} * 16777216 + {1} * 65536 + {2} * 256 + {3})"
LINE_NUMBER = V4_NUMBER.format("(l_partkey % 200 + 1)", "(l_suppkey % 256)", "(l_orderkey % 256)", "(l_linenumber * 16)")
EVENT_NUMBER = V4_NUMBER.format("(user_id % 240 + 1)", "(event_id % 256)", "((user_id + event_id) % 256)", "(event_id % 128)")
RANGE_SQL = f"""WITH v4 AS (
      SELECT {LINE_BITS} AS bits, {LINE_NUMBER} // (2 ** (32 - {LINE_BITS}))::BIGINT AS prefix,
             min(concat({LINE_NET}, '/', {LINE_BITS})) AS range FROM lineitem GROUP BY 1, 2),
    v6 AS (
      SELECT {PART_BITS} AS bits, (p_partkey % 65536) // (2 ** (48 - {PART_BITS}))::BIGINT AS prefix,
             min(concat('2001:db8:', printf('%x', p_partkey % 65536), '::/', {PART_BITS})) AS range FROM part GROUP BY 1, 2),
    asked AS (
      SELECT event_id AS id, event_type = 'purchase' AS six, {EVENT_NUMBER} AS number, user_id % 65536 AS part,
             {LOOKED_UP.format(hex="printf('%x', user_id % 65536)")} AS ip_address FROM events),
    held AS (
      SELECT id, bits, range FROM asked JOIN v4 ON NOT six AND number // (2 ** (32 - bits))::BIGINT = prefix
      UNION ALL SELECT id, bits, range FROM asked JOIN v6 ON six AND part // (2 ** (48 - bits))::BIGINT = prefix),
    best AS (SELECT id, arg_max(range, bits) AS range FROM held GROUP BY id)"""


@query("range_lookup", RANGE_SQL + " SELECT id, ip_address, range FROM asked LEFT JOIN best USING (id)")
def range_lookup(spark, sf):
    """The longest of many ranges that holds each address."""
    return N.longest_ranges(looked_up(spark, sf), range_table(spark, sf))


@query("whitelist_table", RANGE_SQL + " SELECT id, range IS NOT NULL AS whitelisted FROM asked LEFT JOIN best USING (id)")
def whitelist_table(spark, sf):
    return N.whitelisted(looked_up(spark, sf), range_table(spark, sf)).select("id", "whitelisted")
