"""Request-log analytics: trailing counts, rate limits, network lists, log clients.

Requests have ``id``, ``ip_address``, ``url``, ``user_agent`` and ``created_at``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.network import BLOCKED_RANGES, in_ranges, is_blocked
from ..functions.urls import errors_of_parts, url_parts
from ..functions.values import countdown_text, from_micros, micros, own_key, seconds_interval
from .admission import MAX_SESSION, replay
from .joins import join_unique
from .running import running_sum

# Default limit and its window.
LIMIT_PER_HOUR = 30
SECOND = 1_000_000
HOUR = 3_600 * SECOND


def trailing_counts(requests: DataFrame, hours: float = 1) -> DataFrame:
    """``requests`` with ``previous_requests``: the other requests of the same address
    created after (not at) ``hours`` before, up to and including the same instant;
    NULL for a request without address or time, which cannot be counted.

    Requests are first summed per address and instant; each sum counts from its
    instant on and stops counting one window later, so the answer is a running sum.
    """
    window = int(hours * HOUR)
    at = micros(F.col("created_at"))
    known = F.col("ip_address").isNotNull() & F.col("created_at").isNotNull()
    rows = requests.filter(known).withColumn("_at", at)
    instants = rows.groupBy("ip_address", "_at").agg(F.count(F.lit(1)).alias("_n"))

    def step(at, n, arrival):
        return F.struct(at.alias("at"), n.alias("n"), F.lit(arrival).alias("arrival"))

    first, n = F.col("_at"), F.col("_n")
    change = F.explode(F.array(step(first, n, True), step(first + window, -n, False)))
    changes = instants.select("ip_address", change.alias("c")).select("ip_address", "c.*")
    active = running_sum(changes, ["ip_address"], "at", "n", "active").filter("arrival")
    counts = active.select("ip_address", F.col("at").alias("_at"), "active")
    counted = rows.join(counts, ["ip_address", "_at"]).select(
        *requests.columns, (F.col("active") - 1).alias("previous_requests")
    )
    uncounted = requests.filter(~known).withColumn("previous_requests", F.lit(None).cast("bigint"))
    return counted.unionByName(uncounted)


def next_reset(ts: Column) -> Column:
    """Start of the next hour."""
    return F.date_trunc("hour", ts.cast("timestamp")) + F.expr("INTERVAL 1 HOUR")


def rate_limit_check(
    requests: DataFrame, limit: int = LIMIT_PER_HOUR, hours: float = 1
) -> DataFrame:
    """The answer a check at each request's time would give: allowed, remaining,
    current_count, reset_at and the time until then.  A request without address or
    time is not allowed, with no count."""
    counted = trailing_counts(requests, hours)
    count = F.col("previous_requests")
    reset = next_reset(F.col("created_at"))
    seconds = F.unix_seconds(reset) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return counted.withColumns(
        {
            "allowed": F.coalesce(count < limit, F.lit(False)),
            "remaining": F.greatest(F.lit(0), F.lit(limit) - count),
            "current_count": count,
            "reset_at": reset,
            "seconds_until_reset": seconds,
            "until_reset": countdown_text(seconds),
        }
    ).drop("previous_requests")


def quota_status(allowed: Column, remaining: Column, few: int = 5) -> Column:
    """``warning`` when denied, ``notice`` when few requests are left, else NULL."""
    return F.when(~allowed, "warning").when(remaining <= few, "notice")


def admissions(
    requests: DataFrame,
    limit: int = LIMIT_PER_HOUR,
    hours: float = 1,
    whitelist: list[str] = (),
    max_session: int = MAX_SESSION,
) -> DataFrame:
    """Check-and-record in time order: id, ip_address, created_at, admitted.

    Whitelisted addresses are always admitted; requests without address or time never.
    """
    every = requests.select(
        F.col("ip_address").alias("key"), micros(F.col("created_at")).alias("at"), "id"
    )
    known = F.col("key").isNotNull() & F.col("at").isNotNull()
    keyed, unknown = every.filter(known), every.filter(~known)
    exempt = in_ranges(F.col("key"), whitelist)
    limited = replay(
        keyed.filter(~exempt) if whitelist else keyed, limit, int(hours * HOUR),
        max_session=max_session,
    )
    if whitelist:
        limited = limited.unionByName(
            keyed.filter(exempt).withColumn("admitted", F.lit(True))
        )
    limited = limited.unionByName(unknown.withColumn("admitted", F.lit(False)))
    return limited.select(
        "id", F.col("key").alias("ip_address"), from_micros(F.col("at")).alias("created_at"),
        "admitted",
    )


def recent(requests: DataFrame, now: Column, hours: float = 1) -> DataFrame:
    # A plain comparison of the column, so that it reaches the scan.
    return requests.filter(F.col("created_at") > now - seconds_interval(int(hours * 3_600)))


def requests_per_address(requests: DataFrame, now: Column, hours: float = 1) -> DataFrame:
    return recent(requests, now, hours).groupBy("ip_address").agg(
        F.count(F.lit(1)).alias("request_count")
    )


def top_requesters(
    requests: DataFrame, now: Column, hours: float = 1, top: int = 10,
    limit: int = LIMIT_PER_HOUR,
) -> DataFrame:
    """The busiest addresses of the last ``hours`` (ties by address) and whether each
    has reached the limit."""
    counts = requests_per_address(requests, now, hours)
    return (
        counts.orderBy(F.desc("request_count"), "ip_address")
        .limit(top)
        .withColumn("rate_limited", F.col("request_count") >= limit)
    )


def rate_limit_stats(
    requests: DataFrame, now: Column, hours: float = 1, top: int = 10,
    limit: int = LIMIT_PER_HOUR,
) -> DataFrame:
    """One row: requests, distinct addresses, limited ones among the ``top`` and overall."""
    counts = requests_per_address(requests, now, hours)
    # Limited addresses come first by count, so the top list holds the first of them.
    totals = counts.agg(
        F.coalesce(F.sum("request_count"), F.lit(0)).alias("requests_last_hour"),
        F.count(F.lit(1)).alias("unique_ips_last_hour"),
        F.count_if(F.col("request_count") >= limit).alias("all_rate_limited"),
    )
    return totals.select(
        F.lit(limit).alias("limit_per_hour"),
        "requests_last_hour",
        "unique_ips_last_hour",
        F.least(F.col("all_rate_limited"), F.lit(top)).alias("rate_limited_count"),
        "all_rate_limited",
    )


def reset_limit(requests: DataFrame, addresses: list[str]) -> DataFrame:
    """Requests without those of the given addresses."""
    if not addresses:
        return requests
    return requests.filter(~F.coalesce(F.col("ip_address").isin(*addresses), F.lit(False)))


def split_whitelisted(requests: DataFrame, whitelist: list[str]) -> DataFrame:
    """``requests`` with ``whitelisted``; an empty list exempts nobody."""
    return requests.withColumn("whitelisted", in_ranges(F.col("ip_address"), whitelist))


def blocked_addresses(addresses: DataFrame, ranges=BLOCKED_RANGES) -> DataFrame:
    """Distinct (host, ip) of a resolution table whose address may not be fetched."""
    hits = addresses.filter(is_blocked(F.col("ip"), ranges))
    return hits.select(F.lower("host").alias("host"), "ip").distinct()


def screen_urls(
    urls: DataFrame, addresses: DataFrame, ranges=BLOCKED_RANGES, separator: str | None = None
) -> DataFrame:
    """``urls`` with ``errors`` and ``blocked``: the URL's own errors, else that its
    host does not resolve, else every blocked address, sorted, and how many there are.

    ``addresses`` (host, ip) stands for name resolution and is reduced to one row per
    host, with the set of its blocked addresses, before the join.  With a ``separator``,
    ``errors`` is one text, made once for each host and not for each URL.
    """

    def listed(errors):
        return errors if separator is None else F.array_join(errors, separator)

    # Tested once for each address, and its message written once for each host.
    distinct = addresses.select(F.lower("host").alias("host"), "ip").distinct()
    bad = distinct.withColumn("bad", F.when(is_blocked(F.col("ip"), ranges), F.col("ip")))
    per_host = bad.groupBy("host").agg(F.array_sort(F.collect_list("bad")).alias("bad")).select(
        "host",
        F.size("bad").alias("blocked"),
        listed(F.transform(
            "bad", lambda ip: F.concat(F.lit("Access to private IP address "), ip, F.lit(" is not allowed"))
        )).alias("refused"),
    )
    split = urls.withColumn("_parts", url_parts(F.col("url")))
    checked = split.withColumn("_errors", errors_of_parts(F.col("url"), F.col("_parts")))
    accepted = F.when(F.size("_errors") == 0, F.col("_parts.host"))
    checked = checked.withColumn("host", own_key(accepted, *urls.columns)).drop("_parts")
    unresolved = listed(F.array(F.lit("Could not resolve hostname to IP address")))
    network = F.when(F.col("blocked").isNull(), unresolved).otherwise(F.col("refused"))
    return (
        join_unique(checked, per_host, "host", "left")
        .withColumn(
            "errors",
            F.when(F.size("_errors") > 0, listed(F.col("_errors"))).otherwise(network),
        )
        .withColumn("blocked", F.coalesce("blocked", F.lit(0)).cast("bigint"))
        .select(*urls.columns, "errors", "blocked")
    )
