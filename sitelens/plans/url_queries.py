"""Queries on URLs, addresses and other request input."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.network import client_ip, matching_range
from ..functions.urls import cache_key, domain, normalize_error, normalize_url, url_errors
from ..operators import cache as C
from ..operators import requests as R
from . import standin as S

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# Every page URL in ten spellings, with what each must become.  The pieces are cut
# from the URL with simple patterns, since all page URLs are well formed.
PIECES = """
pieces AS (
  SELECT page_id, url, regexp_extract(url, '^(https?)', 1) AS scheme,
         regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS rest
  FROM pages),
spelled AS (
  SELECT page_id, kind, CASE kind
    WHEN 0 THEN url
    WHEN 1 THEN '  ' || upper(scheme) || '://' || upper(host) || rest || ' '
    WHEN 2 THEN host || rest
    WHEN 3 THEN 'http://' || host || ':443' || path
    WHEN 4 THEN scheme || '://' || host || ':8080' || rest
    WHEN 5 THEN 'ftp://' || host || rest
    WHEN 6 THEN scheme || '://user:pw@' || host || '?0#0'
    WHEN 7 THEN 'https://' || host || ':443' || path || '#frag'
    WHEN 8 THEN 'http://bad_' || host || rest
    WHEN 9 THEN 'http://127.0.0.1' || path
    WHEN 10 THEN 'https://LocalHost/'
    WHEN 11 THEN '0'
    WHEN 12 THEN scheme || '://' || host || '/' || repeat('x', 2040)
    ELSE scheme || '://' || host || ':99999/' END AS spelling,
    scheme, host, path, rest
  FROM pieces, (SELECT unnest(range(0, 14)) AS kind))"""
NORMALIZED = """CASE kind
    WHEN 0 THEN url_of WHEN 1 THEN url_of WHEN 2 THEN 'http://' || host || slash_rest
    WHEN 3 THEN 'http://' || host || ':443' || slash_path
    WHEN 6 THEN scheme || '://' || host || '/'
    WHEN 7 THEN 'https://' || host || slash_path || '#frag'
    WHEN 9 THEN 'http://127.0.0.1' || slash_path WHEN 10 THEN 'https://localhost/'
    WHEN 12 THEN spelling END"""
ERROR = """CASE kind WHEN 4 THEN 'Port 8080 is not allowed'
    WHEN 5 THEN 'Only HTTP and HTTPS schemes are allowed' WHEN 8 THEN 'Invalid hostname'
    WHEN 11 THEN 'URL must have scheme and host' WHEN 13 THEN 'Invalid URL format' END"""
DERIVED = f"""
derived AS (
  SELECT *, scheme || '://' || host || slash_rest AS url_of FROM (
    SELECT *, CASE WHEN path = '' THEN '/' || rest ELSE rest END AS slash_rest,
           CASE WHEN path = '' THEN '/' ELSE path END AS slash_path FROM spelled)),
expected AS (SELECT page_id, kind, {NORMALIZED} AS normalized, {ERROR} AS error FROM derived)"""


def spellings(spark, sf):
    url = F.col("url")
    scheme = F.regexp_extract(url, "^(https?)", 1)
    host = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "^https?://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, "^https?://[^/?#]*(.*)$", 1)
    sep = F.lit("://")
    kinds = [
        url,
        F.concat(F.lit("  "), F.upper(scheme), sep, F.upper(host), rest, F.lit(" ")),
        F.concat(host, rest),
        F.concat(F.lit("http://"), host, F.lit(":443"), path),
        F.concat(scheme, sep, host, F.lit(":8080"), rest),
        F.concat(F.lit("ftp://"), host, rest),
        F.concat(scheme, F.lit("://user:pw@"), host, F.lit("?0#0")),
        F.concat(F.lit("https://"), host, F.lit(":443"), path, F.lit("#frag")),
        F.concat(F.lit("http://bad_"), host, rest),
        F.concat(F.lit("http://127.0.0.1"), path),
        F.lit("https://LocalHost/"),
        F.lit("0"),
        F.concat(scheme, sep, host, F.lit("/"), F.repeat(F.lit("x"), 2040)),
        F.concat(scheme, sep, host, F.lit(":99999/")),
    ]
    return S.pages(spark, sf).select(
        "page_id", F.posexplode(F.array(*kinds)).alias("kind", "url")
    ).withColumn("kind", F.col("kind").cast("long"))


@query(
    "url_normalize",
    f"WITH {PIECES}, {DERIVED} SELECT page_id, kind, normalized, error FROM expected",
)
def url_normalize(spark, sf):
    return spellings(spark, sf).select(
        "page_id", "kind", normalize_url(F.col("url")).alias("normalized"),
        normalize_error(F.col("url")).alias("error"),
    )


@query(
    "cache_key",
    f"WITH {PIECES}, {DERIVED} SELECT page_id, kind, sha1(normalized) AS cache_key FROM expected",
)
def cache_keys(spark, sf):
    return spellings(spark, sf).select(
        "page_id", "kind", cache_key(F.col("url")).alias("cache_key")
    )


@query(
    "url_validate",
    f"""WITH {PIECES}, {DERIVED} SELECT page_id, kind, CASE WHEN kind = 11 THEN 'URL is required'
      WHEN error IS NOT NULL THEN 'Invalid URL format: ' || error
      WHEN kind IN (9, 10) THEN 'Localhost and IP addresses are not allowed'
      WHEN kind = 12 THEN 'URL is too long (maximum 2048 characters)' ELSE '' END AS errors
    FROM expected""",
)
def url_validate(spark, sf):
    return spellings(spark, sf).select(
        "page_id", "kind", F.array_join(url_errors(F.col("url")), "; ").alias("errors")
    )


@query(
    "pages_per_domain",
    """SELECT regexp_extract(url, '^https?://([^/:?#]*)', 1) AS domain, count(*) AS n_pages
    FROM pages GROUP BY 1""",
)
def pages_per_domain(spark, sf):
    return (
        S.pages(spark, sf)
        .groupBy(domain(F.col("url")).alias("domain"))
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )


@query(
    "dedup_urls",
    f"""WITH {PIECES}, {DERIVED} SELECT sha1(normalized) AS cache_key, min(page_id * 100 + kind) AS page_id,
       count(*) AS copies FROM expected WHERE normalized IS NOT NULL GROUP BY 1""",
)
def dedup_urls(spark, sf):
    spelled = spellings(spark, sf).select(
        (F.col("page_id") * 100 + F.col("kind")).alias("page_id"), "url"
    )
    return C.dedup_urls(spelled).select("cache_key", "page_id", "copies")


RANGES = ["10.1.0.0/16", "10.2.64.0/18", "10.0.8.2", "172.16.0.0/12", "fc00::/7"]
IN_RANGES = """CASE
    WHEN user_id % 4 = 1 THEN '10.1.0.0/16'
    WHEN user_id % 4 = 2 AND user_id % 256 BETWEEN 64 AND 127 THEN '10.2.64.0/18'
    WHEN user_id % 4 = 0 AND user_id % 256 = 8 AND event_id % 4 = 2 THEN '10.0.8.2' END"""


@query(
    "blocked_ips",
    f"""SELECT event_id AS id, {IN_RANGES} AS matched FROM events
    WHERE ({IN_RANGES}) IS NOT NULL""",
)
def blocked_ips(spark, sf):
    requests = S.requests(spark, sf)
    matched = requests.select("id", matching_range(F.col("ip_address"), RANGES).alias("matched"))
    return matched.filter("matched IS NOT NULL")


@query(
    "whitelist_requests",
    """SELECT event_id AS id, (user_id % 4 = 3 OR (user_id % 4 = 2 AND user_id % 256 = 6
       AND event_id % 4 = 1)) AS whitelisted FROM events""",
)
def whitelist_requests(spark, sf):
    marked = R.split_whitelisted(S.requests(spark, sf), ["10.3.0.0/16", "10.2.6.1"])
    return marked.select("id", "whitelisted")


# Name resolution stands on events too: twenty hosts, every third address blocked.
ADDRESSES = """
    concat('site', user_id % 20, '.example.com') AS host,
    concat(8 + user_id % 3, '.', user_id % 256, '.', event_id % 256, '.9') AS ip"""
SCREENED_URL = """CASE event_type WHEN 'error' THEN concat('http://127.0.0.', user_id % 9)
    WHEN 'signup' THEN concat('https://site', user_id % 20, '.example.com:81/')
    ELSE concat('site', user_id % 25, '.example.com/x') END"""


#: The text of a host, up to 1 MB, is on each of its rows.  With room for the texts of all hosts, a
#: Parquet file holds each of them once; with the usual 1 MB a writer buffers pages of 100 whole rows.
ONCE_A_FILE = {
    "parquet.dictionary.page.size": str(32 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
}


@query(
    "ssrf_screen",
    f"""WITH a AS (SELECT DISTINCT {ADDRESSES} FROM events),
    h AS (SELECT host, count(*) FILTER (WHERE ip LIKE '10.%') AS blocked,
                 string_agg('Access to private IP address ' || ip || ' is not allowed', '; ' ORDER BY ip)
                   FILTER (WHERE ip LIKE '10.%') AS bad FROM a GROUP BY host),
    e AS (SELECT event_id AS id, event_type, CASE event_type WHEN 'error' THEN '127'
            WHEN 'signup' THEN concat('site', user_id % 20, '.example.com')
            ELSE concat('site', user_id % 25, '.example.com') END AS host,
            user_id FROM events)
    SELECT id, CASE event_type WHEN 'error' THEN 'Localhost and IP addresses are not allowed'
             WHEN 'signup' THEN 'Invalid URL format: Port 81 is not allowed'
             ELSE CASE WHEN blocked IS NULL THEN 'Could not resolve hostname to IP address'
                       WHEN blocked > 0 THEN bad
                       ELSE '' END END AS errors,
           CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE coalesce(blocked, 0) END AS blocked
    FROM e LEFT JOIN h USING (host)""",
)
def ssrf_screen(spark, sf):
    for key, value in ONCE_A_FILE.items():
        spark.conf.set(key, value)
    events = S.spread(S.events(spark, sf))
    urls = S.select(events, f"event_id AS id, {SCREENED_URL} AS url")
    screened = R.screen_urls(urls, S.select(events, ADDRESSES), separator="; ")
    return screened.select("id", "errors", "blocked")


@query(
    "client_ip",
    """SELECT event_id AS id, CASE event_type
        WHEN 'view' THEN concat('93.184.', user_id % 256, '.', event_id % 256)
        WHEN 'click' THEN '8.8.8.8'
        WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN '10.0.0.1' ELSE '127.0.0.1' END
        WHEN 'purchase' THEN concat('2a00::', user_id % 10) ELSE '198.51.100.7' END AS client_ip
    FROM events""",
)
def client_ips(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id")
    headers = F.map_filter(
        F.create_map(
            F.lit("HTTP_CLIENT_IP"),
            F.when(
                kind == "view",
                F.concat(F.lit("93.184."), user % 256, F.lit("."), F.col("event_id") % 256),
            ).when(kind == "click", "192.168.0.9"),
            F.lit("HTTP_X_FORWARDED_FOR"),
            F.when(kind == "click", " 8.8.8.8 , 10.0.0.3")
            .when(kind == "error", "10.0.0.4, 8.8.4.4")
            .when(kind == "purchase", F.concat(F.lit("2a00::"), user % 10, F.lit(",x"))),
            F.lit("HTTP_FORWARDED"),
            F.when(kind == "signup", "fe80::1"),
            F.lit("REMOTE_ADDR"),
            F.when(kind == "signup", "198.51.100.7").when(
                (kind == "error") & (user % 2 == 0), "10.0.0.1"
            ),
        ),
        lambda k, v: v.isNotNull(),
    )
    return S.spread(S.events(spark, sf)).select(
        F.col("event_id").alias("id"), client_ip(headers).alias("client_ip")
    )


ESCAPED = "text"
for _char, _entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
    ESCAPED = f"replace({ESCAPED}, '{_char}', '{_entity}')"


@query(
    "sanitize_text",
    f"""SELECT doc_id, md5({ESCAPED}) AS text_md5, regexp_replace(lang, '[^0-9+\\-]', '', 'g') AS digits
    FROM (SELECT doc_id, lang, regexp_replace(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11)),
      '<!--(?s:.*?)-->', '', 'g'), '<[^\\s](?:[^>"'']|"[^"]*"|''[^'']*'')*(?:>|$)', '', 'g') AS text
    FROM documents)""",
)
def sanitize_text(spark, sf):
    return S.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(text.sanitize(F.col("text"))).alias("text_md5"),
        text.sanitize(F.col("lang"), "int").alias("digits"),
    )


@query(
    "export_label",
    """SELECT page_id, 'meta-analysis-' || regexp_replace(regexp_extract(url,
         '^https?://([^/:?#]*)', 1), '[^a-zA-Z0-9]', '-', 'g') || '-2024-01-31' AS label,
       trim(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.\\-]', '_', 'g'), '_+', '_', 'g'), '_') AS safe_name,
       'Filename contains invalid character: /; Filename contains invalid character: :'
         || CASE WHEN url LIKE '%?%' THEN '; Filename contains invalid character: ?' ELSE '' END AS errors
    FROM pages""",
)
def export_label(spark, sf):
    url = F.col("url")
    return S.pages(spark, sf).select(
        "page_id",
        text.export_label(url, F.lit("2024-01-31")).alias("label"),
        text.safe_filename(url).alias("safe_name"),
        F.array_join(text.filename_errors(url), "; ").alias("errors"),
    )
