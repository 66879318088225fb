"""Test tables in the shapes the operators expect.

The expressions are plain SQL understood by both Spark and the checking database,
so both sides start from the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.cache import with_expiry
from ..sources.crawl import spread

DAY_TTL = 86_400

REQUESTS = """
    event_id AS id,
    concat('10.', user_id % 4, '.', user_id % 256, '.', event_id % 4) AS ip_address,
    concat('http://site', user_id % 20, '.example.com/', event_type) AS url,
    event_type AS user_agent,
    ts AS created_at"""

CLIENT_REQUESTS = """
    event_id AS id,
    concat('', user_id) AS ip_address,
    concat('http://site', user_id % 20, '.example.com/', event_type) AS url,
    event_type AS user_agent,
    ts AS created_at"""

ENTRY_URL = "concat('http://site', user_id % 20, '.example.com/', event_type, '/', user_id)"

ENTRIES = f"""
    event_id AS id,
    {ENTRY_URL} AS url,
    sha1({ENTRY_URL}) AS cache_key,
    ts AS created_at,
    21600 AS ttl_seconds"""

LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'"
    " WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END"
)
MESSAGE = (
    "CASE event_type WHEN 'error' THEN concat('SSRF attempt blocked ', user_id)"
    " WHEN 'purchase' THEN 'Rate limit exceeded' ELSE concat('request ', event_type) END"
)
LOGS = f"""
    event_id AS id,
    {LEVEL} AS level,
    {MESSAGE} AS message,
    CASE WHEN event_type = 'view' THEN NULL ELSE props END AS context,
    ts AS created_at"""

HISTORY = """
    event_id AS id,
    concat('', user_id) AS ip_address,
    concat('http://site', user_id % 20, '.example.com/', event_type) AS url,
    event_type = 'view' AS cache_hit,
    CAST(floor(value * 100) AS BIGINT) AS analysis_time_ms,
    ts AS created_at"""

# Pages with every kind of metadata, built from columns so that the expected value
# of a field is the column it was built from.
PART_URL = (
    "concat('https://shop', p_partkey % 7, '.example.com/parts/', p_partkey)"
)


def _when(condition, text, otherwise="''"):
    return f"CASE WHEN {condition} THEN {text} ELSE {otherwise} END"


PART_HTML = "concat(" + ", ".join(
    [
        """'<!DOCTYPE html><html><head><meta charset="utf-8"><title> '""",
        "p_name",
        """' &amp; more</title><!-- <title>no</title> --><meta name="description" content="'""",
        "p_name", "' '", "p_type",
        """'">'""",
        _when(
            "p_partkey % 2 = 1",
            """concat('<META NAME="Description" CONTENT="second > ', p_brand, '">')""",
        ),
        """'<meta name="keywords" content="'""",
        _when("p_partkey % 5 = 0", "'0'", "p_brand"),
        """'"><meta name=robots content=noindex><meta name="author" content="  ">'""",
        """'<meta content="light" name="theme-color"><meta name="" property="viewport" content="x">'""",
        """'<meta property="og:title" content=" '""",
        "p_name",
        """' &lt;b&gt; "><meta property="OG:type" content="no">'""",
        """'<meta property="og:image" content="/img/'""",
        "p_partkey",
        """'.png"><meta property="og:image" content="https://cdn.example.com/x.png">'""",
        """'<meta property="og:type" content="product"><meta property="og:type" content="">'""",
        """'<meta property="og:locale" content="en"><meta property="og:locale" content="'""",
        "p_brand",
        """'"><meta name="twitter:card" content=summary><meta name="twitter:image" content="pic-'""",
        "p_partkey",
        """'.jpg"><meta name="twitter:image" content="/late.jpg">'""",
        """'<link rel="canonical" href="'""",
        _when(
            "p_partkey % 11 = 0", "''",
            _when("p_partkey % 2 = 0", "concat('/parts/', p_partkey)", PART_URL),
        ),
        """'"><link rel="canonical" href="/second">'""",
        """'<link rel="alternate" hreflang="en" href="/en/'""",
        "p_partkey",
        """'"><link href="de/'""",
        "p_partkey",
        """'" hreflang="de" rel="alternate"><link rel="alternate" hreflang="" href="/none">'""",
        _when(
            "p_partkey % 3 = 0",
            """concat('<link rel="apple-touch-icon" href="/touch.png">',"""
            """ '<link rel="icon" href="/icon-', p_partkey % 10, '.ico">')""",
        ),
        """'<link rel="stylesheet" href="/a.css"><script src="/app.js"></script>'""",
        """'<script type="application/ld+json">'""",
        _when(
            "p_partkey % 13 = 0", """'{"@type": "Broken",}'""",
            """concat('{"name": "@type", "x": {"@type": ["Brand", "Thing"]},"""
            """ "list": ["@type", {"@type": "Offer"}], "@type": "', p_type, '"}')""",
        ),
        """'</script></head><body><nav>menu words here</nav><h1>'""",
        "p_name",
        "'</h1>'",
        *[
            _when(f"p_size % 5 >= {i}", f"concat('<h2 class=\"a>b\">Part <i>{i}</i> ', p_type, '</h2>')")
            for i in range(5)
        ],
        "'<h3> </h3><h3>0</h3><h3><b>'", "p_brand",
        "'</b></h3><p>'", "p_type",
        "' &eacute;t&#233; a < b of parts</p><aside>not counted words</aside><img src=\"/i/'",
        "p_partkey",
        """'.png" alt="'""",
        "p_brand",
        """'"><img alt="no source"><img src="" alt="empty">'""",
        """'<a href="/cart">Cart <b>now</b></a><a href="http://other.example.org/">Out</a><a>none</a>'""",
        """'<div itemscope itemtype="https://schema.org/Product"></div>'""",
        """'<div itemtype="https://schema.org/Thing/"></div><div itemtype="urn:x"></div></body></html>'""",
    ]
) + ")"


PART_PAGES = f"""
    p_partkey AS page_id,
    {PART_URL} AS url,
    {PART_HTML} AS html"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(df: DataFrame, columns: str) -> DataFrame:
    """SELECT list as text, one expression per line, in a DataFrame."""
    text = columns.replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"SELECT {text} FROM {{rows}}", rows=df)


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def now(df: DataFrame, column: str = "ts") -> Column:
    """The latest time in a table, as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


def requests(spark, sf_dir):
    return select(events(spark, sf_dir), REQUESTS)


def client_requests(spark, sf_dir):
    return select(events(spark, sf_dir), CLIENT_REQUESTS)


def entries(spark, sf_dir):
    return with_expiry(select(events(spark, sf_dir), ENTRIES))


def logs(spark, sf_dir):
    return select(events(spark, sf_dir), LOGS)


def history(spark, sf_dir):
    return select(events(spark, sf_dir), HISTORY)


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


def part_pages(spark, sf_dir):
    return select(
        spread(table(spark, sf_dir, "part")),
        PART_PAGES,
    )
