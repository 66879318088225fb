"""Queries on pages: cleaning, tags, metadata, links, counts, verdicts."""

from pyspark.sql import functions as F

from ..functions import markup
from ..functions.encoding import detect_charset
from ..functions.urls import resolve_url
from ..functions.values import format_duration
from ..operators import pages as P
from ..operators import verdicts as V
from ..sources import crawl
from . import standin as S

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# -- SQL shared by the checks --------------------------------------------------

CLEAN = """
cleaned AS (
  SELECT page_id, url, html,
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '<script\\b.*?</script>', '', 'gis'), '<style\\b.*?</style>', '', 'gis'),
           '<!--.*?-->', '', 'gs'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS clean
  FROM pages)"""
TAG_RE = """<[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
DECODE = (
    "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'),"
    " '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
)


def hundredths(h):
    """Text of a number given in hundredths, without trailing zeros."""
    return (
        f"regexp_replace(({h}) // 100 || '.' || lpad(CAST(({h}) % 100 AS VARCHAR), 2, '0'),"
        " '\\.?0+$', '')"
    )


def duration(ms):
    return (
        f"CASE WHEN {ms} < 1000 THEN ({ms}) || 'ms'"
        f" WHEN {ms} < 60000 THEN {hundredths(f'(({ms}) + 5) // 10')} || 's'"
        f" ELSE {hundredths(f'(({ms}) + 300) // 600')} || 'm' END"
    )

TEXT = """
texts AS (
  SELECT page_id, trim(regexp_replace(""" + DECODE.format(
    """regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(clean,
             '<nav\\b.*?</nav>', '', 'gis'), '<aside\\b.*?</aside>', '', 'gis'),
             '<footer\\b.*?</footer>', '', 'gis'), '<header\\b.*?</header>', '', 'gis'),
           '<[^ ](?:[^>"'']|"[^"]*"|''[^'']*'')*(?:>|$)', '', 'g')"""
) + """, ' +', ' ', 'g')) AS text
  FROM cleaned)"""
WORDS = "len(list_filter(regexp_split_to_array(text, ' +'), lambda x: length(x) >= 3))"
TITLE = "trim(" + DECODE.format("regexp_extract(clean, '<title>([^<]*)', 1)") + ")"
H1 = "trim(" + DECODE.format("regexp_extract(clean, '<h1>([^<]*)', 1)") + ")"
N_TAGS = f"len(regexp_extract_all(clean, '{TAG_RE}'))"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
HTML = f"(SELECT p_partkey AS page_id, {S.PART_URL} AS url, {S.PART_HTML} AS html, * FROM part)"


def parsed(spark, sf):
    return P.parse(S.pages(spark, sf))


def part_parsed(spark, sf):
    return P.with_metas(P.parse(S.part_pages(spark, sf)))


# -- cleaning and tags ----------------------------------------------------------


@query(
    "clean_html",
    f"WITH {CLEAN} SELECT page_id, md5(clean) AS clean_md5,"
    " CAST(strlen(clean) AS BIGINT) AS clean_bytes FROM cleaned",
)
def clean_html(spark, sf):
    cleaned = S.pages(spark, sf).select("page_id", F.expr(markup.clean("html")).alias("clean"))
    return cleaned.select(
        "page_id",
        F.md5("clean").alias("clean_md5"),
        F.octet_length("clean").cast("long").alias("clean_bytes"),
    )


@query(
    "html_elements",
    f"""WITH {CLEAN}, t AS (
      SELECT unnest(regexp_extract_all(clean, '{TAG_RE}')) AS tag FROM cleaned)
    SELECT lower(regexp_extract(tag, '^<([a-zA-Z][^ />]*)', 1)) AS tag, count(*) AS n,
           CAST(sum(len(regexp_extract_all(
             regexp_replace(tag, '^<[a-zA-Z][^ />]*|>$', '', 'g'),
             '[^ "''<>/=]+( *= *("[^"]*"|''[^'']*''|[^ "''>][^ >]*))?'))) AS BIGINT) AS n_attrs
    FROM t GROUP BY 1""",
)
def html_elements(spark, sf):
    return (
        P.elements(S.pages(spark, sf))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("attrs").cast("long")).alias("n_attrs"))
    )


@query(
    "element_count",
    f"WITH {CLEAN} SELECT page_id, CAST({N_TAGS} AS BIGINT) AS n_elements FROM cleaned",
)
def element_count(spark, sf):
    return parsed(spark, sf).select("page_id", F.col("n_elements").cast("long").alias("n_elements"))


@query(
    "page_text",
    f"WITH {CLEAN}, {TEXT} SELECT page_id, md5(text) AS text_md5,"
    " CAST(length(text) AS BIGINT) AS n_chars FROM texts",
)
def page_text(spark, sf):
    return parsed(spark, sf).select(
        "page_id",
        F.md5("text").alias("text_md5"),
        F.char_length("text").cast("long").alias("n_chars"),
    )


@query("page_title", f"WITH {CLEAN} SELECT page_id, {TITLE} AS title FROM cleaned")
def page_title(spark, sf):
    return parsed(spark, sf).select("page_id", "title")


@query(
    "word_count",
    f"WITH {CLEAN}, {TEXT} SELECT page_id, CAST({WORDS} AS BIGINT) AS word_count FROM texts",
)
def word_count(spark, sf):
    return parsed(spark, sf).select("page_id", P.word_count().cast("long").alias("word_count"))


# -- metadata (pages built from part columns) -----------------------------------


@query(
    "meta_tags",
    """SELECT p_partkey AS page_id, p_name || ' & more' AS title,
       CASE WHEN p_partkey % 2 = 1 THEN 'second > ' || p_brand
            ELSE p_name || ' ' || p_type END AS description,
       CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS keywords,
       'noindex' AS robots, CAST(NULL AS VARCHAR) AS viewport, '' AS author,
       CAST(NULL AS VARCHAR) AS generator, 'light' AS theme_color, 'utf-8' AS charset
    FROM part""",
)
def meta_tags(spark, sf):
    found = part_parsed(spark, sf).select("page_id", P.meta_struct().alias("m"))
    return found.select("page_id", "m.*")


@query(
    "open_graph",
    """SELECT p_partkey AS page_id, p_name || ' <b>' AS title, CAST(NULL AS VARCHAR) AS description,
       'product' AS type, CAST(NULL AS VARCHAR) AS url,
       'https://shop' || (p_partkey % 7) || '.example.com/img/' || p_partkey || '.png' AS image,
       CAST(NULL AS VARCHAR) AS image_alt, CAST(NULL AS VARCHAR) AS site_name, p_brand AS locale
    FROM part""",
)
def open_graph(spark, sf):
    found = part_parsed(spark, sf).select("page_id", P.open_graph_struct().alias("m"))
    return found.select("page_id", "m.*")


@query(
    "twitter_card",
    """SELECT p_partkey AS page_id, 'summary' AS card, CAST(NULL AS VARCHAR) AS title,
       CAST(NULL AS VARCHAR) AS description,
       'https://shop' || (p_partkey % 7) || '.example.com/parts/pic-' || p_partkey || '.jpg' AS image,
       CAST(NULL AS VARCHAR) AS image_alt, CAST(NULL AS VARCHAR) AS site,
       CAST(NULL AS VARCHAR) AS creator
    FROM part""",
)
def twitter_card(spark, sf):
    found = part_parsed(spark, sf).select("page_id", P.twitter_struct().alias("m"))
    return found.select("page_id", "m.*")


@query(
    "headings",
    f"""WITH {CLEAN}
    SELECT 'page' AS kind, page_id, {H1} AS h1, '' AS h2, '' AS h3 FROM cleaned
    UNION ALL
    SELECT 'part', p_partkey, p_name,
           array_to_string(list_transform(range(0, least(p_size % 5, 2) + 1),
             lambda i: 'Part ' || i || ' ' || p_type), '|'), p_brand
    FROM part""",
)
def headings(spark, sf):
    def flat(kind, df):
        h = df.select("page_id", P.headings_struct().alias("h"))
        return h.select(
            F.lit(kind).alias("kind"), "page_id",
            *[F.array_join(f"h.{level}", "|").alias(level) for level in ("h1", "h2", "h3")],
        )

    return flat("page", parsed(spark, sf)).unionByName(flat("part", part_parsed(spark, sf)))


@query(
    "hreflang",
    """SELECT p_partkey AS page_id, CAST(1 AS BIGINT) AS position, 'en' AS lang,
         'https://shop' || (p_partkey % 7) || '.example.com/en/' || p_partkey AS url FROM part
    UNION ALL
    SELECT p_partkey, 2, 'de',
         'https://shop' || (p_partkey % 7) || '.example.com/parts/de/' || p_partkey FROM part""",
)
def hreflang(spark, sf):
    rows = part_parsed(spark, sf).select(
        "page_id", F.posexplode(P.hreflang_array()).alias("position", "h")
    )
    return rows.select(
        "page_id", (F.col("position") + 1).cast("long").alias("position"), "h.lang", "h.url"
    )


@query(
    "canonical",
    """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 11 <> 0 THEN
       'https://shop' || (p_partkey % 7) || '.example.com/parts/' || p_partkey END AS canonical
    FROM part""",
)
def canonical(spark, sf):
    return part_parsed(spark, sf).select("page_id", P.canonical_url().alias("canonical"))


ICONS = """
icons AS (
  SELECT p_partkey AS page_id, 1 AS n,
         'https://shop' || (p_partkey % 7) || '.example.com/icon-' || (p_partkey % 10) || '.ico' AS url
  FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 2, 'https://shop' || (p_partkey % 7) || '.example.com/favicon.ico' FROM part
  UNION ALL SELECT p_partkey, 3, 'https://shop' || (p_partkey % 7) || '.example.com/favicon.png' FROM part
  UNION ALL SELECT p_partkey, 4, 'https://shop' || (p_partkey % 7) || '.example.com/touch.png'
  FROM part WHERE p_partkey % 3 = 0)"""

# Crawl status of addresses, derived from orders: one row per order, so addresses
# repeat, some with different answers.
STATUS = """
    CASE WHEN o_orderkey % 3 = 0
         THEN concat('https://shop', o_custkey % 7, '.example.com/icon-', o_custkey % 10, '.ico')
         WHEN o_orderkey % 3 = 1
         THEN concat('https://shop', o_custkey % 7, '.example.com/img/', o_custkey, '.png')
         ELSE concat('https://shop', o_custkey % 3, '.example.com/favicon.ico') END AS url,
    CASE WHEN o_custkey % 4 = 0 THEN 404 WHEN o_custkey % 4 = 1 THEN 301 ELSE 200 END AS http_code,
    CASE WHEN o_orderstatus = 'F' THEN 'text/html' ELSE 'image/png' END AS content_type"""


def statuses(spark, sf):
    return S.select(S.table(spark, sf, "orders"), STATUS)


@query(
    "favicon",
    f"""WITH {ICONS}, ok AS (SELECT DISTINCT url FROM (SELECT {STATUS} FROM orders)
                             WHERE http_code BETWEEN 200 AND 399)
    SELECT p.p_partkey AS page_id, f.url AS favicon FROM part p LEFT JOIN (
      SELECT page_id, arg_min(url, n) AS url FROM icons JOIN ok USING (url) GROUP BY page_id) f
    ON f.page_id = p.p_partkey""",
)
def favicon(spark, sf):
    return P.reachable_icons(S.part_pages(spark, sf), statuses(spark, sf))


@query(
    "og_image_valid",
    f"""WITH good AS (SELECT DISTINCT url FROM (SELECT {STATUS} FROM orders)
                      WHERE http_code BETWEEN 200 AND 399 AND content_type LIKE 'image/%')
    SELECT p_partkey AS page_id, image, good.url IS NOT NULL AS valid FROM (
      SELECT p_partkey, 'https://shop' || (p_partkey % 7) || '.example.com/img/' || p_partkey
             || '.png' AS image FROM part) LEFT JOIN good ON good.url = image""",
)
def og_image_valid(spark, sf):
    images = part_parsed(spark, sf).select(
        "page_id", P.open_graph_struct()["image"].alias("image")
    )
    return P.image_checks(images, statuses(spark, sf))


LD_TYPES = "CASE WHEN p_partkey % 13 <> 0 THEN p_type || '|Brand|Thing|Offer' ELSE '' END"


@query("jsonld_types", f"SELECT p_partkey AS page_id, {LD_TYPES} AS types FROM part")
def jsonld_types(spark, sf):
    types = F.flatten(F.transform("ld_json", P.jsonld_types))
    return part_parsed(spark, sf).select("page_id", F.array_join(types, "|").alias("types"))


@query(
    "schema_types",
    """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 13 <> 0
       THEN p_type || '|Brand|Thing|Offer|Product' ELSE 'Product|Thing' END AS types FROM part""",
)
def schema_types(spark, sf):
    return part_parsed(spark, sf).select(
        "page_id", F.array_join(P.schema_types(), "|").alias("types")
    )


# -- links, images, insights -------------------------------------------------------

ANCHOR = '<a href="([^"]*)">([^<]*)'


@query(
    "page_links",
    f"""WITH {CLEAN}, a AS (
      SELECT page_id, url, unnest(list_zip(
        regexp_extract_all(clean, '{ANCHOR}', 1), regexp_extract_all(clean, '{ANCHOR}', 2),
        range(1, len(regexp_extract_all(clean, '{ANCHOR}')) + 1))) AS z FROM cleaned)
    SELECT page_id, CAST(z[3] AS BIGINT) AS position, {ORIGIN} || z[1] AS url,
           trim({DECODE.format("z[2]")}) AS text, false AS is_external
    FROM a WHERE z[1] <> ''
    UNION ALL SELECT p_partkey, 1, 'https://shop' || (p_partkey % 7) || '.example.com/cart',
           'Cart now', false FROM part
    UNION ALL SELECT p_partkey, 2, 'http://other.example.org/', 'Out', true FROM part""",
)
def page_links(spark, sf):
    def rows(df):
        listed = df.select("page_id", F.posexplode(P.links_array()).alias("position", "l"))
        return listed.select(
            "page_id", (F.col("position") + 1).cast("long").alias("position"), "l.*"
        )

    return rows(parsed(spark, sf)).unionByName(rows(part_parsed(spark, sf)))


@query(
    "page_images",
    """SELECT p_partkey AS page_id, 'https://shop' || (p_partkey % 7) || '.example.com/i/'
       || p_partkey || '.png' AS src, p_brand AS alt, '' AS title FROM part""",
)
def page_images(spark, sf):
    return part_parsed(spark, sf).select("page_id", F.inline(P.images_array()))


KB = hundredths("(bytes * 100 + 512) // 1024")


@query(
    "performance_insights",
    f"""WITH {CLEAN}, c AS (
      SELECT 'page' AS kind, page_id, strlen(clean) AS bytes, {N_TAGS} AS n, 0 AS scripts,
             0 AS stylesheets, 0 AS images FROM cleaned
      UNION ALL
      SELECT 'part', p_partkey, strlen(clean), {N_TAGS}, 1, 1, 3 FROM (
        SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace({S.PART_HTML},
          '<script\\b.*?</script>', '', 'gis'), '<!--.*?-->', '', 'gs'), ' +', ' ', 'g') AS clean
        FROM part))
    SELECT kind, page_id, CAST(bytes AS BIGINT) AS bytes,
           CASE WHEN bytes > 1024 THEN {KB} || ' KB' ELSE CAST(bytes AS VARCHAR) || ' B' END AS formatted,
           'HTML size is acceptable' AS size_advice, CAST(n AS BIGINT) AS n_elements,
           'DOM complexity is acceptable' AS element_advice,
           CAST(scripts AS BIGINT) AS scripts, CAST(stylesheets AS BIGINT) AS stylesheets,
           CAST(images - (CASE WHEN kind = 'part' THEN 1 ELSE 0 END) AS BIGINT) AS images,
           CAST(page_id * 37 % 70000 AS BIGINT) AS fetch_time_ms,
           {duration("page_id * 37 % 70000")} AS fetch_time,
           CASE WHEN page_id * 37 % 70000 > 3000 THEN 'Slow response time'
                ELSE 'Good response time' END AS fetch_advice
    FROM c""",
)
def performance_insights(spark, sf):
    def rows(kind, df):
        timed = df.withColumn("fetch_time_ms", F.col("page_id") * 37 % 70000)
        found = timed.select("page_id", P.insights_struct("fetch_time_ms").alias("i"))
        resources = F.col("i.external_resources")
        return found.select(
            F.lit(kind).alias("kind"), "page_id",
            F.col("i.html_size.bytes").alias("bytes"),
            F.col("i.html_size.formatted").alias("formatted"),
            F.col("i.html_size.recommendation").alias("size_advice"),
            F.col("i.dom_elements.count").cast("long").alias("n_elements"),
            F.col("i.dom_elements.recommendation").alias("element_advice"),
            *[resources[r].cast("long").alias(r) for r in ("scripts", "stylesheets", "images")],
            F.col("i.fetch_time.milliseconds").alias("fetch_time_ms"),
            F.col("i.fetch_time.formatted").alias("fetch_time"),
            F.col("i.fetch_time.recommendation").alias("fetch_advice"),
        )

    return rows("page", parsed(spark, sf)).unionByName(rows("part", part_parsed(spark, sf)))


@query(
    "resolve_links",
    f"""WITH r AS (SELECT page_id, url, {ORIGIN} AS origin,
        regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/*[^/]*/*$', '') AS folder,
        unnest(['https://a.example.org/x', '//cdn.example.com/y', '/root', 'file.html', '#top',
                '?q=1', '../up', 'mailto:a@b', '', '0']) AS rel FROM pages)
    SELECT page_id, rel, CASE WHEN rel IN ('', '0') THEN rel WHEN rel LIKE 'https://%' THEN rel
           WHEN rel LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || rel
           WHEN rel LIKE '/%' THEN origin || rel
           ELSE origin || folder || '/' || rel END AS resolved FROM r""",
)
def resolve_links(spark, sf):
    rels = ["https://a.example.org/x", "//cdn.example.com/y", "/root", "file.html", "#top",
            "?q=1", "../up", "mailto:a@b", "", "0"]
    pairs = S.pages(spark, sf).select(
        "page_id", "url", F.explode(F.array(*[F.lit(r) for r in rels])).alias("rel")
    )
    return pairs.select("page_id", "rel", resolve_url(F.col("url"), F.col("rel")).alias("resolved"))


# -- verdicts ---------------------------------------------------------------------


@query(
    "seo_verdict",
    f"""WITH {CLEAN} SELECT kind, page_id,
      CASE WHEN title NOT IN ('', '0') THEN CASE WHEN strlen(title) > 60 THEN 'long'
           WHEN strlen(title) < 30 THEN 'short' ELSE 'good' END END AS title_verdict,
      CASE WHEN d IS NOT NULL THEN CASE WHEN strlen(d) > 160 THEN 'long'
           WHEN strlen(d) < 120 THEN 'short' ELSE 'good' END END AS description_verdict
    FROM (SELECT 'page' AS kind, page_id, {TITLE} AS title, NULL AS d FROM cleaned
          UNION ALL SELECT 'part', p_partkey, p_name || ' & more',
            CASE WHEN p_partkey % 2 = 1 THEN 'second > ' || p_brand ELSE p_name || ' ' || p_type END
          FROM part)""",
)
def seo_verdict(spark, sf):
    def rows(kind, df):
        m = df.select("page_id", P.meta_struct().alias("m"))
        return m.select(
            F.lit(kind).alias("kind"), "page_id",
            V.title_verdict(F.col("m.title")).alias("title_verdict"),
            V.description_verdict(F.col("m.description")).alias("description_verdict"),
        )

    pages = P.with_metas(parsed(spark, sf))
    return rows("page", pages).unionByName(rows("part", part_parsed(spark, sf)))


@query(
    "metadata_coverage",
    f"""SELECT regexp_extract(url, '^https?://([^/:?#]*)', 1) AS host, count(*) AS pages,
       CAST(sum(social) AS BIGINT) AS with_open_graph, CAST(sum(social) AS BIGINT) AS with_twitter,
       CAST(sum(social) AS BIGINT) AS with_schema, CAST(sum(social) AS BIGINT) AS with_hreflang
    FROM (SELECT url, 0 AS social FROM pages UNION ALL SELECT {S.PART_URL}, 1 FROM part) GROUP BY 1""",
)
def metadata_coverage(spark, sf):
    both = S.pages(spark, sf).unionByName(S.part_pages(spark, sf))
    return V.coverage(P.analyze(both))


# -- whole record -----------------------------------------------------------------


@query(
    "page_analysis",
    f"""WITH {CLEAN}, {TEXT}
    SELECT c.page_id, url, {TITLE} AS title, 'utf-8' AS charset, {H1} AS h1,
           CAST(NULL AS VARCHAR) AS canonical, {ORIGIN} || '/favicon.ico' AS favicon,
           CAST(0 AS BIGINT) AS n_schema_types, CAST({WORDS} AS BIGINT) AS word_count,
           CAST(strlen(clean) AS BIGINT) AS html_size_bytes,
           CAST({N_TAGS} AS BIGINT) AS dom_elements_count
    FROM cleaned c JOIN texts USING (page_id)""",
)
def page_analysis(spark, sf):
    a = F.col("analysis")
    return P.analyze(S.pages(spark, sf)).select(
        "page_id", "url",
        a["meta"]["title"].alias("title"),
        a["meta"]["charset"].alias("charset"),
        F.array_join(a["headings"]["h1"], "|").alias("h1"),
        a["canonical"].alias("canonical"),
        a["favicon"].alias("favicon"),
        F.size(a["schema_org"]).cast("long").alias("n_schema_types"),
        a["word_count"].cast("long").alias("word_count"),
        a["analysis_meta"]["html_size_bytes"].alias("html_size_bytes"),
        a["analysis_meta"]["dom_elements_count"].cast("long").alias("dom_elements_count"),
    )


# -- arriving pages -------------------------------------------------------------

GATE = """
    CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 1 THEN 301 ELSE 200 END AS http_code,
    CASE WHEN page_id % 7 = 0 THEN 'Application/PDF; x=1' WHEN page_id % 7 = 1 THEN ''
         WHEN page_id % 7 = 2 THEN NULL ELSE ' Text/HTML ; charset=utf-8' END AS content_type"""


@query(
    "fetch_gate",
    f"""SELECT page_id, CASE
      WHEN http_code = 404 THEN 'HTTP status 404 indicates the page could not be retrieved successfully'
      WHEN content_type LIKE 'App%' THEN 'Content type ''application/pdf'' is not supported for analysis'
      WHEN strlen(html) > 4000 THEN 'Content too large (' || strlen(html) || ' bytes). Maximum allowed: 4000 bytes'
      END AS reason FROM (SELECT page_id, html, {GATE} FROM pages)""",
)
def fetch_gate(spark, sf):
    fetched = S.select(S.pages(spark, sf), f"page_id, html, {GATE}")
    return crawl.gate(fetched, "html", max_bytes=4000).select("page_id", "reason")


# Bytes as a crawler would store them: with or without a charset in the page, some
# of the latter in ISO-8859-1.
BARE = "replace(html, '<meta charset=\"utf-8\">', '')"
CHARSET_KIND = "page_id % 4"


def fetched_bytes(spark, sf):
    bare = F.expr(BARE)
    kind = F.expr(CHARSET_KIND)
    return S.pages(spark, sf).select(
        "page_id",
        F.when(kind == 0, F.encode("html", "UTF-8"))
        .when(kind == 1, F.encode(bare, "UTF-8"))
        .when(kind == 2, F.encode(bare, "ISO-8859-1"))
        .otherwise(F.encode(bare, "UTF-16"))
        .alias("content"),
        F.when(kind == 3, "text/html; charset=utf-16")
        .when(kind == 0, "text/html; charset=iso-8859-1")
        .alias("content_type"),
    )


@query(
    "detect_encoding",
    f"""SELECT page_id, CASE WHEN {CHARSET_KIND} = 3 THEN 'UTF-16'
        WHEN {CHARSET_KIND} < 2 THEN 'UTF-8'
        WHEN strlen(html) > length(html) THEN 'ISO-8859-1' ELSE 'UTF-8' END AS charset FROM pages""",
)
def detect_encoding(spark, sf):
    return fetched_bytes(spark, sf).select(
        "page_id", detect_charset(F.col("content"), F.col("content_type")).alias("charset")
    )


@query(
    "decode_pages",
    f"""SELECT page_id, md5(CASE WHEN {CHARSET_KIND} = 0 THEN html ELSE {BARE} END) AS html_md5
    FROM pages""",
)
def decode_pages(spark, sf):
    decoded = crawl.decode_pages(fetched_bytes(spark, sf))
    return decoded.select("page_id", F.md5("html").alias("html_md5"))


@query(
    "history_durations",
    f"""SELECT event_id AS id, {duration("ms")} AS duration
    FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS ms FROM events)""",
)
def history_durations(spark, sf):
    return S.history(spark, sf).select(
        "id", format_duration(F.col("analysis_time_ms")).alias("duration")
    )
