"""Page metadata: one crawled page in, its tags, texts and counts out.

Input is any DataFrame with ``page_id``, ``url`` (the final URL, base of relative
links) and ``html``.  ``parse`` is a chain of projections; every extractor below is
a projection on top of it, so Catalyst prunes whatever a query does not use, and
nothing here shuffles: the unit of work is one page.
"""

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import markup
from ..functions.jsonld import jsonld_types, microdata_type
from ..functions.urls import base_parts, domain, resolve_with
from ..functions.values import (
    format_bytes,
    format_duration,
    is_blank,
    or_null,
    own_key,
    trim,
)
from .joins import join_unique

# Field names of the analysis record and the tag names behind them.
META_FIELDS = {
    "description": "description",
    "keywords": "keywords",
    "robots": "robots",
    "viewport": "viewport",
    "author": "author",
    "generator": "generator",
    "theme_color": "theme-color",
    "charset": "charset",
}
OPEN_GRAPH_FIELDS = {
    "title": "og:title",
    "description": "og:description",
    "type": "og:type",
    "url": "og:url",
    "image": "og:image",
    "image_alt": "og:image:alt",
    "site_name": "og:site_name",
    "locale": "og:locale",
}
TWITTER_FIELDS = {
    "card": "twitter:card",
    "title": "twitter:title",
    "description": "twitter:description",
    "image": "twitter:image",
    "image_alt": "twitter:image:alt",
    "site": "twitter:site",
    "creator": "twitter:creator",
}
ICON_RELS = ("icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed")
ICON_FALLBACKS = ("/favicon.ico", "/favicon.png")
HEADINGS_PER_LEVEL = 3
LARGE_PAGE_BYTES = 100_000
COMPLEX_PAGE_ELEMENTS = 1_500
SLOW_FETCH_MS = 3_000

_USED_TAGS = r"(?i)^<(?:meta|link|img)[\s/>]|\sitemtype\s*="
_ITEM_TYPE = r"(?i)\sitemtype\s*="
_META_ATTRS = ["name", "property", "http-equiv", "charset", "content"]


def parse(pages: DataFrame) -> DataFrame:
    """Each page with its parsed parts.

    base, clean, n_elements, tags, title, headings (level, text), anchors (href, text),
    metas, link_tags, image_tags, item_types, ld_json, n_script_src, text.
    """
    cleaned = pages.selectExpr(
        "*",
        f"{markup.clean('html')} AS clean",
        # From the raw page: cleaning removes scripts.
        f"{markup.scripts_source('html')} AS scripts",
    )
    tokens = cleaned.selectExpr(
        "*",
        f"{markup.start_tags('clean')} AS tags",
        f"{markup.first_element('clean', 'title')} AS title_html",
        f"{markup.headings_source('clean')} AS heading_html",
        f"{markup.elements_source('clean', 'a')} AS anchor_html",
        f"{markup.content_html('clean')} AS stripped",
        f"{markup.tags_with(markup.start_tags_of('scripts'), ['type', 'src'])} AS script_tags",
    )
    used = tokens.selectExpr(
        "*", f"filter(tags, t -> t RLIKE {markup.q(_USED_TAGS)}) AS used_tags"
    )
    base = base_parts(F.col("url"))
    item_tags = f"filter(used_tags, t -> t RLIKE {markup.q(_ITEM_TYPE)})"
    ld_sources = (
        "transform(filter(arrays_zip(scripts, script_tags),"
        " z -> z.script_tags.type = 'application/ld+json'), z -> z.scripts)"
    )
    return used.select(
        *pages.columns,
        base.alias("base"),
        "clean",
        "tags",
        F.expr("size(tags) AS n_elements"),
        F.expr(f"get({markup.inner_texts('title_html')}, 0) AS title"),
        F.expr(
            "transform(arrays_zip(heading_html, "
            f"{markup.inner_texts(markup.after_start_tags('heading_html'))}),"
            " z -> named_struct('level', lower(substring(z.heading_html, 2, 2)),"
            " 'text', z['1'])) AS headings"
        ),
        F.expr(
            "transform(arrays_zip("
            f"{markup.tags_with(markup.start_tags_of('anchor_html'), ['href'])},"
            f" {markup.inner_texts(markup.after_start_tags('anchor_html'))}),"
            " z -> named_struct('href', z['0'].href, 'text', z['1'])) AS anchors"
        ),
        F.expr(f"{markup.tags_with(markup.of_tag('used_tags', 'meta'), _META_ATTRS)} AS metas"),
        F.expr(
            f"{markup.tags_with(markup.of_tag('used_tags', 'link'), ['rel', 'href', 'hreflang'])}"
            " AS link_tags"
        ),
        F.expr(
            f"{markup.tags_with(markup.of_tag('used_tags', 'img'), ['src', 'alt', 'title'])}"
            " AS image_tags"
        ),
        F.expr(f"{markup.tags_with(item_tags, ['itemtype'])}.itemtype AS item_types"),
        F.expr(
            f"transform({markup.after_start_tags(ld_sources)}, j -> {markup.trim('j')}) AS ld_json"
        ),
        F.expr("size(filter(script_tags, t -> t.src IS NOT NULL)) AS n_script_src"),
        F.expr(f"{markup.readable('stripped')} AS text"),
    )


# -- extractors: Columns over ``parse`` output, built once and reused --------------


@cache
def named_metas() -> Column:
    """(name, content) of each meta tag; a tag without either is left out."""
    key = "coalesce(m.name, m.property, m.http_equiv)"
    named = (
        f"transform(metas, m -> CASE WHEN {key} IS NULL"
        " THEN named_struct('name', 'charset', 'content', m.charset)"
        f" ELSE named_struct('name', lower({key}), 'content', m.content) END)"
    )
    return F.expr(f"filter({named}, m -> m.name NOT IN ('', '0') AND m.content NOT IN ('', '0'))")


def prefixed_metas(attr: str, prefix: str) -> Column:
    """(name, content) of tags whose ``attr`` starts with ``prefix``, content trimmed
    first and left out when blank."""
    trimmed = (
        f"transform(filter(metas, m -> startswith(m.{attr}, '{prefix}')),"
        f" m -> named_struct('name', m.{attr}, 'content', {markup.trim('m.content')}))"
    )
    return F.expr(f"filter({trimmed}, m -> m.content NOT IN ('', '0'))")


def _content(entries: str, name: str, last: bool = True) -> Column:
    """Content of the last (or first) entry called ``name``; NULL when there is none."""
    names, contents = f"{entries}.name", f"{entries}.content"
    if last:
        names, contents = f"reverse({names})", f"reverse({contents})"
    return F.expr(f"get({contents}, CAST(array_position({names}, '{name}') AS INT) - 1)")


@cache
def meta_struct() -> Column:
    """Title and the eight meta fields; the last tag of a name wins."""
    fields = [trim(_content("named_metas", tag)).alias(f) for f, tag in META_FIELDS.items()]
    return F.struct(F.col("title").alias("title"), *fields)


def _social(entries: str, fields: dict) -> Column:
    cols = []
    for field, tag in fields.items():
        if field == "image":
            value = resolve_with(F.col("base"), _content(entries, tag, last=False))
        else:
            value = _content(entries, tag)
        cols.append(value.alias(field))
    return F.struct(*cols)


@cache
def open_graph_struct() -> Column:
    """Last tag of a property wins, but the first image."""
    return _social("og_metas", OPEN_GRAPH_FIELDS)


@cache
def twitter_struct() -> Column:
    return _social("twitter_metas", TWITTER_FIELDS)


@cache
def headings_struct(per_level: int = HEADINGS_PER_LEVEL) -> Column:
    """First ``per_level`` non-blank texts of each level."""

    def level(name):
        texts = F.transform(
            F.filter("headings", lambda h: (h["level"] == name) & ~is_blank(h["text"])),
            lambda h: h["text"],
        )
        return F.slice(texts, 1, per_level).alias(name)

    return F.struct(level("h1"), level("h2"), level("h3"))


@cache
def hreflang_array() -> Column:
    kept = F.filter(
        "link_tags",
        lambda t: F.coalesce(t["rel"] == "alternate", F.lit(False))
        & ~is_blank(t["hreflang"])
        & ~is_blank(t["href"]),
    )
    return F.transform(
        kept,
        lambda t: F.struct(
            t["hreflang"].alias("lang"), resolve_with(F.col("base"), t["href"]).alias("url")
        ),
    )


@cache
def canonical_url() -> Column:
    """From the first canonical link only; NULL when that one has no address."""
    first = F.get(F.filter("link_tags", lambda t: t["rel"] == "canonical"), 0)
    return resolve_with(F.col("base"), or_null(first["href"]))


@cache
def icon_candidates() -> Column:
    """Addresses to try for the icon, in order: declared ones by kind, then position;
    the usual locations are tried right after the first declared one."""

    def of_kind(rel):
        kept = F.filter(
            "link_tags",
            lambda t: F.coalesce(t["rel"] == rel, F.lit(False)) & ~is_blank(t["href"]),
        )
        return F.transform(kept, lambda t: resolve_with(F.col("base"), t["href"]))

    usual = F.array(*[resolve_with(F.col("base"), F.lit(p)) for p in ICON_FALLBACKS])
    declared = F.concat(*[of_kind(rel) for rel in ICON_RELS])
    return F.array_distinct(
        F.concat(
            F.slice(declared, 1, 1),
            usual,
            F.when(
                F.size(declared) > 1,
                F.slice(declared, F.lit(2), F.greatest(F.size(declared) - 1, F.lit(1))),
            ).otherwise(F.array().cast("array<string>")),
        )
    )


@cache
def schema_types() -> Column:
    """JSON-LD types, then microdata types, each name once."""
    ld = F.flatten(F.transform("ld_json", jsonld_types))
    micro = F.filter(F.transform("item_types", microdata_type), lambda t: t.isNotNull())
    return F.array_distinct(F.concat(ld, micro))


@cache
def links_array() -> Column:
    kept = F.filter("anchors", lambda a: ~is_blank(a["href"]))
    own = domain(F.col("url"))

    def link(a):
        host = domain(a["href"])
        return F.struct(
            resolve_with(F.col("base"), a["href"]).alias("url"),
            a["text"].alias("text"),
            (~is_blank(host) & (host != own)).alias("is_external"),
        )

    return F.transform(kept, link)


@cache
def images_array() -> Column:
    kept = F.filter("image_tags", lambda t: ~is_blank(t["src"]))
    return F.transform(
        kept,
        lambda t: F.struct(
            resolve_with(F.col("base"), t["src"]).alias("src"),
            F.coalesce(t["alt"], F.lit("")).alias("alt"),
            F.coalesce(t["title"], F.lit("")).alias("title"),
        ),
    )


@cache
def word_count() -> Column:
    return F.expr(markup.count_words("text"))


@cache
def insights_struct(fetch_time_ms: str | None = None) -> Column:
    """Size, element and resource counts with advice."""
    size = F.octet_length("clean").cast("long")
    stylesheets = F.size(F.filter("link_tags", lambda t: t["rel"] == "stylesheet"))
    images = F.size(F.filter("image_tags", lambda t: t["src"].isNotNull()))
    scripts = F.col("n_script_src")

    def advice(c, limit, above, otherwise):
        return F.when(c > limit, above).otherwise(otherwise).alias("recommendation")

    parts = [
        F.struct(
            size.alias("bytes"),
            format_bytes(size).alias("formatted"),
            advice(size, LARGE_PAGE_BYTES, "Consider reducing HTML size", "HTML size is acceptable"),
        ).alias("html_size"),
        F.struct(
            F.col("n_elements").alias("count"),
            advice(
                F.col("n_elements"),
                COMPLEX_PAGE_ELEMENTS,
                "Consider reducing DOM complexity",
                "DOM complexity is acceptable",
            ),
        ).alias("dom_elements"),
        F.struct(
            scripts.alias("scripts"),
            stylesheets.alias("stylesheets"),
            images.alias("images"),
            (scripts + stylesheets + images).alias("total"),
        ).alias("external_resources"),
    ]
    if fetch_time_ms:
        ms = F.col(fetch_time_ms)
        parts.append(
            F.when(
                ms.isNotNull(),
                F.struct(
                    ms.alias("milliseconds"),
                    format_duration(ms).alias("formatted"),
                    advice(ms, SLOW_FETCH_MS, "Slow response time", "Good response time"),
                ),
            ).alias("fetch_time")
        )
    return F.struct(*parts)


# -- operators -----------------------------------------------------------------


def elements(pages: DataFrame) -> DataFrame:
    """One row per start tag in document order: page_id, pos, tag, attrs (map)."""
    tags = pages.selectExpr("page_id", f"{markup.clean('html')} AS clean")
    rows = tags.selectExpr("page_id", f"posexplode({markup.start_tags('clean')}) AS (pos, source)")
    return rows.selectExpr(
        "page_id",
        "pos",
        f"{markup.tag_name('source')} AS tag",
        f"{markup.attr_map('source')} AS attrs",
    )


def with_metas(parsed: DataFrame) -> DataFrame:
    """Adds the (name, content) lists the meta and social structs read."""
    return parsed.select(
        "*",
        named_metas().alias("named_metas"),
        prefixed_metas("property", "og:").alias("og_metas"),
        prefixed_metas("name", "twitter:").alias("twitter_metas"),
    )


# The options a caller may pass, and what each one leaves out.
OPTIONS = (
    "include_raw_html",
    "include_word_count",
    "include_schema",
    "include_hreflang",
    "include_headings",
)


def option_errors(options: dict) -> list[str]:
    errors = []
    for name, value in options.items():
        if name not in OPTIONS:
            errors.append(f"Unknown analysis option: {name}")
        if not isinstance(value, bool):
            errors.append(f"Analysis option {name} must be a boolean value")
    return errors


def analyze(pages: DataFrame, *, favicon: bool = True, **options: bool) -> DataFrame:
    """The analysis record of each page: page_id, url and one nested ``analysis``.

    Options switch parts off (``include_headings=False``, ...), or add the page
    itself (``include_raw_html=True``).  The icon is the first candidate; use
    ``reachable_icons`` to choose by crawl status.
    """
    errors = option_errors(options)
    if errors:
        raise ValueError("; ".join(errors))

    def wanted(name):
        return options.get(f"include_{name}", True)

    empty_texts = F.array().cast("array<string>")
    no_headings = F.struct(*[empty_texts.alias(h) for h in ("h1", "h2", "h3")])
    parts = with_metas(parse(pages))
    record = F.struct(
        meta_struct().alias("meta"),
        open_graph_struct().alias("open_graph"),
        twitter_struct().alias("twitter_card"),
        (headings_struct() if wanted("headings") else no_headings).alias("headings"),
        (
            hreflang_array()
            if wanted("hreflang")
            else F.array().cast("array<struct<lang:string,url:string>>")
        ).alias("hreflang"),
        canonical_url().alias("canonical"),
        (F.get(icon_candidates(), 0) if favicon else F.lit(None).cast("string")).alias("favicon"),
        (schema_types() if wanted("schema") else empty_texts).alias("schema_org"),
        (word_count() if wanted("word_count") else F.lit(0)).alias("word_count"),
        F.struct(
            F.octet_length("clean").cast("long").alias("html_size_bytes"),
            F.col("n_elements").alias("dom_elements_count"),
        ).alias("analysis_meta"),
    )
    kept = [c for c in pages.columns if c != "html"]
    out = [F.col(c) for c in kept] + [record.alias("analysis")]
    if options.get("include_raw_html", False):
        out.append(F.col("clean").alias("raw_html"))
    return parts.select(*out)


def reachable_icons(pages: DataFrame, statuses: DataFrame) -> DataFrame:
    """The first icon candidate that a crawl status table (url, http_code) knows to
    answer with 200-399; NULL when none does.

    Status rows are reduced to one per address.  A site-wide icon can be a hot join
    key; the status side is unique, so adaptive execution may split it freely.
    """
    candidates = with_metas(parse(pages)).select(
        "page_id", F.posexplode(icon_candidates()).alias("priority", "icon")
    )
    ok = (
        statuses.filter(F.col("http_code").between(200, 399))
        .select(F.col("url").alias("icon"))
        .distinct()
    )
    found = join_unique(candidates, ok, "icon", "left_semi")
    best = found.groupBy("page_id").agg(F.min_by("icon", "priority").alias("favicon"))
    return pages.select("page_id").join(best, "page_id", "left")


def image_checks(images: DataFrame, statuses: DataFrame) -> DataFrame:
    """``images`` (page_id, image) with ``valid``: the address answers with 200-399
    and an ``image/`` content type."""
    good = (
        statuses.filter(
            F.col("http_code").between(200, 399) & F.col("content_type").startswith("image/")
        )
        .select(F.col("url").alias("image"), F.lit(True).alias("found"))
        .distinct()
    )
    keyed = images.withColumn("_key", own_key(F.col("image"), "page_id"))
    joined = join_unique(keyed, good.withColumnRenamed("image", "_key"), "_key", "left")
    return joined.select("page_id", "image", F.coalesce("found", F.lit(False)).alias("valid"))
