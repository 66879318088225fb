"""URLs as columns: normalise, validate, key, resolve."""

from pyspark.sql import Column, functions as F

from .values import is_blank, let, trim

# Fixed values.
ALLOWED_PORTS = (80, 443)
MAX_URL_BYTES = 2048
LOCAL_NAMES = ("localhost", "127.0.0.1", "::1", "0.0.0.0")

_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
HOSTNAME = rf"^(?=.{{1,253}}\.?$){_LABEL}(?:\.{_LABEL})*\.?$"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_PARTS = r"^(?i:(https?))://(?:[^/?#]*@)?([^/?#:]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SEPARATOR = "\x01"


def _with_scheme(url: Column) -> Column:
    def prefixed(u):
        has_scheme = u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://")
        return F.when(has_scheme, u).otherwise(F.concat(F.lit("http://"), u))

    return let(F.regexp_replace(trim(url), r"[\x00-\x1f\x7f]", "_"), prefixed)


def url_parts(url: Column) -> Column:
    """STRUCT(scheme, host, port_text, path, query, fragment, other_scheme, parsed).

    One match splits the URL; control characters are already replaced, so none of
    them can be mistaken for the separator.
    """

    def named(u):
        groups = _SEPARATOR.join(f"${i}" for i in range(1, 7))
        pieces = F.split(F.regexp_replace(u, _PARTS, groups), _SEPARATOR)
        return let(
            F.struct(pieces.alias("p"), u.alias("u")),
            lambda s: F.struct(
                F.lower(F.get(s["p"], 0)).alias("scheme"),
                F.lower(F.get(s["p"], 1)).alias("host"),
                F.get(s["p"], 2).alias("port_text"),
                F.get(s["p"], 3).alias("path"),
                F.get(s["p"], 4).alias("query"),
                F.get(s["p"], 5).alias("fragment"),
                (~s["u"].rlike(r"^(?i:https?)://")).alias("other_scheme"),
                (F.size(s["p"]) == 6).alias("parsed"),
            ),
        )

    return let(_with_scheme(url), named)


def _default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", 443).otherwise(80)


def _port(p: Column) -> Column:
    """Port as a number, the scheme's default when none (or 0) is written."""
    n = F.when(p["port_text"].rlike(r"^[0-9]{1,5}$"), p["port_text"].cast("int"))
    return F.when((p["port_text"] == "") | (n == 0), _default_port(p["scheme"])).otherwise(n)


def parts_error(p: Column) -> Column:
    """Why a parsed URL cannot be normalised; NULL when it can."""
    port = _port(p)
    bad_port = (p["port_text"] != "") & (
        ~p["port_text"].rlike(r"^[0-9]{1,5}$") | (p["port_text"].try_cast("int") > 65535)
    )
    return (
        F.when(p["other_scheme"], "Only HTTP and HTTPS schemes are allowed")
        .when(~p["parsed"] | (p["host"] == "") | F.coalesce(bad_port, F.lit(False)),
              "Invalid URL format")
        .when(p["host"] == "0", "URL must have scheme and host")
        .when(~p["host"].rlike(HOSTNAME), "Invalid hostname")
        .when(
            ~port.isin(*ALLOWED_PORTS),
            F.concat(F.lit("Port "), port.cast("string"), F.lit(" is not allowed")),
        )
    )


def normalize_parts(p: Column) -> Column:
    port = _port(p)
    shown_port = F.when(
        port != _default_port(p["scheme"]), F.concat(F.lit(":"), port.cast("string"))
    ).otherwise("")
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    query = F.when(is_blank(p["query"]), "").otherwise(F.concat(F.lit("?"), p["query"]))
    fragment = F.when(is_blank(p["fragment"]), "").otherwise(F.concat(F.lit("#"), p["fragment"]))
    joined = F.concat(p["scheme"], F.lit("://"), p["host"], shown_port, path, query, fragment)
    return F.when(parts_error(p).isNull(), joined)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, explicit path, no default port; NULL when invalid.

    A URL without a scheme gets ``http://``; any scheme but http(s) is invalid.
    """
    return let(url_parts(url), normalize_parts)


def normalize_error(url: Column) -> Column:
    return let(url_parts(url), parts_error)


def cache_key(url: Column) -> Column:
    """SHA-1 (hex) of the normalised URL."""
    return F.sha1(normalize_url(url).cast("binary"))


def is_cache_key(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-f0-9]{40}$"), F.lit(False))


def domain(url: Column) -> Column:
    """Host as written, '' for a URL without one (relative, mailto:, ...)."""
    pattern = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/]*\]|[^/?#:]*)"
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def errors_of_parts(url: Column, parts: Column) -> Column:
    """All reasons a URL with these ``url_parts`` is refused."""
    too_long = F.when(
        F.octet_length(trim(url)) > MAX_URL_BYTES, "URL is too long (maximum 2048 characters)"
    )

    def reasons(c):
        local = c["host"].isin(*LOCAL_NAMES) | c["host"].rlike(IPV4)
        return F.array_compact(
            F.array(
                too_long,
                F.concat(F.lit("Invalid URL format: "), c["failure"]),
                F.when(
                    c["failure"].isNull() & local, "Localhost and IP addresses are not allowed"
                ),
            )
        )

    checked = F.struct(parts_error(parts).alias("failure"), parts["host"].alias("host"))
    return F.when(is_blank(url), F.array(F.lit("URL is required"))).otherwise(
        let(checked, reasons)
    )


def url_errors(url: Column) -> Column:
    """All reasons a URL is refused; an empty array means it is accepted."""
    return let(url_parts(url), lambda parts: errors_of_parts(url, parts))


def base_parts(base: Column) -> Column:
    """STRUCT(scheme, origin, folder) of a page URL, for ``resolve_with``."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.struct(
        F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)//", 1).alias("scheme"),
        F.regexp_replace(origin, r"//[^/?#]*@", "//").alias("origin"),
        F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/+[^/]*$", "").alias("folder"),
    )


def resolve_with(parts: Column, url: Column) -> Column:
    """Absolute form of ``url`` as found on the page with these ``base_parts``.

    ``..``, ``?x`` and ``#x`` are appended to the base directory like any other
    relative text; a blank ``url`` is returned unchanged.
    """
    return (
        F.when(is_blank(url), url)
        .when(url.rlike(r"^https?://"), url)
        .when(url.startswith("//"), F.concat(parts["scheme"], url))
        .when(url.startswith("/"), F.concat(parts["origin"], url))
        .otherwise(F.concat(parts["origin"], parts["folder"], F.lit("/"), url))
    )


def resolve_url(base: Column, url: Column) -> Column:
    return F.when(is_blank(base), url).otherwise(
        let(base_parts(base), lambda parts: resolve_with(parts, url))
    )
