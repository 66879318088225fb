"""Input sanitising, file names and log lines as columns."""

from pyspark.sql import Column, functions as F

from .markup import STRIPPED
from .urls import domain
from .values import is_blank, trim

# Device names and characters a file name may not use.
RESERVED_NAMES = (
    ["CON", "PRN", "AUX", "NUL"]
    + [f"COM{i}" for i in range(1, 10)]
    + [f"LPT{i}" for i in range(1, 10)]
)
FORBIDDEN_CHARS = ["/", "\\", ":", "*", "?", '"', "<", ">", "|"]


def escape_html(c: Column) -> Column:
    # Escaped characters; & first, so that no entity is escaped twice.
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")
    ):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, STRIPPED, "")


def sanitize(c: Column, kind: str = "string") -> Column:
    """Keep what the kind allows: string (no tags, escaped), int, float, url, email."""
    if kind == "int":
        return F.regexp_replace(c, r"[^0-9+\-]", "")
    if kind == "float":
        return F.regexp_replace(c, r"[^0-9+\-.]", "")
    if kind == "url":
        return F.regexp_replace(trim(c), r"""[^a-zA-Z0-9$\-_.+!*'(),{}|\\^~\[\]`<>#%";/?:@&=]""", "")
    if kind == "email":
        return F.regexp_replace(trim(c), r"[^a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~@.\[\]]", "")
    return escape_html(strip_tags(trim(c)))


def sanitize_all(c: Column, kind: str = "string") -> Column:
    return F.transform(c, lambda x: sanitize(x, kind))


def safe_filename(c: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_\-.]", "_"), "_+", "_")
    name = F.btrim(name, F.lit("_"))
    return F.when(is_blank(name), "unnamed").otherwise(name)


def base_filename(c: Column) -> Column:
    """Last path segment without its extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)/*$", 1), r"\.[^.]*$", "")


def filename_errors(c: Column) -> Column:
    """All reasons a file name is refused; an empty array means it is accepted."""
    checks = [F.when(F.octet_length(c) > 255, "Filename too long (maximum 255 characters)")]
    for char in FORBIDDEN_CHARS:
        checks.append(
            F.when(c.contains(char), F.lit(f"Filename contains invalid character: {char}"))
        )
    base = base_filename(c)
    checks.append(
        F.when(
            F.upper(base).isin(*RESERVED_NAMES),
            F.concat(F.lit("Filename '"), base, F.lit("' is reserved and cannot be used")),
        )
    )
    return F.when(is_blank(c), F.array(F.lit("Filename cannot be empty"))).otherwise(
        F.array_compact(F.array(*checks))
    )


def export_label(url: Column, day: Column) -> Column:
    """``meta-analysis-{host}-{day}``, every other character of the host a dash."""
    host = F.regexp_replace(domain(url), "[^a-zA-Z0-9]", "-")
    return F.concat(F.lit("meta-analysis-"), host, F.lit("-"), day)


_LINE = (
    r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\] ([A-Za-z]+): (.*)$"
)


def log_line(created_at: Column, level: Column, message: Column, context: Column) -> Column:
    """``[time] LEVEL: message {json}``; no context, no braces."""
    shown = F.when(is_blank(context), "").otherwise(F.concat(F.lit(" "), context))
    return F.concat(
        F.lit("["), F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"), F.lit("] "),
        level, F.lit(": "), message, shown,
    )


def parse_log_line(line: Column) -> Column:
    """STRUCT(created_at, level, message, context) of a log line; the context is the
    trailing ``{...}`` when that is valid JSON, else part of the message."""
    rest = F.regexp_extract(line, _LINE, 3)
    tail = F.regexp_extract(rest, r"^(?:.*?) (\{.*\})$", 1)
    is_json = (tail != "") & F.try_parse_json(tail).isNotNull()
    message = F.when(is_json, F.substring(rest, F.lit(1), F.length(rest) - F.length(tail) - 1))
    return F.when(
        line.rlike(_LINE),
        F.struct(
            F.try_to_timestamp(F.regexp_extract(line, _LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias(
                "created_at"
            ),
            F.upper(F.regexp_extract(line, _LINE, 2)).alias("level"),
            message.otherwise(rest).alias("message"),
            F.when(is_json, tail).alias("context"),
        ),
    )
