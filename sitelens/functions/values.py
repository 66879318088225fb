"""Value rules shared by every operator: emptiness, trimming, number text."""

from pyspark.sql import Column, functions as F

# The characters trimmed from both ends of a text.
TRIM_CHARS = " \t\n\r\x00\x0b"


def is_blank(c: Column) -> Column:
    """NULL, '' and '0' all count as "no value"."""
    return c.isNull() | c.isin("", "0")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARS))


def or_null(c: Column) -> Column:
    """NULL in place of a blank value."""
    return F.when(~is_blank(c), c)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def number_text(c: Column, places: int = 2) -> Column:
    """Rounded half away from zero and printed without trailing zeros."""
    fixed = F.round(c, places).cast(f"decimal(24,{places})").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "") if places else fixed


def truncate(c: Column, length: int = 255, suffix: str = "...") -> Column:
    """The first ``length`` characters, marked with ``suffix`` when something was cut."""
    cut = F.concat(F.substring(c, 1, length), F.lit(suffix))
    return F.when(F.char_length(c) <= length, c).otherwise(cut)


def format_bytes(c: Column, places: int = 2) -> Column:
    """1024 stays ``1024 B``; 1025 becomes ``1 KB``."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = None
    for power, unit in enumerate(units):
        scaled = c.cast("double") / float(1024**power)
        text = F.concat(number_text(scaled, places), F.lit(f" {unit}"))
        if power == len(units) - 1:
            out = out.otherwise(text)
        else:
            fits = scaled <= 1024.0
            out = F.when(fits, text) if out is None else out.when(fits, text)
    return out


def format_duration(ms: Column) -> Column:
    """``999ms``, ``59.99s``, ``1.5m``."""
    ms = ms.cast("double")
    return (
        F.when(ms < 1000, F.concat(number_text(ms, 0), F.lit("ms")))
        .when(ms < 60000, F.concat(number_text(ms / 1000.0), F.lit("s")))
        .otherwise(F.concat(number_text(ms / 60000.0), F.lit("m")))
    )


def countdown_text(seconds: Column) -> Column:
    """``1h 5m``, ``4m 10s`` or ``9s``."""
    hours = F.floor(seconds / 3600).cast("string")
    minutes = F.floor((seconds % 3600) / 60).cast("string")
    rest = (seconds % 60).cast("string")
    return (
        F.when(seconds >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .when(seconds >= 60, F.concat(minutes, F.lit("m "), rest, F.lit("s")))
        .otherwise(F.concat(rest, F.lit("s")))
    )


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, as a BIGINT; the session time zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def seconds_interval(seconds) -> Column:
    """A number (or column) of seconds as an interval."""
    return F.make_dt_interval(secs=seconds if isinstance(seconds, Column) else F.lit(seconds))


def own_key(key: Column, *row: str) -> Column:
    """``key``, or for a row without one a key of its own that nothing matches, so that
    the rows without a key do not all meet in one task of an outer or anti join."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*row).cast("string")))
