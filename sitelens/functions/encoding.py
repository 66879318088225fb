"""Charset detection and conversion of fetched bytes."""

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .values import trim

# Windows-1252 characters for bytes 0x80-0x9F that ISO-8859-1 lacks.
_WINDOWS_1252 = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_FROM = "".join(chr(b) for b, c in _WINDOWS_1252.items() if c)
_TO = "".join(c for c in _WINDOWS_1252.values() if c)

# Charsets decoded by built-in functions.
LATIN1 = ("ISO-8859-1", "LATIN1", "US-ASCII", "ASCII")
USUAL = LATIN1 + ("UTF-8", "UTF8", "WINDOWS-1252", "CP1252")


def _parameter(text: Column) -> Column:
    """What is written after the first ``charset=`` of a text; '' when there is none."""
    after = F.get(F.split(text, r"(?i)charset\s*=", 2), 1)
    return F.coalesce(F.regexp_extract(after, r"""^[\s"']*([^\s"'>;/]++)""", 1), F.lit(""))


def detect_charset(content: Column, content_type: Column | None = None) -> Column:
    """Upper-case charset of fetched bytes: from the page's meta tags, else from the
    parameters of the content type, else UTF-8 when the bytes are valid UTF-8, else ISO-8859-1."""
    # Bytes as characters one to one, so that any content can be searched.
    view = F.decode(content, "ISO-8859-1")
    metas = F.regexp_extract_all(view, F.lit(r"(?i)<meta\b[^>]*+"), F.lit(0))
    in_metas = F.filter(F.transform(metas, _parameter), lambda v: v != "")
    header = F.lit("") if content_type is None else F.coalesce(content_type, F.lit(""))
    in_header = _parameter(header)
    guess = F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1")
    return (
        F.when(F.size(in_metas) > 0, F.upper(trim(F.get(in_metas, 0))))
        .when(in_header != "", F.upper(trim(in_header)))
        .otherwise(guess)
    )


# Byte order marks; without one these charsets are big-endian.
_MARKS = {"UTF-16": (b"\xff\xfe", b"\xfe\xff"), "UTF-32": (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff")}


def _decoded(data: bytes, name: str) -> str:
    if name in _MARKS and not data.startswith(_MARKS[name]):
        name += "-BE"
    try:
        text = data.decode(name, "replace")
    except (LookupError, UnicodeError):
        # Not a charset of texts: the bytes are kept one to one.
        return data.decode("iso-8859-1")
    # Halves of pairs that some codecs let through cannot be stored.
    return text.encode("utf-8", "replace").decode("utf-8")


@F.pandas_udf(StringType())
def _decode_other(content: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series(
        [None if d is None or n is None else _decoded(bytes(d), n) for d, n in zip(content, charset)], dtype=object
    )


def to_utf8(content: Column, charset: Column, other_charsets: bool = True) -> Column:
    """Fetched bytes as text.

    Bytes that are wrong in their charset become replacement characters, and content
    of a charset nobody knows is read as ISO-8859-1, so no page is lost.  The usual
    charsets are decoded by built-in functions.  Only the content of pages in another
    charset is sent to Python; with ``other_charsets=False`` none is, and it is read
    as ISO-8859-1.
    """
    as_latin = F.decode(content, "ISO-8859-1")
    text = (
        F.when(charset.isin("UTF-8", "UTF8"), F.make_valid_utf8(content.cast("string")))
        .when(charset.isin(*LATIN1), as_latin)
        .when(charset.isin("WINDOWS-1252", "CP1252"), F.translate(as_latin, _FROM, _TO))
    )
    if not other_charsets:
        return text.otherwise(as_latin)
    rare = ~charset.isin(*USUAL)
    return text.otherwise(_decode_other(F.when(rare, content), F.when(rare, charset)))
