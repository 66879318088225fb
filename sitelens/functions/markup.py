"""HTML as SQL expressions: cleaning, tags, attributes, element text, entities.

Each function takes the SQL text of its input (usually a column name) and returns
SQL text for ``F.expr`` or ``selectExpr``; a page operator combines dozens of them,
and one parsed text is far quicker to set up than thousands of Column calls.

Everything is a built-in regular-expression or higher-order function, so a page
never leaves the JVM and no operator on pages needs a shuffle.  Every loop in a
pattern is possessive or lazy up to a fixed end, so matching is iterative (no stack
growth on long pages), and what is never closed is taken up to the end of the page in
one match, so no part of a page is searched again and again: time is linear in its size.

Inputs named ``column`` are used more than once in the result: pass a column, not
an expression that is costly to repeat.
"""

from html.entities import html5, name2codepoint

from .values import TRIM_CHARS


def q(text: str) -> str:
    """``text`` as an SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trim(x: str) -> str:
    return f"btrim({x}, {q(TRIM_CHARS)})"


def _replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)})"


def _extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def _extract_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


_QUOTED = r""""[^"]*"|'[^']*'"""
_VALUE = rf"""(?:{_QUOTED}|[^\s"'>][^\s>]*)"""
# A quoted run opens as a whole value only, right after ``=``; any other quote is an
# ordinary character of a name or of an unquoted value.
TAG_REST = rf"""[^>=]*+(?:=\s*+(?:{_QUOTED}|(?!["'])[^\s>]*+)[^>=]*+)*+>"""
START_TAG = rf"<[a-zA-Z]{TAG_REST}"

# Blocks whose whole content is left out of the body text.
NON_CONTENT_TAGS = ("script", "style", "nav", "aside", "footer", "header")


def _unless_open(closed: str, head: str) -> str:
    """``closed`` as group 1; where it fails, ``head`` and all that follows, in one match."""
    return rf"(?is)(?=<)(?:({closed})|{head}.*+)"


def _extract_closed(x: str, closed: str, head: str) -> str:
    """All matches of ``closed``; a ``head`` that is never closed takes the rest with it."""
    return f"filter({_extract_all(x, _unless_open(closed, head), 1)}, m -> m <> '')"


def _drop_block(x: str, tag: str) -> str:
    """Remove each block from its opener to the first closer after it; an opener
    without a closer stays, with all that follows."""
    # Without a choice at its start, the pattern passes over other text far quicker.
    return _replace(x, rf"(?s)<(?i:{tag}\b(?:.*?</{tag}>|(?<=(<{tag}))(.*+)))", "$1$2")


def _holds(column: str, tags: tuple) -> str:
    """Whether a text may hold an opener of one of ``tags``: no less than a pattern would find."""
    any_of = " OR ".join(f"contains(l, '<{tag}')" for tag in tags)
    return f"get(transform(array(lower({column})), l -> {any_of}), 0)"


def _cut_where(has: str, cut: str, x: str) -> str:
    """``cut`` of ``x`` (both of ``v``) where it ``has`` something to cut."""
    # A search is much cheaper than a replacement that changes nothing.
    return f"get(transform(array({x}), v -> CASE WHEN {has} THEN {cut} ELSE v END), 0)"


def _drop_blocks(column: str, tags: tuple, comments: bool = False) -> str:
    out = column
    for tag in tags:
        out = _cut_where(_holds("v", (tag,)), _drop_block("v", tag), out)
    if comments:
        cut = _replace("v", r"(?s)<!--(?:.*?-->|(?<=(<!--))(.*+))", "$1$2")
        out = _cut_where("contains(v, '<!--')", cut, out)
    return out


def _one_space(x: str) -> str:
    """Whitespace runs become one space; a lone space is not touched."""
    has_more = " OR ".join(f"contains(v, {q(c)})" for c in ("\n", "  ", "\t", "\r", "\f", "\x0b"))
    return trim(_cut_where(has_more, _replace("v", r"\s(?:\s++|(?<! ))", " "), x))


def clean(column: str) -> str:
    """Without scripts, styles and comments; whitespace runs become one space."""
    return _one_space(_drop_blocks(column, ("script", "style"), comments=True))


_ANY_TAG = r"""[^>"']*+(?:(?:"[^"]*(?:"|\z)|'[^']*(?:'|\z))[^>"']*+)*+(?:>|\z)"""
STRIPPED = rf"(?s)[<\x00](?:(?<=\x00)|!--.*?(?:-->|\z)|(?!\s){_ANY_TAG})"


# Within an element, quotes hold as they do in ``TAG_REST``.
_INNER_TAG = r"""[^>=]*+(?:=\s*+(?:"[^"]*(?:"|\z)|'[^']*(?:'|\z)|(?!["'])[^\s>]*+)[^>=]*+)*+(?:>|\z)"""
_INNER_STRIPPED = STRIPPED.replace(_ANY_TAG, _INNER_TAG)


def strip_tags(x: str) -> str:
    """Tags become nothing (no space); ``<`` before whitespace is text; an unclosed
    tag or comment swallows the rest, as do unclosed quotes inside a tag."""
    return _replace(x, STRIPPED)


def _entity_rows(html5_names: bool) -> str:
    if html5_names:
        table = {n: v for n, v in html5.items() if n.endswith(";")}
    else:
        table = {f"{n};": chr(v) for n, v in name2codepoint.items()} | {"apos;": "'"}
    # A map lookup reads from the front, so the usual names come first.
    usual = ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;"]
    names = usual + [n for n in sorted(table) if n not in usual]
    return "\x02".join(f"&{n}\x01{table[n]}" for n in names)


_ENTITY_TABLE = {
    wide: f"str_to_map({q(_entity_rows(wide))}, '\x02', '\x01')" for wide in (False, True)
}


def _numeric_entity(token: str) -> str:
    hexa = f"nullif({_extract(token, r'^&#[xX]([0-9a-fA-F]{1,6});$')}, '')"
    deci = f"nullif({_extract(token, r'^&#([0-9]{1,7});$')}, '')"
    code = f"coalesce(CAST(conv({hexa}, 16, 10) AS BIGINT), CAST({deci} AS BIGINT))"
    # Code points that may be written as a reference; any other stays as typed.
    allowed = (
        "c BETWEEN 32 AND 126 OR c IN (9, 10, 12) OR (c BETWEEN 160 AND 1114111"
        " AND NOT c BETWEEN 55296 AND 57343 AND NOT c BETWEEN 64976 AND 65007"
        " AND c % 65536 < 65534)"
    )
    char = "decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')"
    return f"get(transform(array({code}), c -> CASE WHEN {allowed} THEN {char} ELSE {token} END), 0)"


def decode_entities(column: str, html5_names: bool = False) -> str:
    """``&name;`` and ``&#n;`` become characters; the ``;`` is required.

    Attribute values and element text know the HTML 4 names; body text
    (``html5_names``) knows all HTML 5 names.  Text without ``&`` is passed through.
    """
    named = f"coalesce(try_element_at({_ENTITY_TABLE[html5_names]}, k), k)"
    token = (
        f"CASE WHEN NOT k RLIKE '^&.+;$' THEN k"
        f" WHEN startswith(k, '&#') THEN {_numeric_entity('k')} ELSE {named} END"
    )
    tokens = _extract_all(column, r"&#?\w++;|[^&]++|&")
    return (
        f"CASE WHEN contains({column}, '&')"
        f" THEN array_join(transform({tokens}, k -> {token}), '') ELSE {column} END"
    )


def decode_all(array: str) -> str:
    """Each text of an array (of arrays, when nested) decoded."""
    return f"transform({array}, d -> {decode_entities('d')})"


def inner_texts(htmls: str) -> str:
    """Text content of each element: tags out, entities decoded, ends trimmed."""
    stripped = f"transform({htmls}, h -> {_replace('h', _INNER_STRIPPED)})"
    return f"transform({stripped}, h -> {trim(decode_entities('h'))})"


def content_html(column: str) -> str:
    """Without navigation and the other non-content blocks, tags stripped."""
    cut = f"CASE WHEN {_holds(column, NON_CONTENT_TAGS)} THEN {_drop_blocks(column, NON_CONTENT_TAGS)} ELSE {column} END"
    return strip_tags(cut)


def readable(column: str) -> str:
    """Body text from ``content_html``: entities decoded, whitespace collapsed."""
    return _one_space(decode_entities(column, html5_names=True))


def count_words(column: str, min_length: int = 3) -> str:
    """Whitespace-separated tokens of at least ``min_length`` characters.

    Blank text (also a lone ``0``) has no words whatever ``min_length`` is.
    """
    # A token that is long enough matches from its start, a shorter one nowhere.
    words = f"regexp_count({column}, {q(rf'\S{{{min_length},}}+')})"
    return f"CASE WHEN {column} IS NULL OR {column} IN ('', '0') THEN 0 ELSE {words} END"


def start_tags(x: str) -> str:
    """All start tags in document order, as written; one that is never closed, also
    by its quotes, ends the page."""
    return _extract_closed(x, START_TAG, "<[a-zA-Z]")


def tag_name(x: str) -> str:
    return f"lower({_extract(x, r'^<([a-zA-Z][^\s/>]*)')})"


def of_tag(tags: str, name: str) -> str:
    """The start tags of one element name."""
    return f"filter({tags}, t -> t RLIKE {q(rf'(?i)^<{name}[\s/>]')})"


def attr_source(x: str, name: str) -> str:
    """The first attribute called ``name`` as written (``name="v"``), '' when absent."""
    other = rf"""(?!{name}[\s=/>])[^\s"'<>/=]++(?:\s*+=\s*+{_VALUE})?+"""
    skip = rf"""(?:[\s/]++|{other}|["'=<])*+"""
    wanted = rf"""({name}(?=[\s=/>])(?:\s*+=\s*+{_VALUE})?+)"""
    return _extract(x, rf"(?is)^<[a-z][^\s/>]*+{skip}{wanted}")


def attr_raw(column: str) -> str:
    """Value of an ``attr_source`` text, not decoded; NULL when absent, '' when it has none."""
    raw = _replace(column, r"""(?s)^[^=]*(?:=\s*(?:"(.*)"|'(.*)'|(.*)))?$""", "$1$2$3")
    return f"CASE WHEN {column} <> '' THEN {raw} END"


def tags_with(tags: str, attrs: list[str]) -> str:
    """``tags`` as structs of the named attributes (dashes become underscores)."""
    # One layer per step, so that each regular expression runs once per attribute.
    # A tag has few of the names, and a search for one is cheaper than reading all before it.
    found = (f"CASE WHEN t RLIKE {q(f'(?i){a}')} THEN {attr_source('t', a)} ELSE '' END" for a in attrs)
    sources = f"transform({tags}, t -> array({', '.join(found)}))"
    raws = f"transform({sources}, s -> transform(s, a -> {attr_raw('a')}))"
    values = f"transform({raws}, s -> {decode_all('s')})"
    named = ", ".join(f"'{a.replace('-', '_')}', get(s, {i})" for i, a in enumerate(attrs))
    return f"transform({values}, s -> named_struct({named}))"


def attr_map(column: str) -> str:
    """All attributes of a start tag as a map, names lower-cased; the first of
    duplicates wins."""
    body = _replace(column, r"^<[a-zA-Z][^\s/>]*|>$")
    found = _extract_all(body, rf"""[^\s"'<>/=]++(?:\s*+=\s*+{_VALUE})?+""")
    names = f"lower({_extract('s', r'^([^\s=]+)')})"
    values = decode_all(f"transform({found}, s -> {attr_raw('s')})")
    pairs = f"arrays_zip(transform({found}, s -> {names}), {values})"
    return (
        f"aggregate({pairs}, CAST(map() AS MAP<STRING, STRING>), (m, p) -> CASE"
        f" WHEN map_contains_key(m, p['0']) THEN m ELSE map_concat(m, map(p['0'], p['1'])) END)"
    )


def _named(names: str) -> str:
    return rf"<{names}(?=[\s/>])"


def elements_source(x: str, tag: str) -> str:
    """Each element ``<tag ...>inner`` as written, up to its closer, the next such
    opener or the end of the page."""
    head = _named(tag)
    return _extract_closed(x, rf"{head}{TAG_REST}.*?(?=</{tag}\s*+>|<{tag}[\s/>]|\z)", head)


def first_element(x: str, tag: str) -> str:
    """Array with the inner HTML of the first ``tag``; [] when the page has none."""
    head = _named(tag)
    found = _extract_closed(x, rf"{head}{TAG_REST}.*?(?=</{tag}\s*+>|\z)", head)
    return after_start_tags(f"slice({found}, 1, 1)")


def headings_source(x: str) -> str:
    """h1 to h3 in order, as written; another heading also ends an open one."""
    head = _named("h[1-3]")
    return _extract_closed(x, rf"{head}{TAG_REST}.*?(?=</h[1-6]\s*+>|<h[1-6][\s/>]|\z)", head)


def scripts_source(x: str) -> str:
    """Start tag of every script outside comments, with its content when it is JSON-LD."""
    # The first character is outside the choice, so other text is passed over quickly.
    head, body = _named("script")[1:], r"[^<]*+(?:<(?!/script)[^<]*+)*+"
    closed = rf"{head}(?:(?=[^>]*+>)(?=[^>]*application/ld){TAG_REST}{body}|{TAG_REST})"
    rest = rf"{body}(?:</script\s*+>|\z)"
    pattern = rf"(?is)<(?:!--.*?(?:-->|\z)|({closed}){rest}|{head}(?!{TAG_REST}).*+)"
    return f"transform(filter({_extract_all(x, pattern, 1)}, s -> s <> ''), s -> concat('<', s))"


def after_start_tags(elements: str) -> str:
    return f"transform({elements}, e -> {_replace('e', f'^{START_TAG}')})"


def start_tags_of(elements: str) -> str:
    return f"transform({elements}, e -> {_extract('e', f'^({START_TAG})')})"
