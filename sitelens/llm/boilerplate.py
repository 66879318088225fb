"""Main text of pages: markup first, then what a host repeats, by its suffix array.

A page is cut into blocks of text.  What it marks itself decides first: blocks in
menus, headers, footers, asides, forms and the like go; an article or main element is
the text of its page.  Pages that mark no such element are decided by their host: the
blocks of all pages of a host are its token streams, and runs of blocks that return on
other pages are boilerplate.

The suffixes of all streams, cut at ``DEPTH`` blocks, are sorted over the cluster by host
and content, equal ones reduced to one with the first and last page that holds them.
Each sorted part is scanned with a stack into common-prefix intervals.  Intervals that
touch the border of a part are open: their pages go to a table of their own, at
most 2 x ``DEPTH`` rows a part, in which they are added up.  A suffix is repeated as far as
its deepest interval with two different pages.  Pages with equal streams count as one, so
copies of a page are not its boilerplate.
"""

import html as references
import re
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import shared_dir
from .common import arrow_schema, record_batch, slices

#: Blocks of a suffix that are compared.
DEPTH = 6
#: A repeated run is boilerplate from this many characters on.
LONG = 20
#: Bytes of a block in a suffix: a digest and the number of characters, up to 65,535.
TOKEN = 10
#: A page that keeps less than this share of its characters is a copy: its prose stays.
LEAST_SHARE = 0.2
PROSE_WORDS = 10

# Element and class names of HTML pages.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea iframe noembed noframes noscript svg math object canvas audio video title xmp".split())
CHROME = set("aside button datalist dialog footer form head header menu nav search select".split())
CHROME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promotion promotions recommended related replies reply respond share sharing sidebar sidebars "
    "signup social sponsor sponsored submenu subscribe subscription toolbar widget widgets".split()
)
COMMENT_WORDS = {"comment", "comments", "reply", "replies"}
MAIN_WORDS = {"articlebody", "article-body", "article-content", "entry-content", "post-content", "post-body"}
#: An open element of these is closed by the next one of its kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: A tag or comment.  Quotes count after an equals sign only, and end at the next "<".
MARKUP = re.compile(r"""<(?:!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"<]*+"|=\s*+'[^'<]*+'|[^>])*+)(?:>|\Z))""")
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_MARKED, _CHROME, _OPEN = 1, 2, 0

#: A page's stream; ``page`` is a digest of it, ``open`` whether a block waits for its host.
STREAMS = "page_key binary, host bigint, page bigint, open boolean, tokens binary"
SUFFIXES = "host bigint, suffix binary, page bigint"
ASKED = "page_key binary, host bigint, suffix binary, at int"
SCANNED = "host bigint, suffix binary, depth int, low bigint, high bigint"


@dataclass
class Block:
    text: str
    #: Marked as main, as chrome, or neither.
    state: int
    linked: int


class Element:
    __slots__ = ("name", "chrome", "main", "header")

    def __init__(self, name: str, chrome: bool, main: int, header: bool):
        #: ``main``: 2 in an article, 1 in another main element; ``header``: only headings count.
        self.name, self.chrome, self.main, self.header = name, chrome, main, header


def _element(name: str, attributes: str, above: Element) -> Element:
    given: dict[str, str] = {}
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            given.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    role, named = given.get("role", ""), (given.get("class", "") + " " + given.get("id", "")).split()
    words = {w for n in named for w in re.split(r"[^a-z0-9]+", n)}
    main = above.main
    if not above.chrome:
        if name == "article" or role == "article" or given.get("itemprop") == "articlebody" or MAIN_WORDS & set(named):
            main = 2
        elif name == "main" or role == "main":
            main = max(main, 1)
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    header = above.header
    if name in ("html", "body", "main"):
        chrome = False
    elif name == "article":
        chrome = bool(words & COMMENT_WORDS)
    elif above.main and (name == "header" or "header" in words):
        chrome, header = bool(words & (CHROME_WORDS - {"header"})), True
    else:
        chrome = name in CHROME or role in CHROME_ROLES or bool(words & CHROME_WORDS)
    return Element(name, above.chrome or chrome or hidden, main, header)


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order, with what the markup says of each."""
    found: list[tuple[str, bool, int, int]] = []
    root = Element("", False, 0, False)
    stack, parts, linked, links = [root], [], 0, 0

    def state() -> Element:
        return stack[-1]

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = state()
            heading = any(e.name in HEADINGS for e in stack)
            found.append((text, top.chrome or (top.header and not heading), top.main, linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = references.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    def close(down_to: int) -> None:
        flush()
        del stack[down_to:]

    at, n = 0, len(html)
    while at < n:
        m = MARKUP.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name in RAW:
            flush() if name == "title" else None
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(html, at)
            if not m[0].endswith("/>") or name not in ("svg", "math"):
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            if stack[-1].name == "p" or any(e.name == "p" for e in stack[-8:]):
                k = max(i for i, e in enumerate(stack) if e.name == "p")
                if all(e.name not in BLOCKS or e.name == "p" for e in stack[k:]):
                    close(k)
            if name in SIBLINGS and stack[-1].name in SIBLINGS[name]:
                close(len(stack) - 1)
            flush()
            if name not in VOID:
                stack.append(_element(name, m[3], state()))
        elif name not in VOID and not m[0].endswith("/>"):
            if name == "a":
                links += 1
            element = _element(name, m[3], state())
            if element.chrome != state().chrome or element.main != state().main:
                flush()
                stack.append(element)
    flush()
    best = max((main for _, chrome, main, _ in found if not chrome), default=0)
    return [
        Block(text, _CHROME if chrome else _OPEN if not best else _MARKED if main == best else _CHROME, link)
        for text, chrome, main, link in found
    ]


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    name = m[1].lower() if m else ""
    return name.removeprefix("www.")


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def stream(found: list[Block]) -> list[bytes]:
    """Tokens of all blocks, those of articles and menus too."""
    return [blake2b(b.text.encode(), digest_size=TOKEN - 2).digest() + min(len(b.text), 65535).to_bytes(2, "big") for b in found]


def _streams(pages: DataFrame) -> DataFrame:
    schema = _schema(STREAMS)

    def run(batches):
        for batch in slices(batches, "html"):
            out = []
            for key, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_key", "url", "html"))):
                found = blocks(html or "")
                tokens = b"".join(stream(found))
                page = int.from_bytes(blake2b(tokens, digest_size=8).digest(), "little", signed=True)
                out.append((key, _number(host_of(url)), page, any(b.state == _OPEN for b in found), tokens))
            yield record_batch(out, schema)

    return pages.select("page_key", "url", "html").mapInArrow(run, STREAMS)


def _suffixes(tokens: bytes) -> list[bytes]:
    return [tokens[i : i + DEPTH * TOKEN] for i in range(0, len(tokens), TOKEN)]


def _every_suffix(streams: DataFrame) -> DataFrame:
    schema = _schema(SUFFIXES)

    def run(batches):
        for batch in slices(batches, "tokens", 1 << 18):
            columns = (batch.column(c).to_pylist() for c in ("host", "page", "tokens"))
            yield record_batch([(host, s, page) for host, page, tokens in zip(*columns) for s in _suffixes(tokens)], schema)

    return streams.select("host", "page", "tokens").mapInArrow(run, SUFFIXES)


def _asked(streams: DataFrame) -> DataFrame:
    """The suffixes of pages with open blocks; equal pages ask once."""
    schema = _schema(ASKED)

    def run(batches):
        for batch in slices(batches, "tokens", 1 << 18):
            columns = (batch.column(c).to_pylist() for c in ("page_key", "host", "tokens"))
            yield record_batch([(k, h, s, at) for k, h, tokens in zip(*columns) for at, s in enumerate(_suffixes(tokens))], schema)

    pages = streams.filter("open").select("page_key", "host", "tokens").dropDuplicates(["page_key"])
    return pages.mapInArrow(run, ASKED)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, pa.int32() if k == "int" else pa.bool_() if k == "boolean" else arrow_schema(f"{n} {k}").field(n).type) for n, k in (f.split() for f in ddl.split(", "))])


class SuffixScan:
    """Sorted distinct suffixes of one part to rows of ``SCANNED``: a suffix with the depth to
    which it is repeated inside the part (``low`` null), or the pages of an open interval."""

    def __init__(self):
        self.out: list[tuple] = []
        #: Open intervals: [depth, prefix, low, high, touches the start, suffixes not repeated so far].
        self.stack: list[list] = []
        self.host, self.last, self.first_row = None, b"", True

    def add(self, host: int, suffix: bytes, low: int, high: int) -> None:
        common = 0
        if host == self.host:
            while common < DEPTH and self.last[common * TOKEN : (common + 1) * TOKEN] == suffix[common * TOKEN : (common + 1) * TOKEN] != b"":
                common += 1
        self._pop(common, False)
        for d in range(common + 1, len(suffix) // TOKEN + 1):
            self.stack.append([d, suffix[: d * TOKEN], low, high, self.first_row, []])
        for interval in self.stack[:common]:
            interval[2], interval[3] = min(interval[2], low), max(interval[3], high)
        self.stack[-1][5].append(suffix)
        self.host, self.last, self.first_row = host, suffix, False

    def _pop(self, depth: int, end: bool) -> None:
        while self.stack and self.stack[-1][0] > depth:
            d, prefix, low, high, start, waiting = self.stack.pop()
            if start or end:
                self.out.append((self.host, prefix, d, low, high))
            if low != high:
                self.out += [(self.host, s, d, None, None) for s in waiting]
            elif self.stack:
                self.stack[-1][5].extend(waiting)
            else:
                # Perhaps repeated in another part.
                self.out += [(self.host, s, 0, None, None) for s in waiting] if start or end else []

    def close(self) -> None:
        self._pop(0, True)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def repeated_suffixes(suffixes: DataFrame, folder: str) -> DataFrame:
    """(host, suffix, depth): the blocks from a suffix's start that return on another page."""
    spark = suffixes.sparkSession
    distinct = suffixes.groupBy("host", "suffix").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    schema = _schema(SCANNED)

    def scan(batches):
        found = SuffixScan()
        for batch in slices(batches, "suffix"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("host", "suffix", "low", "high"))):
                found.add(*row)
            yield record_batch(found.taken(), schema)
        found.close()
        yield record_batch(found.taken(), schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(parts, "host", "suffix").sortWithinPartitions("host", "suffix")
    ranged.mapInArrow(scan, SCANNED).write.parquet(f"{folder}/scanned")
    scanned = spark.read.schema(SCANNED).parquet(f"{folder}/scanned")
    borders = scanned.filter("low IS NOT NULL").groupBy("host", "suffix").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # At most 2 x DEPTH intervals for each part.
    crossing = {(r.host, bytes(r.suffix)) for r in borders.filter("low <> high").select("host", "suffix").collect()}

    def settle(batches):
        out_schema = _schema("host bigint, suffix binary, depth int")
        for batch in slices(batches, "suffix"):
            out = []
            for host, suffix, depth in zip(*(batch.column(c).to_pylist() for c in ("host", "suffix", "depth"))):
                for d in range(len(suffix) // TOKEN, depth, -1):
                    if (host, suffix[: d * TOKEN]) in crossing:
                        depth = d
                        break
                if depth:
                    out.append((host, suffix, depth))
            yield record_batch(out, out_schema)

    return scanned.filter("low IS NULL").select("host", "suffix", "depth").mapInArrow(settle, "host bigint, suffix binary, depth int")


def main_text(found: list[Block], spans: list[int] | None) -> str:
    """Text of a page from its blocks and the covered places of its stream (``place * 64 + depth``)."""
    if all(b.state != _OPEN for b in found):
        return "\n".join(b.text for b in found if b.state == _MARKED)
    covered = [False] * len(found)
    for at, depth in (divmod(s, 64) for s in spans or []):
        if sum(len(b.text) for b in found[at : at + depth]) >= LONG:
            covered[at : at + depth] = [True] * len(found[at : at + depth])
    unmarked = [(b, c) for b, c in zip(found, covered) if b.state == _OPEN]
    kept = sum(len(b.text) for b, c in unmarked if not c)
    copy = kept < LEAST_SHARE * sum(len(b.text) for b, _ in unmarked)

    def prose(b: Block) -> bool:
        return 2 * b.linked < len(b.text) and len(b.text.split()) >= PROSE_WORDS

    return "\n".join(b.text for b, c in unmarked if not c or (copy and prose(b)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    The text is made of the page's blocks, white space in each turned into one space,
    joined by line feeds: those in its article (else main) element, without menus, forms,
    comments and the like inside; on a page with neither, those outside such parts that
    its host does not repeat.  Of a page whose blocks are nearly all repeated, a copy,
    prose stays.  A null or empty page gives ''; a null url is a host of its own; null ids
    are kept; equal rows give equal results and count as one page; other columns are
    ignored; an empty table gives an empty result.  Elements that are never closed are
    closed with those around them; the work is linear in the page, whatever its length.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "boilerplate")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.col("url").cast("string")
    key = F.unhex(F.md5(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), html)))
    rows = pages.select(F.col("page_id"), url.alias("url"), html.alias("html")).withColumn("page_key", key)
    _streams(rows).write.parquet(f"{folder}/streams")
    streams = spark.read.schema(STREAMS).parquet(f"{folder}/streams")
    asked = _asked(streams)
    repeated_suffixes(_every_suffix(streams), folder).write.parquet(f"{folder}/repeated")
    repeated = spark.read.schema("host bigint, suffix binary, depth int").parquet(f"{folder}/repeated")
    spans = asked.join(repeated, ["host", "suffix"]).groupBy("page_key").agg(F.collect_list((F.col("at") * 64 + F.col("depth")).cast("bigint")).alias("spans"))
    spans.write.parquet(f"{folder}/spans")
    # Read again: its size is known, so pages are not shuffled where few of them ask.
    spans = spark.read.schema("page_key binary, spans array<bigint>").parquet(f"{folder}/spans")
    joined = rows.join(spans, "page_key", "left").select("page_id", "url", "html", "spans")
    kind = dict(joined.dtypes)["page_id"]

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(blocks(h), s) for h, s in zip(batch.column("html").to_pylist(), batch.column("spans").to_pylist())]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
