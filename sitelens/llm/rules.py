"""Line-first quality rules: drop bad lines, then documents that lose too much.

Each line is judged alone by rules on punctuation, navigation and boilerplate.  Lines
that fail are removed, and a document is rejected when less than ``MIN_SHARE`` of
the characters of its words is left, or when the base rules on the whole text fail.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, UPPER, arrow_schema, ids_and_texts, slices

MIN_WORDS = 50
MAX_REPEATED = 50
MIN_SHARE = 0.5

SYMBOLS = re.compile(r"[#*$%&|<>]")
SYMBOL_WORD = re.compile(r"[^\x20\x09-\x0D]*[#*$%&<>][^\x20\x09-\x0D]*")
SEPARATOR = re.compile(r"[|»›•·]")
SHOUTED = re.compile(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)")
#: Phrases of page furniture, lower-cased.
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "sign in to", "subscribe to our", "click here",
)
#: Navigation lines are lists of labels: this share of the words is followed by a separator.
NAVIGATION_SHARE = 0.25
SYMBOL_SHARE = 0.3
CAPITAL_SHARE = 0.6
MIN_LETTERS = 20
CAPITALS = UPPER.encode()
SMALL = CAPITALS.lower()


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def line_rule(line: str) -> str | None:
    """The first rule that ``line`` breaks: punctuation, navigation, boilerplate or None.

    Lines without a word break none.  Capitals are counted among the letters A-Z.
    """
    data = line.encode()
    capitals = _count(data, CAPITALS)
    if capitals + (small := _count(data, SMALL)) >= MIN_LETTERS and capitals > CAPITAL_SHARE * (capitals + small):
        return "punctuation"
    if SYMBOLS.search(line) or "!" in line or "?" in line:
        words = data.split()
        if len(SYMBOL_WORD.findall(line)) > SYMBOL_SHARE * len(words):
            return "punctuation"
        if len(words) > 3 and len(SHOUTED.findall(line)) > SYMBOL_SHARE * len(words):
            return "punctuation"
    separators = len(SEPARATOR.findall(line))
    if separators >= 2:
        words = data.split()
        if separators > NAVIGATION_SHARE * (len(words) - words.count(b"|")):
            return "navigation"
    lowered = line.lower()
    if any(phrase in lowered for phrase in BOILERPLATE):
        return "boilerplate"
    return None


def word_chars(text: str) -> int:
    """Characters that are not ASCII white space."""
    return len(text) - sum(map(text.count, SPACE))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def judge(text: str) -> tuple:
    """The figures and verdicts of one text, and what the line rules leave of it."""
    words = text.encode().split()
    n_words, n_chars = len(words), word_chars(text)
    seen, n_dup = set(), 0
    kept, kept_chars = [], 0
    removed = Counter()
    for line in text.split("\n"):
        if line.strip(SPACE):
            n_dup += line in seen
            seen.add(line)
        rule = line_rule(line)
        if rule:
            removed[rule] += 1
        else:
            kept.append(line)
            kept_chars += word_chars(line)
    n_repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * n_words
    verdict = not failed and kept_chars >= MIN_SHARE * n_chars
    return (
        n_words, n_chars, len(SYMBOLS.findall(text)), n_dup, n_repeat, failed, verdict,
        removed["punctuation"], removed["navigation"], removed["boilerplate"], "\n".join(kept),
    )


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_punctuation bigint, "
    "n_navigation bigint, n_boilerplate bigint, text string"
)


def clean_lines(docs: DataFrame) -> DataFrame:
    """Figures, verdicts, lines removed by each rule and the cleaned ``text`` of every row.

    A null or empty text has no words: it fails the base rules and is not kept.  Null
    ids and repeated rows give a result each; other columns are ignored.  Whole texts
    are read, one document at a time.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches):
        for batch in slices(batches):
            columns = list(zip(*(judge(t or "") for t in batch.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])],
                schema=schema,
            )

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)
