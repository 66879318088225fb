"""Benchmark decontamination: pigeonhole pieces, then bit-parallel edit distance.

A copy of an item with at most k edits leaves at least one of k + 1 pieces of the
item untouched.  The pieces of a block of items form one string automaton; every
document is run through it once per block, and around each piece hit the edit
distance of the whole item to any stretch of the document is computed with Myers'
bit-parallel recurrence.  No copy within the budget can be missed.
"""

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, filter_texts, ids_and_texts, record_batch, slices

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of items held by one automaton; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000
SCHEMA = "doc_id bigint, item_id bigint, distance int, start bigint, end bigint"


def normalised(text: str) -> str:
    """Lower-cased, every run of white space one space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 stretches of almost equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distances(pattern: str, text: str, start: int = 0, stop: int | None = None):
    """(end, distance) for each end from ``start`` on: the least edit distance of ``pattern`` to a
    stretch of ``text`` that begins at ``start`` or later and ends there."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j in range(start, len(text) if stop is None else min(stop, len(text))):
        eq = masks.get(text[j], 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # A match may begin anywhere, so nothing is carried into the lowest bit.
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(xv | plus) & full, plus & xv
        yield j + 1, score


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a stretch of ``text``, and where that first ends."""
    best, end = len(pattern), 0
    for j, score in distances(pattern, text):
        if score < best:
            best, end = score, j
    return best, end


def spans(pattern: str, budget: int, text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of copies of ``pattern`` in ``text[start:stop]`` that do not overlap, from the left.

    The first end within the budget and the 2 x ``budget`` ends after it belong to one copy; it
    ends at the least distance among them, the first of ties.  The next copy is looked for from
    there, so no text left between copies, or after them, holds another.
    """
    out = []
    while start < stop:
        best = None
        for end, distance in distances(pattern, text, start, stop):
            if best is None and distance <= budget:
                best, last = (distance, end), end + 2 * budget
            elif best is not None:
                best = min(best, (distance, end)) if end <= last else best
            if best is not None and end >= last:
                break
        if best is None:
            break
        distance, end = best
        # Where it begins: the same search from the end backwards.
        stretch = text[max(start, end - len(pattern) - budget) : end]
        _, back = best_match(pattern[::-1], stretch[::-1])
        out.append((distance, end - back, end))
        start = end
    return out


def _windows(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping (start, end) merged."""
    merged: list[list[int]] = []
    for start, end in sorted(hits):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(x) for x in merged]


def build(items: list[tuple[int, str]], error_rate: float):
    """The automaton of all pieces; each piece knows the items and offsets it stands for."""
    where: dict[str, list[tuple[int, int]]] = {}
    known = []
    for item_id, text in items:
        budget = int(len(text) * error_rate)
        for offset, piece in pieces(text, budget):
            where.setdefault(piece, []).append((len(known), offset))
        known.append((item_id, text, budget))
    automaton = ahocorasick.Automaton()
    for piece, places in where.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, known


def matches(text: str, automaton, known) -> list[tuple[int, int, int, int]]:
    """(item_id, distance, start, end) in the normalised text: every copy that does not overlap an earlier one."""
    text = normalised(text)
    around: dict[int, set[tuple[int, int]]] = {}
    for last, (length, places) in automaton.iter(text):
        at = last + 1 - length
        for item, offset in places:
            _, pattern, budget = known[item]
            start = max(0, at - offset - budget)
            around.setdefault(item, set()).add((start, at - offset + len(pattern) + budget))
    out = []
    for item, hits in around.items():
        item_id, pattern, budget = known[item]
        for start, end in _windows(list(hits)):
            out.extend((item_id, *span) for span in spans(pattern, budget, text, start, min(end, len(text))))
    return out


def _blocks(benchmark: DataFrame, block_chars: int):
    """Items (id, normalised text) in blocks of about ``block_chars`` characters; blank ones left out."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-total // block_chars)
    for i in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        block = [(r["item_id"], normalised(r["text"] or "")) for r in mine.collect()]
        if block := [x for x in block if x[1]]:
            yield block


def find_items(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, start, end): items found in documents within their budget.

    A copy of an item of n characters may have ``int(n * error_rate)`` edits; positions
    count characters of the normalised document, and each copy of an item that does not
    overlap an earlier one of the same item is a row (``spans``).  Texts are read whole.  Items that are null or blank match nothing,
    and null texts hold nothing.  Items with equal text and repeated rows give a row
    each.  Other columns are ignored.  The benchmark is read in blocks of about
    ``block_chars`` characters, each of which is sent to all tasks, with a pass over ``docs`` for each.
    """
    docs = ids_and_texts(docs)
    schema = arrow_schema(SCHEMA)

    def search(block: list[tuple[int, str]]):
        def run(batches):
            automaton, known = build(block, error_rate)
            for batch in slices(batches):
                columns = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
                found = [(i, *m) for i, text in zip(*columns) if text for m in matches(text, automaton, known)]
                yield record_batch(found, schema)

        return docs.mapInArrow(run, SCHEMA)

    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in _blocks(benchmark, block_chars):
        out = out.unionByName(search(block))
    return out


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Rows of ``docs``, with all columns, in which ``find_items`` finds nothing."""

    def judge(block):
        def make():
            automaton, known = build(block, error_rate)
            return lambda texts: [not matches(t, automaton, known) for t in texts]

        return make

    for block in _blocks(benchmark, block_chars):
        docs = filter_texts(docs, judge(block))
    return docs
