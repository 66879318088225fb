"""Repeated byte strings across documents, by sparse enhanced suffix arrays.

All pairs of equal strings of at least ``MIN_BYTES`` bytes are found without sorting
every suffix.  Of each window of ``MIN_BYTES`` bytes the leftmost smallest hash of its
``GRAM``-byte strings is the anchor; equal windows have equal anchors at the same
place.  Consecutive windows with one anchor form a cell.  Only cells whose anchor
occurs twice go on; they meet by anchor, in buckets.

In a bucket, the suffixes that start at the anchors are sorted, their common prefixes
are scanned with a stack into the tree of common-prefix intervals, and in every
interval the texts to the left are scanned in the same way.  Each pair of a prefix
interval and a left interval inside it that adds up to ``MIN_BYTES`` is a maximal
repeat (its members differ on both sides, as far as their cells reach), with all its occurrences.

Equal cells are reduced to one while rows stream by, so a bucket holds different texts
around one anchor only.  Anchors that occur more than ``MAX_BUCKET`` times are not
collected in one task: their cells are taken apart into single windows, which meet by
a 128-bit digest, first inside each batch, and are compared while streaming.
"""

from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.shared import release, shared_dir
from .common import NULL_ID, arrow_schema, known_id, record_batch, slices

MIN_BYTES = 100
GRAM = 32
MAX_BUCKET = 100_000
#: Windows of one text hashed at once.
STRETCH = (1 << 20) - 1024
_PLACE = np.uint64((1 << 20) - 1)

#: A cell's place in one number: start, number of windows, distance of the anchor.
_FIELD = 1 << 10
CELLS = "key bigint, id binary, at bigint"
#: ``shape`` is the distance of the anchor in a cell, or what else the row is.
CONTEXTS = "shape bigint, ctx binary, id binary, start bigint"
WINDOW, DONE = -1, -2
#: A span in one number: start and length; longer ones are given in parts.
SPANS = "id binary, span bigint"
_LENGTH = 1 << 20
KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, copies bigint"


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Mixed 64-bit hashes of all strings of ``n`` bytes (a power of two)."""
    h, factor, width = data.astype(np.uint64) + np.uint64(1), np.uint64(0x100000001B3), 1
    while width < n:
        h = h[:-width] * factor + h[width:]
        factor, width = factor * factor, 2 * width
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def cells(data: bytes, min_bytes: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(key, at) of every cell; ``at`` holds start, number of windows and anchor distance."""
    keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    span = min_bytes - gram + 1
    raw = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        for base in range(0, len(raw) - min_bytes + 1, STRETCH):
            h = _gram_hashes(raw[base : base + STRETCH + min_bytes - 1], gram)
            # The place in the low bits makes the leftmost of equal hashes the smallest.
            least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            n = len(h) - span + 1
            anchor = (np.minimum(least[:n], least[span - width :][:n]) & _PLACE).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            count = np.diff(np.concatenate([first, [n]]))
            keys.append(h[anchor[first]])
            places.append((base + first) * _FIELD * _FIELD + count * _FIELD + (anchor[first] - first))
    return np.concatenate(keys), np.concatenate(places)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _intervals(texts: list[bytes], order: list[int], least: int):
    """(length, from, to) of the common-prefix intervals of sorted texts, ``to`` included."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(order) + 1):
        shared = _common(texts[order[i - 1]], texts[order[i]]) if i < len(order) else -1
        low = i - 1
        while stack and shared < stack[-1][0]:
            length, low = stack.pop()
            if length >= least:
                yield length, low, i - 1
        if shared >= 0 and (not stack or shared > stack[-1][0]):
            stack.append((shared, low))


def maximal_repeats(contexts: list[tuple[bytes, int]], min_bytes: int = MIN_BYTES):
    """(members, left, right): groups of contexts (bytes, anchor) that share ``left`` bytes
    before and ``right`` bytes from the anchor on, ``min_bytes`` together, and no more."""
    rights = [ctx[off:] for ctx, off in contexts]
    lefts = [ctx[:off][::-1] for ctx, off in contexts]
    by_right = sorted(range(len(contexts)), key=rights.__getitem__)
    rank = {i: r for r, i in enumerate(sorted(range(len(contexts)), key=lefts.__getitem__))}
    most = max(map(len, lefts), default=0)
    for right, low, high in _intervals(rights, by_right, max(1, min_bytes - most)):
        members = sorted(by_right[low : high + 1], key=rank.__getitem__)
        for left, a, b in _intervals(lefts, members, max(0, min_bytes - right)):
            if b > a:
                yield members[a : b + 1], left, right


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def _packed(start: int, stop: int):
    for a in range(start, stop, _LENGTH - 1):
        yield a * _LENGTH + min(stop - a, _LENGTH - 1)


def _unpacked(spans: list[int]) -> list[tuple[int, int]]:
    return [(a, a + n) for a, n in (divmod(s, _LENGTH) for s in spans)]


def _candidates(docs: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    schema = arrow_schema(CELLS)

    def run(batches):
        for batch in slices(batches, "data", 1 << 20):
            for i, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
                keys, at = cells(data, min_bytes, gram)
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.repeat(pa.scalar(i, pa.binary()), len(keys)), pa.array(at)], schema=schema
                    )

    return docs.mapInArrow(run, CELLS)


def _contexts(joined: DataFrame, min_bytes: int, gram: int, every: bool) -> DataFrame:
    """The bytes of each candidate cell, or the digests of its windows where the anchor is hot.

    Unless ``every`` occurrence is asked for, a batch passes on its first of equal windows only.
    """
    schema = arrow_schema(CONTEXTS)

    def rows_of(i: bytes, data: bytes, found: list[int], windows: dict, done: list):
        for place in found:
            at, hot = divmod(place, 2)
            start, rest = divmod(at, _FIELD * _FIELD)
            n, off = divmod(rest, _FIELD)
            if not hot:
                yield off, data[start : start + n + min_bytes - 1], i, start
                continue
            for s in range(start, start + n):
                digest = blake2b(data[s : s + min_bytes], digest_size=16).digest()
                here = (i, s)
                if every:
                    yield WINDOW, digest, i, s
                    continue
                earlier = windows.setdefault(digest, here)
                if here < earlier:
                    windows[digest], here, earlier = here, earlier, here
                if here > earlier:
                    done.append(here)

    def run(batches):
        for batch in slices(batches, "data", 1 << 20):
            windows: dict[bytes, tuple[bytes, int]] = {}
            done: list[tuple[bytes, int]] = []
            out = []
            columns = (batch.column(c).to_pylist() for c in ("id", "data", "found"))
            for i, data, found in zip(*columns):
                out += rows_of(i, data, found, windows, done)
            out += [(WINDOW, digest, i, s) for digest, (i, s) in windows.items()]
            spans: dict[bytes, list] = {}
            for i, s in done:
                spans.setdefault(i, []).append((s, s + min_bytes))
            for i, found in spans.items():
                # Decided already: only passed on, with the stop instead of bytes.
                out += [(DONE, b"%d" % b, i, a) for a, b in _merged(found)]
            yield record_batch(out, schema)

    return joined.mapInArrow(run, CONTEXTS)


def _bucket_spans(contexts: list[tuple], min_bytes: int) -> list[tuple[bytes, int, int]]:
    """Spans of all but the first occurrence of every group of a bucket's distinct contexts."""
    found: dict[int, list] = {}
    anchors = [start + off for off, _, _, start in contexts]
    ids = [i for _, _, i, _ in contexts]
    for members, left, right in maximal_repeats([(ctx, off) for off, ctx, _, _ in contexts], min_bytes):
        first = min((ids[m], anchors[m]) for m in members)
        for m in members:
            if (ids[m], anchors[m]) > first:
                found.setdefault(m, []).append((anchors[m] - left, anchors[m] + right))
    return [(ids[m], a, b) for m, spans in found.items() for a, b in _merged(spans)]


def _bucket(shape: int, ctx: bytes, gram: int) -> bytes:
    """What the rows of a bucket share: the bytes at the anchor, or a window's digest."""
    return ctx[shape : shape + gram] if shape >= 0 else ctx


def _sorted(contexts: DataFrame, gram: int) -> DataFrame:
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = F.substring("ctx", F.col("shape").cast("int") + 1, F.lit(gram))
    bucket = F.when(F.col("shape") >= 0, shared).otherwise(F.col("ctx"))
    return contexts.repartition(parts, bucket).sortWithinPartitions(bucket, "shape", "ctx", "id", "start")


def _later_spans(contexts: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """(id, span): stretches that also start earlier, bucket by bucket in sorted order."""
    schema = arrow_schema(SPANS)

    def run(batches):
        bucket, distinct, last, first = None, [], None, None

        def finish():
            return _bucket_spans(distinct, min_bytes) if len(distinct) > 1 else []

        def packed(spans):
            return record_batch([(i, p) for i, start, stop in spans for p in _packed(start, stop)], schema)

        for batch in slices(batches, "ctx"):
            out = []
            for shape, ctx, i, start in zip(*(c.to_pylist() for c in batch.columns)):
                if shape == DONE:
                    out.append((i, start, int(ctx)))
                    continue
                if (key := (_bucket(shape, ctx, gram), shape == WINDOW)) != bucket:
                    out += finish()
                    bucket, distinct, last = key, [], None
                if (shape, ctx) != last:
                    last, first = (shape, ctx), (i, start)
                    if shape != WINDOW:
                        distinct.append((shape, ctx, i, start))
                elif (i, start) > first:
                    out.append((i, start, start + (min_bytes if shape == WINDOW else len(ctx))))
            yield packed(out)
        yield packed(finish())

    return _sorted(contexts, gram).mapInArrow(run, SPANS)


class _Texts:
    """Each different document once, with its cells' occurrences, in tables bucketed by ``id``.

    Texts are shuffled once, when they are stored; what is found about them is brought to
    them in buckets of its own.  After each written table Spark may drop the shuffles behind it.
    """

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.root = shared_dir(self.spark, "repeats")
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = self.stored(_distinct_rows(docs, self.root), "texts")

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        table = f"repeats_{uuid4().hex}"
        writer = df.repartition(self.parts, "id").write.bucketBy(self.parts, "id").sortBy("id")
        writer.option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(table)
        found = self.spark.table(table)
        # The files stay, and the plan holds where they are.
        self.spark.sql(f"DROP TABLE {table}")
        release(self.spark)
        return found

    def contexts(self, min_bytes: int, gram: int, max_bucket: int, every: bool = False) -> DataFrame:
        found = _candidates(self.table.select("id", "data"), min_bytes, gram)
        path = f"{self.root}/anchors"
        again = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        again.select("key", (F.col("n") > max_bucket).cast("bigint").alias("hot")).write.parquet(path)
        release(self.spark)
        # Read again: both sides of the join are shuffled as they are, and a hot anchor can be split.
        anchors = self.spark.read.schema("key bigint, hot bigint").parquet(path)
        places = found.join(anchors, "key").select("id", (2 * F.col("at") + F.col("hot")).alias("place"))
        per_doc = self.stored(places.groupBy("id").agg(F.collect_list("place").alias("found")), "places")
        return _contexts(self.table.select("id", "data").join(per_doc, "id"), min_bytes, gram, every)


def _distinct_rows(docs: DataFrame, root: str) -> DataFrame:
    """``doc_id``, ``id``, ``data`` and ``copies``; ``id`` is the number in eight bytes, in
    order, and the digest of the text where several rows have the number or none.  Rows
    that are equal in number and text are one, with the number of its copies."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), known_id().alias("number"), data.alias("data"))
    path = f"{root}/numbers"
    again = texts.groupBy("number").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again.select("number", F.lit(True).alias("again")).write.parquet(path)
    # Read again: its size is known, so the texts are not shuffled for the few numbers it usually has.
    again = spark.read.schema("number bigint, again boolean").parquet(path)
    number = F.unhex(F.lpad(F.hex(F.col("number").bitwiseXOR(F.lit(NULL_ID))), 16, "0"))
    digest = F.when(F.col("again"), F.unhex(F.md5("data"))).otherwise(F.lit(b""))
    rows = texts.join(again, "number", "left").select("doc_id", F.concat(number, digest).alias("id"), "data", "again")
    one = F.lit(1).cast("bigint").alias("copies")
    alone = rows.filter("again IS NULL").select("doc_id", "id", "data", one)
    some = rows.filter("again").groupBy("id").agg(F.first("doc_id").alias("doc_id"), F.first("data").alias("data"), F.count(F.lit(1)).alias("copies"))
    return alone.unionByName(some)


def _number(row_id: str) -> Column:
    """The id as given, from the ``id`` of ``_rows``."""
    number = F.conv(F.hex(F.substring(row_id, 1, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(NULL_ID))
    return F.when(number != NULL_ID, number)


MEMBERS = "name string, ctx binary, shape bigint, before bigint, after bigint"


def _members(contexts: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """Groups as (name, context, bytes before and after the anchor); a row for each different context."""
    schema = arrow_schema(MEMBERS)

    def groups_of(key: bytes, distinct: dict[tuple[int, bytes], int]):
        for (shape, ctx), n in distinct.items():
            if n > 1:
                name = f"{blake2b(ctx, digest_size=16).hexdigest()}-{shape}"
                yield name, ctx, shape, max(shape, 0), (min_bytes if shape == WINDOW else len(ctx) - shape)
        kinds = [k for k in distinct if k[0] != WINDOW]
        groups = maximal_repeats([(ctx, off) for off, ctx in kinds], min_bytes)
        for g, (members, left, right) in enumerate(groups):
            for m in members:
                yield f"{blake2b(key, digest_size=16).hexdigest()}#{g}", kinds[m][1], kinds[m][0], left, right

    def run(batches):
        bucket, distinct = None, {}
        for batch in slices(batches, "ctx"):
            out = []
            for shape, ctx in zip(*(batch.column(c).to_pylist() for c in ("shape", "ctx"))):
                if (key := (_bucket(shape, ctx, gram), shape == WINDOW)) != bucket:
                    out += groups_of(bucket[0], distinct) if bucket else []
                    bucket, distinct = key, {}
                distinct[shape, ctx] = distinct.get((shape, ctx), 0) + 1
            yield record_batch(out, schema)
        yield record_batch(list(groups_of(bucket[0], distinct)) if bucket else [], schema)

    return _sorted(contexts, gram).mapInArrow(run, MEMBERS)


def repeat_groups(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(name, doc_id, start, stop, length): the groups of equal strings, a row for each occurrence.

    A group is a maximal repeat as far as the cells of its anchor reach; longer
    repeats come as a row of overlapping groups, and around anchors with more than
    ``max_bucket`` occurrences as groups of ``min_bytes`` each.  Nulls, repeated rows
    and other columns are treated as by ``remove_repeats``.
    """
    found = _Texts(docs).contexts(min_bytes, gram, max_bucket, every=True)
    # Occurrences meet the groups of their context again, so no group is held in one place.
    joined = found.join(_members(found, min_bytes, gram), ["shape", "ctx"])
    start = F.col("start") + F.greatest("shape", F.lit(0)) - F.col("before")
    stop = F.col("start") + F.greatest("shape", F.lit(0)) + F.col("after")
    placed = joined.select("name", "id", start.alias("start"), stop.alias("stop")).distinct()
    return placed.select("name", _number("id").alias("doc_id"), "start", "stop", (F.col("stop") - F.col("start")).alias("length"))


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) of every row of ``docs``.

    A byte is removed if a string of ``min_bytes`` bytes covers it that also starts
    earlier: in a smaller id, or earlier in the same text.  Matches do not cross
    documents.  A null text is empty and keeps nothing; texts shorter than
    ``min_bytes`` stay.  A null id comes before all others.  Rows that are equal in id
    and text are one document; different texts of one id, or without an id, are
    documents of their own, in the order of their md5 digests.  Other columns are ignored.
    """
    texts = _Texts(docs)
    later = _later_spans(texts.contexts(min_bytes, gram, max_bucket), min_bytes, gram)
    per_doc = texts.stored(later.groupBy("id").agg(F.collect_list("span").alias("spans")), "spans")
    schema = arrow_schema(KEPT)

    def run(batches):
        for batch in slices(batches, "data"):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "data", "spans", "copies"))
            for i, data, spans, copies in zip(*columns):
                gone = _merged([(a, min(b, len(data))) for a, b in _unpacked(spans or []) if a < len(data)])
                edges = [0] + [e for span in gone for e in span] + [len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((i, len(data), len(data) - len(kept), len(gone), kept, copies))
            yield record_batch(out, schema)

    kept = texts.table.join(per_doc, "id", "left").mapInArrow(run, KEPT)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copy", "copies")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
