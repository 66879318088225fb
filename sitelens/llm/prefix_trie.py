"""Trie of conversation prefixes over range-partitioned paths, joined by a skeleton.

A conversation's path is the string of its turns, ``ENTRY`` bytes each (a digest of
role and text, and the text's length).  Splitter paths cut the sorted paths into
shards.  All paths below one node are neighbours in that order, so a node whose paths
lie in two shards is a prefix of a splitter: it is in the trie of the splitter paths, the
skeleton, which every task gets.  A shard is scanned once, in order, with a stack; it
finishes every node outside the skeleton and gives partial sums for those inside.
These are added up by a reduction and completed from the deepest node upwards.

The skeleton has at most (shards x ``SPLIT_TURNS``) nodes.  Equal paths are cut by
conversation, so copies spread over shards.  Texts are never shuffled, only entries.
"""

import zlib
from bisect import bisect_right
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import shared_dir
from .common import arrow_schema, record_batch, slices

ENTRY = 24
#: Turns of a splitter path that are kept; longer ones are cut there.
SPLIT_TURNS = 1024
#: Paths sampled for each shard.
SAMPLE = 20
#: Conversation ids in one row of a skeleton node's ends.
RUN = 1 << 16
#: First turns taken over from the first conversation of a family: fewer than this.
TAKEN = 9
FAMILY = 5

PATHS = "conv_id bigint, path binary"
SHARDED = "shard int, conv_id bigint, path binary"
#: A finished node (``skel`` null), a skeleton node's sums, or a run of its ends (``run`` not null).
SCANNED = (
    "skel bigint, conv_id bigint, depth bigint, parent_conv_id bigint, parent_skel bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, run binary"
)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SUMS = "skel bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _entries(turns: DataFrame) -> DataFrame:
    """``family``, ``conv_id``, ``turn`` and ``entry`` of every turn with a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("bigint")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    size = F.unhex(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0"))
    return turns.filter(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"), F.concat(digest, size).alias("entry"),
    )


def taken(conv: int) -> int:
    """How many turns a conversation takes over."""
    return zlib.crc32(str(conv).encode()) % TAKEN


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation, its first turns replaced by those of its family's first."""
    schema = arrow_schema(PATHS)

    def run(batches):
        for batch in batches:
            out = []
            for family, convs, entries in zip(*(batch.column(c).to_pylist() for c in ("family", "convs", "entries"))):
                own: dict[int, list[bytes]] = {}
                for conv, entry in zip(convs, entries):
                    own.setdefault(conv, []).append(entry)
                first = own.get(family, [])
                for conv, path in own.items():
                    h = taken(conv)
                    out.append((conv, b"".join(first[:h] + path[h:])))
            yield record_batch(out, schema)

    ordered = F.sort_array(F.collect_list(F.struct("conv_id", "turn", "entry")))
    families = _entries(turns).groupBy("family").agg(ordered.alias("turns"))
    fields = families.select("family", F.col("turns.conv_id").alias("convs"), F.col("turns.entry").alias("entries"))
    return fields.mapInArrow(run, PATHS)


class Skeleton:
    """The trie of the splitter paths; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.size = [-1], [0], [0]
        for path, _ in splitters:
            node = 0
            for k in range(0, len(path), ENTRY):
                entry = path[k : k + ENTRY]
                if (node, entry) not in self.child:
                    self.child[node, entry] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.size.append(_size(entry))
                node = self.child[node, entry]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))


def _size(entry: bytes) -> int:
    return int.from_bytes(entry[16:], "big")


def _shared_entries(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // ENTRY
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * ENTRY : middle * ENTRY] == b[low * ENTRY : middle * ENTRY]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    __slots__ = ("depth", "size", "skel", "low", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, size: int, skel: int | None):
        self.depth, self.size, self.skel = depth, size, skel
        self.low: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        #: Ids that end here: a running digest, or the open run of a skeleton node.
        self.ends = [] if skel is not None else None
        #: Children that only miss their parent's id.
        self.waiting: list[list] = []


class Scan:
    """Sorted paths of a shard to rows of ``SCANNED``."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.out = skeleton, []
        self.stack, self.path = [_Node(0, 0, 0)], b""

    def add(self, path: bytes, conv: int) -> None:
        common = _shared_entries(self.path, path)
        self._pop(common)
        for k in range(common * ENTRY, len(path), ENTRY):
            above, entry = self.stack[-1], path[k : k + ENTRY]
            skel = None if above.skel is None else self.skeleton.child.get((above.skel, entry))
            self.stack.append(_Node(above.depth + 1, _size(entry), skel))
        self.path, end = path, self.stack[-1]
        end.n += 1
        end.low = conv if end.low is None else min(end.low, conv)
        if end.skel is not None:
            end.ends.append(conv)
            if len(end.ends) == RUN:
                self._run(end)
        elif end.ends is None:
            end.ends = sha256(b"%d" % conv)
        else:
            end.ends.update(b",%d" % conv)

    def close(self) -> None:
        """The end of a shard."""
        self._pop(0)
        self._finish(self.stack.pop(), None)
        self.stack, self.path = [_Node(0, 0, 0)], b""

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            self._finish(node, self.stack[-1])

    def _run(self, node: _Node) -> None:
        if node.ends:
            packed = np.array(node.ends, dtype="<i8").tobytes()
            self.out.append((node.skel, node.ends[0], *[None] * 8, packed))
            node.ends = []

    def _finish(self, node: _Node, above: _Node | None) -> None:
        if above is not None:
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)
        if node.skel is not None:
            self._run(node)
            sums = (node.n, node.children, node.leaves, node.saved)
            self.out.append((node.skel, node.low, node.depth, None, None, *sums, None, None))
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.size
        ends = (node.ends or sha256()).hexdigest()
        row = [None, node.low, node.depth, None, above.skel, node.n, node.children, leaves, saved, ends, None]
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skel is not None:
            self.out.append(tuple(row))
        else:
            above.waiting.append(row)
        for child in node.waiting:
            child[3] = node.low
            self.out.append(tuple(child))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 (path, conv_id), from a sample of about ``SAMPLE`` paths a shard."""
    rows = paths.count()
    if rows < 2 or shards < 2:
        return []
    cut = F.substring("path", 1, SPLIT_TURNS * ENTRY).alias("path")
    some = paths.sample(min(1.0, SAMPLE * shards / rows), seed=7) if rows > SAMPLE * shards else paths
    found = sorted((bytes(r.path), r.conv_id) for r in some.select(cut, "conv_id").limit(2 * SAMPLE * shards).collect())
    return sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []


def _scanned(paths: DataFrame, skeleton: Skeleton, shards: int) -> DataFrame:
    out, sharded = arrow_schema(SCANNED), arrow_schema(SHARDED)

    def deal(batches):
        for batch in batches:
            convs, found = batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()
            shard = pa.array([skeleton.shard(p, c) for p, c in zip(found, convs)], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, batch.column("conv_id"), batch.column("path")], schema=sharded)

    def run(batches):
        scan, current = Scan(skeleton), None
        for batch in slices(batches, "path"):
            for shard, conv, path in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path"))):
                if shard != current and current is not None:
                    scan.close()
                current = shard
                scan.add(path, conv)
            yield record_batch(scan.taken(), out)
        if current is not None:
            scan.close()
            yield record_batch(scan.taken(), out)

    dealt = paths.mapInArrow(deal, SHARDED).repartition(shards, "shard")
    return dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, SCANNED)


def _skeleton_rows(sums: list, skeleton: Skeleton) -> list[tuple]:
    """Rows of ``SUMS``: the added partial sums, completed from the deepest nodes upwards."""
    n, low, children, leaves, saved = ([0] * len(skeleton.parent) for _ in range(5))
    for r in sums:
        n[r.skel], low[r.skel] = r.n_convs, r.conv_id
        children[r.skel], leaves[r.skel], saved[r.skel] = r.n_children, r.n_leaves, r.saved_tokens
    # A node comes after its parent in the trie.
    for node in range(len(n) - 1, -1, -1):
        saved[node] += (n[node] - 1) * skeleton.size[node]
        leaves[node] += children[node] == 0
        above = skeleton.parent[node]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    return [
        (i, low[i], skeleton.depth[i], low[p] if (p := skeleton.parent[i]) >= 0 else None, n[i], children[i], leaves[i], saved[i])
        for i in range(len(n))
    ]


def _end_digests(runs: DataFrame) -> DataFrame:
    """(skel, ends_sha256): the runs of a node in order, hashed while they stream by."""
    schema = arrow_schema("skel bigint, ends_sha256 string")

    def run(batches):
        current, digest = None, None
        for batch in slices(batches, "run"):
            out = []
            for skel, packed in zip(batch.column("skel").to_pylist(), batch.column("run").to_pylist()):
                ids = ",".join(map(str, np.frombuffer(packed, "<i8").tolist())).encode()
                if skel != current:
                    if current is not None:
                        out.append((current, digest.hexdigest()))
                    current, digest = skel, sha256(ids)
                else:
                    digest.update(b"," + ids)
            yield record_batch(out, schema)
        if current is not None:
            yield record_batch([(current, digest.hexdigest())], schema)

    dealt = runs.select("skel", F.col("conv_id").alias("first"), "run").repartition("skel")
    return dealt.sortWithinPartitions("skel", "first").mapInArrow(run, "skel bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored.
    ``conv_id`` is the smallest conversation below a node, ``parent_conv_id`` that of its
    parent (root: null).  A null role or text is empty, a null turn comes first, equal
    turns of one conversation are in the order of their digests, and repeated rows are
    turns of their own.  Rows without ``conv_id`` belong to no conversation and are not
    counted.  An empty table has no nodes, not even a root.  Texts of any length are
    reduced to digests where they are read.  A conversation is one row of ``ENTRY`` bytes
    a turn, as a document is one row.  ``shards`` is ``spark.sql.shuffle.partitions``
    unless given, and changes no result.
    """
    spark: SparkSession = turns.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_dir(spark, "trie")
    rebuilt_paths(turns).write.parquet(f"{folder}/paths")
    paths = spark.read.schema(PATHS).parquet(f"{folder}/paths")
    skeleton = Skeleton(choose_splitters(paths, shards))
    _scanned(paths, skeleton, shards).write.parquet(f"{folder}/scanned")
    scanned = spark.read.schema(SCANNED).parquet(f"{folder}/scanned")
    partial = scanned.filter("skel IS NOT NULL AND run IS NULL").groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    sums = partial.collect()
    # Of the size of the skeleton, which is bounded.
    top = F.broadcast(spark.createDataFrame(_skeleton_rows(sums, skeleton) if sums else [], SUMS))
    above = top.select(F.col("skel").alias("parent_skel"), F.col("conv_id").alias("above"))
    done = scanned.filter("skel IS NULL").join(above, "parent_skel", "left")
    done = done.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    ends = _end_digests(scanned.filter("run IS NOT NULL"))
    nothing = F.lit(sha256().hexdigest())
    upper = ends.join(top, "skel", "right").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return done.select(NODE).unionByName(upper.select(NODE))


#: The registered query in SQL; crc32 is spelled out bit by bit.
ORACLE = """
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT conv_id, p, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
      lambda u, i: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384::BIGINT) ELSE u // 2 END)
  ), 4294967295::BIGINT) % 9 AS h FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.p, [])[1:c.h], c.p[c.h + 1:]) AS q
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), steps AS (
  SELECT conv_id, len(q) AS n, unnest(range(len(q) + 1)) AS d, q FROM rebuilt
), nodes AS (
  SELECT q[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends
  FROM steps GROUP BY 1, 2
), counted AS (
  SELECT p.path, p.depth, p.conv_id, p.n_convs, p.ends, u.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes k WHERE k.depth = p.depth + 1 AND k.path[1:p.depth] = p.path) AS n_children,
    CASE WHEN p.depth = 0 THEN 0 ELSE (p.n_convs - 1) * strlen(p.path[-1].x) END AS saved
  FROM nodes p LEFT JOIN nodes u ON u.depth = p.depth - 1 AND p.path[1:p.depth - 1] = u.path
)
SELECT p.conv_id, p.depth::BIGINT AS depth, p.parent_conv_id, p.n_convs, p.n_children,
  count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens,
  sha256(coalesce(p.ends, '')) AS ends_sha256
FROM counted p JOIN counted k ON k.depth >= p.depth AND k.path[1:p.depth] = p.path
GROUP BY p.path, p.conv_id, p.depth, p.parent_conv_id, p.n_convs, p.n_children, p.ends
"""
