"""Line de-duplication with levelled sorted runs of line hashes.

Batches of documents arrive in order of id.  The index is a set of runs, tables of
(hash, owner) bucketed and sorted by hash, in levels.  A batch is reduced to one row
per hash, merge-anti-joined with every run, and what is new becomes a run of level 0;
``FANOUT`` runs of a level are merged into one of the next.  Since batches come in
order, a hash already in a run has a smaller owner, and a new hash is owned by the
smallest id of its batch.  Hashes are 128 bits, so different lines meet in one
with a chance below 1e-12 even among 1e13 lines.
"""

import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..operators.joins import join_unique
from ..plans.shared import shared_dir
from .common import SPACE, UPPER, ids_and_texts, known_id, quoted, slices

BATCHES = 4
FANOUT = 2
MIN_CHARS = 10


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h): the distinct hashes of the lines of each row that can be duplicates."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key)
    long_enough = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    hashes = F.array_distinct(F.transform(long_enough, lambda k: F.unhex(F.md5(k.cast("binary")))))
    return docs.select(known_id().alias("id"), F.explode(hashes).alias("h"))


class LineRuns:
    """The index: runs in levels, each a bucketed and sorted table in the shared folder."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root, fanout
        # As many buckets as shuffle partitions, so that a join with a run moves only the batch.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.select("h", "owner")
            .repartition(self.buckets, "h")
            .sortWithinPartitions("h")
            .write.bucketBy(self.buckets, "h")
            .sortBy("h")
            .option("path", f"{self.root}/{name}")
            .saveAsTable(name)
        )
        return name

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def add(self, hashes: DataFrame) -> str:
        """Add a batch of (id, h); the name of the run that holds what was new."""
        fresh = hashes.groupBy("h").agg(F.min("id").alias("owner"))
        for name in (name for level in self.levels for name in level):
            # Merged whatever its size: a run's file is a fraction of what the driver would hold to broadcast it.
            fresh = fresh.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        name = self._write(fresh)
        self.levels[0].append(name)
        return name

    def compact(self) -> None:
        """Merge full levels upwards; runs are disjoint, so merging is a union."""
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            rows = self.spark.table(level[0])
            for name in level[1:]:
                rows = rows.unionByName(self.spark.table(name))
            merged = self._write(rows)
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)
            level.clear()

    def close(self, names: list[str]) -> None:
        """Forget the tables; their files stay in the shared folder."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _cuts(hashes: DataFrame, batches: int) -> list[int]:
    """Ids at which batches end: a few numbers, whatever the table."""
    shares = [i / batches for i in range(1, batches)]
    found = hashes.agg(F.percentile_approx("id", shares, 1000).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def dropped_hashes(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, hashes): the line hashes each document has to give up."""
    spark = docs.sparkSession
    root = shared_dir(spark, "lines")
    hashes = line_hashes(docs, min_chars)
    cuts = _cuts(docs.select(known_id().alias("id")), batches)
    number = sum((F.col("id") > cut).cast("int") for cut in cuts) if cuts else F.lit(0)
    hashes.withColumn("batch", number).write.partitionBy("batch").parquet(f"{root}/hashes")
    stored = spark.read.schema("id bigint, h binary, batch int").parquet(f"{root}/hashes")
    runs = LineRuns(spark, root)
    names, parts = [], []
    for i in range(len(cuts) + 1):
        mine = stored.filter(F.col("batch") == i).select("id", "h")
        names.append(runs.add(mine))
        # Read as plain files: both sides are shuffled, and a hot hash can be split.
        own = spark.read.schema("h binary, owner bigint").parquet(runs.path(names[-1]))
        kept = (F.col("owner") == F.col("id")) & F.col("owner").isNotNull()
        parts.append(mine.join(own.hint("merge"), "h", "left").filter(~F.coalesce(kept, F.lit(False))).select("id", "h"))
        if i < len(cuts):
            runs.compact()
    runs.close(names)
    gone = parts[0]
    for part in parts[1:]:
        gone = gone.unionByName(part)
    return gone.groupBy("id").agg(F.collect_set("h").alias("hashes"))


def _key(line: str) -> bytes:
    return line.strip(SPACE).encode().lower()


def keep_lines(text: str, gone: set[bytes], min_chars: int) -> tuple[int, int, str]:
    lines = text.split("\n")
    if not gone:
        return len(lines), 0, text
    kept = []
    for line in lines:
        key = _key(line)
        if len(key) < min_chars or hashlib.md5(key).digest() not in gone:
            kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _cleaned(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """(row, n_lines, n_dropped, text): ``row`` is a struct of the other columns."""
    gone = dropped_hashes(docs, batches, min_chars)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        known_id().alias("id"), F.struct(*(quoted(c) for c in others)).alias("row"), F.col("text").cast("string").alias("text")
    )

    def run(batches):
        for batch in slices(batches):
            found = [
                keep_lines(text or "", set(hashes or ()), min_chars)
                for text, hashes in zip(batch.column("text").to_pylist(), batch.column("hashes").to_pylist())
            ]
            n_lines, n_dropped, texts = zip(*found)
            columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())]
            columns[2] = pc.if_else(batch.column("text").is_null(), pa.scalar(None, pa.string()), columns[2])
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "n_lines", "n_dropped", "text"])

    out = StructType([rows.schema["row"]])
    for name, kind in (("n_lines", LongType()), ("n_dropped", LongType()), ("text", StringType())):
        out.add(name, kind)
    # An id may be on many rows, as the null id is.
    return join_unique(rows, gone, "id", "left").select("row", "text", "hashes").mapInArrow(run, out)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the ``text`` left, for every row of ``docs``.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased; keys of at least ``min_chars`` characters stay only in the document
    with the smallest id, with all their lines there.  A null or empty text is one
    empty line, and a null stays null.  A null id is one document that comes before
    all others; rows that share an id are one document, and each gives a result.
    Very long texts are cut whole; a task holds one of them at a time.
    Other columns are ignored.
    """
    return _cleaned(ids_and_texts(docs), batches, min_chars).select("row.doc_id", "n_lines", "n_dropped", "text")


def replace_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs``, with all columns, and the text that ``dedup_lines`` leaves."""
    cleaned = _cleaned(docs, batches, min_chars)
    return cleaned.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def digests(cleaned: DataFrame) -> DataFrame:
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone
  FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
