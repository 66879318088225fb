"""SimHash near-duplicates: fingerprints, multi-index hashing and components.

Two fingerprints at ``BITS`` = 4 or fewer differing bits have, in one of three
segments, at most one differing bit.  Every fingerprint is stored under the value of
each segment and looks itself up under every value of a ball of radius one around it;
the whole distance is checked inside the join, so only links leave it.  Of two segment
values that differ, the one with the bit unset looks up the other, so a pair meets
once per segment.

Equal fingerprints are merged before, and fingerprints one bit apart are joined into
groups first: the second search then reports only links between different groups,
which keeps dense groups of near copies from giving all their pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.shared import shared_dir
from .common import arrow_schema, ids_and_texts, slices
from .components import components

BITS = 4
SHINGLE = 4
SEED = 42
#: (lowest bit, width) of the segments; more than BITS / 2 of them, so a radius of one is enough.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SCHEMA = "doc_id bigint, fp bigint, digest binary"


def fingerprint(text: str) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _digest() -> Column:
    """Tells the texts of rows with one id apart, or of rows without an id."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame) -> DataFrame:
    schema = arrow_schema(SCHEMA)

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
            signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            columns = [batch.column("doc_id"), signed, batch.column("digest")]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return ids_and_texts(docs).withColumn("digest", _digest()).mapInArrow(run, SCHEMA)


def _segment(column: str, low: int, width: int):
    return F.shiftrightunsigned(F.col(column), low).bitwiseAND((1 << width) - 1)


def _stored(fps: DataFrame, segments) -> DataFrame:
    keys = [
        F.struct(F.lit(i).alias("seg"), _segment("fp", low, width).alias("key"))
        for i, (low, width) in enumerate(segments)
    ]
    return fps.select("*", F.explode(F.array(*keys)).alias("at")).select("*", "at.seg", "at.key").drop("at")


def _more_bits(own, width: int):
    """The value itself and every value with one more bit."""
    unset = F.filter(F.array(*(F.lit(1 << b) for b in range(width))), lambda bit: own.bitwiseAND(bit) == 0)
    return F.concat(F.array(own), F.transform(unset, lambda bit: own.bitwiseOR(bit)))


def _ball(fps: DataFrame, segments) -> DataFrame:
    """Every value with at most one bit more than the fingerprint's own segment."""

    def asked(i: int, low: int, width: int):
        return F.transform(
            _more_bits(_segment("fp", low, width), width), lambda v: F.struct(F.lit(i).alias("seg"), v.alias("key"))
        )

    values = [asked(i, low, width) for i, (low, width) in enumerate(segments)]
    return fps.select("*", F.explode(F.concat(*values)).alias("at")).select("*", "at.seg", "at.key").drop("at")


def _links(fps: DataFrame, segments, bits: int) -> DataFrame:
    """(a, b): fingerprints of different groups at ``bits`` or fewer differing bits."""
    left = _stored(fps, segments).withColumnsRenamed({"fp": "a", "grp": "grp_a"})
    right = _ball(fps, segments).withColumnsRenamed({"fp": "b", "grp": "grp_b"})
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    # Spark sizes an exploded table as what it was made of, and would broadcast some 35 rows a fingerprint.
    return left.hint("merge").join(right, ["seg", "key"]).filter((F.col("grp_a") != F.col("grp_b")) & near)


def _bit_apart(fps: DataFrame) -> DataFrame:
    """(a, b): fingerprints that differ in exactly one bit; at most n log2(n) / 2 pairs."""
    flips = F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)))
    more = F.filter(flips, lambda bit: F.col("fp").bitwiseAND(bit) == 0)
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.transform(more, lambda bit: F.col("fp").bitwiseOR(bit))).alias("b"))
    return asked.join(fps.select(F.col("fp").alias("b")), "b").select("a", "b")


def _grouped(docs: DataFrame, bits: int) -> DataFrame:
    """``id``, ``fp``, ``digest`` of every row, ``class`` (the smallest fingerprint of its
    component) and ``component`` (the smallest id)."""
    if bits > 2 * len(SEGMENTS) - 1:
        raise ValueError("bits must be below twice the number of segments")
    spark: SparkSession = docs.sparkSession
    root = shared_dir(spark, "simhash")
    fingerprints(docs).withColumnRenamed("doc_id", "id").write.parquet(f"{root}/documents")
    rows = spark.read.schema("id bigint, fp bigint, digest binary").parquet(f"{root}/documents")
    rows.groupBy("fp").agg(F.min("id").alias("rep")).write.parquet(f"{root}/distinct")
    distinct = spark.read.schema("fp bigint, rep bigint").parquet(f"{root}/distinct")

    close = components(_bit_apart(distinct.select("fp")), f"{root}/close")
    grouped = (
        distinct.select("fp")
        .join(close.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("component", "fp").alias("grp"))
    )
    grouped.write.parquet(f"{root}/grouped")
    grouped = spark.read.schema("fp bigint, grp bigint").parquet(f"{root}/grouped")
    between = _links(grouped, SEGMENTS, bits).select(
        F.least("grp_a", "grp_b").alias("a"), F.greatest("grp_a", "grp_b").alias("b")
    )
    joined = components(between.distinct(), f"{root}/joined")
    named = (
        grouped.join(joined.withColumnRenamed("node", "grp"), "grp", "left")
        .select("fp", F.coalesce("component", "grp").alias("class"))
        .join(distinct, "fp")
    )
    named.write.parquet(f"{root}/named")
    named = spark.read.schema("fp bigint, class bigint, rep bigint").parquet(f"{root}/named")
    # Tables of their own: the joins shuffle both sides, so that a large class can be split.
    named.groupBy("class").agg(F.min("rep").alias("component")).write.parquet(f"{root}/smallest")
    smallest = spark.read.schema("class bigint, component bigint").parquet(f"{root}/smallest")
    named.select("fp", "class").join(smallest, "class").select("fp", "class", "component").write.parquet(f"{root}/classes")
    classes = spark.read.schema("fp bigint, class bigint, component bigint").parquet(f"{root}/classes")
    return rows.join(classes, "fp")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``fp`` (signed), ``component_id`` and ``component`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, null if no row reached has
    an id.  Components of rows without an id, or of rows that share an id, can have the
    same one; ``component``, the smallest fingerprint (signed) reachable, is different
    for each.  A text without words (null, empty, white space) has fingerprint zero and
    is linked like any other.  Other columns are ignored.  ``bits`` is at most 5, since
    each of the three segments is searched within one bit.
    """
    return _grouped(docs, bits).select(
        F.col("id").alias("doc_id"), "fp", F.col("component").alias("component_id"), F.col("class").alias("component")
    )


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def shown(found: DataFrame, *more: str) -> DataFrame:
    """With fingerprints, also those of the columns ``more``, as 16 hexadecimal digits."""
    return found.select("doc_id", _hex("fp").alias("fingerprint"), "component_id", *(_hex(c).alias(c) for c in more))


def keep_first(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each component, with all columns: a row of its smallest id.

    A row without an id stays only if no row of its component has one.  Of several such
    rows of a component, or several with the smallest id, the one with the smallest
    digest of its text stays; of rows that are equal in both, any one.
    """
    found = _grouped(docs, bits).filter(F.col("id").eqNullSafe(F.col("component")))
    first = found.groupBy("class").agg(F.min("id").alias("_kept"), F.min("digest").alias("_digest"))
    own = F.col("doc_id").cast("bigint")
    kept = docs.join(first, own.eqNullSafe(first["_kept"]) & (_digest() == first["_digest"]), "left_semi")
    key = "_row"
    while key in map(str.lower, docs.columns):
        key += "_"
    return kept.withColumn(key, F.struct(own, _digest())).dropDuplicates([key]).drop(key)
