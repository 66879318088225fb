"""Pieces shared by the operators: reading, row batches, ids and folds."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.shared import shared_dir

#: Stands for a null id inside joins and orders; it comes before every other id.
NULL_ID = -(2**63)
#: ASCII white space, as the regular expression class [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text handled at once inside a task.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only what the operators read, so that further columns cannot clash with theirs."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quoted(column: str) -> Column:
    """A column of any name, also one with dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def known_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NULL_ID))


def given_id(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def in_fold(modulus: int, rest: int) -> Column:
    return F.coalesce(fold(modulus) == rest, F.lit(False))


def sampled_labels(labels: DataFrame, per_label: int) -> dict[int, int]:
    """Up to ``per_label`` ids of each label 0 and 1, with their label.

    Only (doc_id, label) rows with both known count; of several labels of one id the
    larger holds.  The ids are those with the smallest hashes, the same in every run.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    # Two top-k queries, each with a bounded result, instead of a window that sorts a whole label in one task.
    chosen = [
        rows.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)
    ]
    return {r["doc_id"]: r["label"] for part in chosen for r in part.collect()}


def one_text_each(docs: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id, text) of the given ids, a row each, kept as a table in the shared folder.

    Of different texts under one id the one with the smallest hash stays, ties by text, so an id that
    fills the table gives one row, reduced before the shuffle.
    """
    rows = ids_and_texts(docs).filter(F.col("doc_id").isin(ids))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    path = shared_dir(docs.sparkSession, "sample")
    rows.groupBy("doc_id").agg(first.alias("first")).select("doc_id", "first.text").write.parquet(path)
    return docs.sparkSession.read.schema("doc_id bigint, text string").parquet(path)


def slices(batches, column: str = "text", limit: int = BATCH_BYTES):
    """Row batches again, cut so that each holds about ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def filter_texts(docs: DataFrame, make_keep) -> DataFrame:
    """Rows of ``docs``, with all columns, whose texts are to be kept.

    ``make_keep`` is called once per task and gives a function from a list of texts
    (null: empty) to a list of booleans.
    """

    # Columns go through Python by position, since their names may hold dots.
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index('text')}"

    def run(batches):
        keep = make_keep()
        for batch in slices(batches, text):
            yield batch.filter(pa.array(keep([t or "" for t in batch.column(text).to_pylist()]), pa.bool_()))

    return inner.mapInArrow(run, inner.schema).toDF(*names)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])
