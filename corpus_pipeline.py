"""A training corpus from ``documents``: filter, de-duplicate, decontaminate, tokenise.

Every stage takes what the one before has kept and, but for the last, returns rows
with the columns of ``documents``.  Null ids, null and empty texts, repeated rows and
empty tables are handled as the operators say; further columns are passed on.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import decontaminate, lines, pieces, queries, simhash, toxicity
from sitelens.llm.common import documents
from sitelens.plans.shared import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit of the toxicity query; null texts score as empty ones."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs), queries.TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a line that a smaller id holds as well is taken out of the text."""
    return lines.replace_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates; texts without words are one group."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts hold none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the text decoded from them; null texts have no ids."""
    return pieces.encode_decode(docs, pieces.read_model(queries.PIECE_MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: The model of the first stage is learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared folder and read again."""
    folder, docs = shared_dir(spark, "corpus"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
