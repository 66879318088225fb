"""Crawl tables: one row per fetched URL, and the checks before analysis."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.encoding import detect_charset, to_utf8
from ..functions.text import parse_log_line
from ..functions.values import is_blank, trim

FETCH_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("http_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("fetch_time_ms", T.LongType()),
        T.StructField("redirect_count", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)
FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
LANDED_SCHEMA = "page_id BIGINT, url STRING, reason STRING, charset STRING, html STRING, refused BOOLEAN"
PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"

# What can be analysed.
CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
MAX_BYTES = 2_000_000
#: Bytes of a row group of page packs.
PACK_GROUP = 16_000_000


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCH_SCHEMA).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores when they may arrive in fewer parts than there are cores.

    Parsing pages is bound by CPU, so a table of a few row groups would leave most
    cores idle.  A row group is read by one task, however many splits its file has, so
    files are counted too.  A table of many files is passed through without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = len(rows.inputFiles())
    few = files < cores or rows.rdd.getNumPartitions() < cores
    return rows.repartition(cores) if few else rows


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored page files, one page per file; the path stands for the URL."""
    return _fetched(spark.read.format("binaryFile").load(path))


def _fetched(files: DataFrame) -> DataFrame:
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), "content",
        F.lit(200).alias("http_code"), F.lit(None).cast("string").alias("content_type"),
    )


def stream_page_files(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """Page files as they arrive below a folder, one page per file.  The driver lists and remembers
    every file: for millions of pages use packs."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    )
    return _fetched(files.load(path))


def write_page_packs(files: DataFrame, path: str) -> None:
    """Many page files (``FILE_SCHEMA``) in each file below a folder, in small row groups, since
    the pages of a row group are read together."""
    names = [name.split()[0] for name in FILE_SCHEMA.split(", ")]
    files.select(*names).write.mode("append").option("parquet.block.size", PACK_GROUP).parquet(path)


def stream_page_packs(spark: SparkSession, path: str, packs_per_batch: int = 1_000) -> DataFrame:
    """Page files as they arrive in packs.

    The driver lists files and keeps those it has seen: with packs that is one entry for
    thousands of pages, with ``stream_page_files`` one for every page.
    """
    packs = spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", packs_per_batch)
    return _fetched(packs.parquet(path))


def landed(fetched: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Fetched rows, gated and decoded in one pass: ``refused`` with its ``reason`` and without a
    text, or ``html`` with its ``charset``.  Written by ``refused``, they are two tables."""
    gated = gate(fetched, max_bytes=max_bytes).withColumn("refused", F.col("reason").isNotNull())
    kept = gated.withColumn("content", F.when(~F.col("refused"), F.col("content")))
    charset = F.when(~F.col("refused"), F.col("charset")).alias("charset")
    return decode_pages(kept).select("page_id", "url", "reason", charset, "html", "refused")


def response_headers(lines: Column) -> Column:
    """Header lines as a map: names lower-cased, the last value of a name wins."""
    pairs = F.transform(
        F.filter(lines, lambda h: h.contains(":")),
        lambda h: F.struct(
            F.lower(trim(F.regexp_extract(h, "^([^:]*):", 1))).alias("key"),
            trim(F.regexp_replace(h, "(?s)^[^:]*:", "")).alias("value"),
        ),
    )
    names = F.transform(F.reverse(pairs), lambda p: p["key"])
    last = F.filter(F.reverse(pairs), lambda p, i: F.array_position(names, p["key"]) == i + 1)
    return F.map_from_entries(last)


def gate_reason(
    status: Column, content_type: Column, size: Column, max_bytes: int = MAX_BYTES
) -> Column:
    """Why a fetched page is not analysed, the first check that fails; NULL if none."""
    main_type = F.lower(trim(F.get(F.split(content_type, ";"), 0)))
    return (
        F.when(
            ~status.between(200, 399),
            F.concat(
                F.lit("HTTP status "), status.cast("string"),
                F.lit(" indicates the page could not be retrieved successfully"),
            ),
        )
        .when(
            ~is_blank(content_type) & ~main_type.isin(*CONTENT_TYPES),
            F.concat(
                F.lit("Content type '"), main_type, F.lit("' is not supported for analysis")
            ),
        )
        .when(
            size > max_bytes,
            F.concat(
                F.lit("Content too large ("), size.cast("string"),
                F.lit(f" bytes). Maximum allowed: {max_bytes} bytes"),
            ),
        )
        .when(size == 0, "Failed to retrieve content from the URL.")
    )


def gate(
    fetched: DataFrame, content: str = "content", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``fetched`` with ``reason``; filter on NULL for the pages to analyse."""
    size = F.octet_length(content).cast("long")
    return fetched.withColumn(
        "reason", gate_reason(F.col("http_code"), F.col("content_type"), size, max_bytes)
    )


def decode_pages(fetched: DataFrame, other_charsets: bool = True) -> DataFrame:
    """``content`` bytes as ``html`` text, with the ``charset`` used."""
    charset = fetched.withColumn(
        "charset", detect_charset(F.col("content"), F.col("content_type"))
    )
    return charset.withColumn(
        "html", to_utf8(F.col("content"), F.col("charset"), other_charsets)
    ).drop("content")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """``line`` as created_at, level, message, context; other lines are left out."""
    rest = [c for c in lines.columns if c != "line"]
    return (
        lines.withColumn("_p", parse_log_line(F.col("line")))
        .filter(F.col("_p").isNotNull())
        .select(*rest, "_p.*")
    )
