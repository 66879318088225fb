"""The append-only tables as streams.

Stateless and aggregating operators are ordinary streaming queries.  Operators whose
decisions depend on earlier ones (admission, time to live) run the batch operator on
every micro-batch and keep the admissions that still count in a small table next to
the output: at most ``limit`` rows per key, however hot the key is.  Each batch reads
the state written by the batch before it and overwrites its own folder, so a batch
repeated after a failure gives the same result.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.urls import cache_key
from ..functions.values import from_micros, micros
from ..operators.admission import MAX_SESSION, replay
from ..operators.cache import TTL_SECONDS, latest_entries
from ..operators.pages import analyze
from .keyed import window_counts

SECOND = 1_000_000


def read_stream(
    spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int = 1_000
) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def request_counts(
    requests: DataFrame, window: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour"
) -> DataFrame:
    """Requests per address in sliding windows; a window is final ``late`` after its end.

    The state has a row for each address and slide, not for each window (``keyed.window_counts``)."""
    timed = requests.select(F.col("ip_address").alias("key"), F.col("created_at").cast("timestamp"))
    return window_counts(timed, window, slide, late).select(
        F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"),
        F.col("key").alias("ip_address"), F.col("n").alias("request_count"),
    )


def first_sightings(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Requests (cache_key, created_at) whose key was not seen within about a time to
    live.  State is dropped by watermark, so the edge is approximate; ``write_replay``
    with a limit of one is exact."""
    timed = requests.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(
        ["cache_key"]
    )


def page_analysis(pages: DataFrame, **options) -> DataFrame:
    """Analysis records of arriving pages, with their cache key."""
    return analyze(pages.withColumn("cache_key", cache_key(F.col("url"))), **options)


def write_replay(
    requests: DataFrame,
    out: str,
    limit: int,
    window_seconds: int,
    late_seconds: int = 0,
    max_session: int = MAX_SESSION,
) -> DataStreamWriter:
    """Admission decisions for a stream of requests (key, created_at, id).

    Decisions go to ``out/decisions``, one folder per batch.  Admissions are kept for
    the window plus ``late_seconds``, for keys that lag behind the newest time.
    """
    window = window_seconds * SECOND

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.select("key", micros(F.col("created_at")).alias("at"), "id")
        earlier = None
        if batch_id:
            schema = keyed.select("key", "at").schema
            earlier = spark.read.schema(schema).parquet(f"{out}/state/batch={batch_id - 1}")
        decided = replay(keyed, limit, window, earlier, max_session)
        decided.write.mode("overwrite").parquet(f"{out}/decisions/batch={batch_id}")
        done = spark.read.schema(decided.schema).parquet(f"{out}/decisions/batch={batch_id}")
        live = done.filter("admitted").select("key", "at")
        if earlier is not None:
            live = live.unionByName(earlier)
        newest = live.agg(F.max("at")).scalar()
        live = live.filter(F.col("at") > newest - (window + late_seconds * SECOND))
        live.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")

    return requests.writeStream.foreachBatch(decide)


def read_decisions(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(f"{out}/decisions")
    return rows.select("key", "id", from_micros(F.col("at")).alias("created_at"), "admitted")


def write_cache(entries: DataFrame, out: str) -> DataStreamWriter:
    """Upsert sink: the newest entry per key of each batch goes to its own folder;
    ``read_cache`` merges them when reading, ``compact_cache`` for good."""

    def save(batch: DataFrame, batch_id: int) -> None:
        latest_entries(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return entries.writeStream.foreachBatch(save)


def read_cache(spark: SparkSession, out: str) -> DataFrame:
    return latest_entries(spark.read.parquet(out).drop("batch"))


def compact_cache(spark: SparkSession, out: str, target: str) -> None:
    read_cache(spark, out).write.parquet(target)


#: Key-hash partitions of a merged cache.
PARTS = 32


def _versions(spark: SparkSession, out: str, before: int | None = None) -> dict[int, int]:
    """The version each partition is at, in the newest commit (before a batch): at most one a partition."""
    commits = spark.read.schema("part int, version bigint, batch bigint").parquet(f"{out}/versions")
    if before is not None:
        commits = commits.filter(F.col("batch") < before)
    newest = commits.agg(F.max("batch").alias("batch"))
    return {r.part: r.version for r in commits.join(newest, "batch").collect()}


def _version_paths(out: str, versions: dict[int, int]) -> list[str]:
    return [f"{out}/data/version={v}/part={p}" for p, v in sorted(versions.items())]


def write_merged(entries: DataFrame, out: str, parts: int = PARTS) -> DataStreamWriter:
    """Upsert sink that merges when it writes.

    Entries are partitioned by a hash of their key.  A batch rewrites only the
    partitions it touches, as a version of its own, and then commits which version each
    partition is at.  Readers see the last commit; a batch that is repeated starts from the
    commit before it and writes the same again.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = _versions(spark, out, batch_id) if batch_id else {}
        part = F.pmod(F.xxhash64("cache_key"), F.lit(parts)).cast("int")
        rows = latest_entries(batch)
        touched = [r.part for r in rows.select(part.alias("part")).distinct().collect()]
        older = _version_paths(out, {p: current[p] for p in touched if p in current})
        if older:
            rows = latest_entries(rows.unionByName(spark.read.schema(rows.schema).parquet(*older)))
        rows = rows.withColumn("part", part)
        # One task, hence one file, for each partition.
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/data/version={batch_id}")
        commit = list((current | {p: batch_id for p in touched}).items())
        table = spark.createDataFrame(commit, "part int, version bigint").coalesce(1)
        table.write.mode("overwrite").parquet(f"{out}/versions/batch={batch_id}")

    return entries.writeStream.foreachBatch(save)


def read_merged(spark: SparkSession, out: str, schema) -> DataFrame:
    """The entries as of the last commit, one row for each key; nothing is merged here."""
    paths = _version_paths(out, _versions(spark, out))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what has arrived, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
