"""A stream in several batches gives what the batch operator gives on all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelens.operators import pages as P
from sitelens.operators.admission import replay
from sitelens.functions.values import micros
from sitelens.streaming import streams as T

START = datetime(2024, 1, 1)
SCHEMA = "key string, created_at timestamp, id long"


@pytest.fixture
def folder(spark, tmp_path):
    """Five files in time order, one key with half of the rows."""
    rng = random.Random(8)
    times = sorted(rng.randrange(30_000) for _ in range(1_000))
    rows = [
        (rng.choice(["hot"] * 5 + list("abcde")), START + timedelta(seconds=t), i)
        for i, t in enumerate(times)
    ]
    for n in range(5):
        part = spark.createDataFrame(rows[n * 200 : (n + 1) * 200], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), tmp_path


@pytest.mark.parametrize("max_session", [1_000_000, 20])
def test_admission_in_batches(spark, folder, max_session):
    path, tmp = folder
    stream = T.read_stream(spark, path, SCHEMA, files_per_batch=1)
    out = str(tmp / "out")
    T.run_available(T.write_replay(stream, out, 4, 3_600, max_session=max_session), str(tmp / "cp"))
    got = {r.id: r.admitted for r in T.read_decisions(spark, out).collect()}
    keyed = spark.read.schema(SCHEMA).parquet(path).select(
        "key", micros(F.col("created_at")).alias("at"), "id"
    )
    assert got == {r.id: r.admitted for r in replay(keyed, 4, 3_600_000_000).collect()}
    assert len(got) == 1_000
    state = spark.read.parquet(out + "/state/batch=4")
    assert state.groupBy("key").count().agg(F.max("count")).first()[0] <= 4


def test_counts_and_first_sightings(spark, folder):
    path, tmp = folder
    stream = T.read_stream(spark, path, SCHEMA, files_per_batch=2)
    counts = T.request_counts(stream.withColumnRenamed("key", "ip_address"))
    writer = counts.writeStream.format("parquet").option("path", str(tmp / "counts"))
    T.run_available(writer, str(tmp / "cp1"))
    got = spark.read.schema(counts.schema).parquet(str(tmp / "counts")).collect()
    rows = spark.read.schema(SCHEMA).parquet(path).collect()
    assert got
    for r in got[::50]:
        assert r.request_count == sum(
            1 for x in rows if x.key == r.ip_address and r.start <= x.created_at < r.end
        )
    firsts = T.first_sightings(stream.withColumnRenamed("key", "cache_key"))
    writer = firsts.writeStream.format("parquet").option("path", str(tmp / "firsts"))
    T.run_available(writer, str(tmp / "cp2"))
    seen = spark.read.schema(firsts.schema).parquet(str(tmp / "firsts"))
    assert seen.select("cache_key").distinct().count() == 6


def test_pages_and_upserts(spark, tmp_path):
    schema = "page_id long, url string, html string"
    for n in range(3):
        rows = [(n * 10 + i, f"http://x.example/{i}", f"<title>v{n} p{i}</title>") for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pages = T.read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    analyses = T.page_analysis(pages)
    writer = analyses.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    T.run_available(writer, str(tmp_path / "cp1"))
    done = spark.read.schema(analyses.schema).parquet(str(tmp_path / "out"))
    batch = P.analyze(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    assert sorted(r.analysis for r in done.collect()) == sorted(r.analysis for r in batch.collect())

    entries = analyses.select(
        F.col("page_id").alias("id"), "cache_key", "url",
        F.timestamp_seconds(F.col("page_id")).alias("created_at"), "analysis",
    )
    T.run_available(T.write_cache(entries, str(tmp_path / "cache")), str(tmp_path / "cp2"))
    newest = T.read_cache(spark, str(tmp_path / "cache"))
    assert sorted(r.analysis.meta.title for r in newest.collect()) == [f"v2 p{i}" for i in range(4)]
    T.compact_cache(spark, str(tmp_path / "cache"), str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 4
