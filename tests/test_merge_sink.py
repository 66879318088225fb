"""The merging upsert sink: last commit, repeated batches, untouched partitions."""

import hashlib
import os

from pyspark.sql import functions as F

from sitelens.streaming import streams as T

SCHEMA = "id long, cache_key string, created_at timestamp, body string"


def test_merge_sink(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [(i, f"k{i % 40}", i, f"first {i}") for i in range(80)],
        [(100 + i, f"k{i}", 200, f"second {i}") for i in range(3)] + [(90, "k5", 1, "too old")],
        [(300, "new", 300, "third"), (301, "k0", 300, "third")],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "id long, cache_key string, s long, body string")
        df = df.select("id", F.sha1("cache_key").alias("cache_key"), F.timestamp_seconds("s").alias("created_at"), "body")
        df.coalesce(1).write.mode("append").parquet(source)
    stream = T.read_stream(spark, source, SCHEMA, files_per_batch=1)
    T.run_available(T.write_merged(stream, out, parts=8), str(tmp_path / "cp"))
    newest = {}
    for i, key, s, body in sorted((r for b in batches for r in b), key=lambda r: (r[2], r[0])):
        newest[hashlib.sha1(key.encode()).hexdigest()] = (i, body)

    def content():
        return {r.cache_key: (r.id, r.body) for r in T.read_merged(spark, out, stream.schema).collect()}

    assert content() == newest
    files = T.read_merged(spark, out, stream.schema).inputFiles()
    parts = [f.split("/part=")[1].split("/")[0] for f in files]
    assert len(parts) == len(set(parts)) <= 8
    # The last batch holds two keys and has rewritten no more than their partitions.
    assert len([p for p in os.listdir(f"{out}/data/version=2") if p.startswith("part=")]) <= 2
    # A batch that is repeated after a failure changes nothing.
    T.run_available(T.write_merged(stream, out, parts=8), str(tmp_path / "cp2"))
    assert content() == newest
    assert T._versions(spark, out, 1) and max(T._versions(spark, out).values()) == 2
