"""Keyed state over several batches with late rows gives what the batch operator gives."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from sitelens.streaming import keyed as K
from sitelens.streaming import streams as T

START = datetime(2024, 1, 1)
SCHEMA = "key string, created_at timestamp, id long"


def loop(rows, limit, window):
    taken, out = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [t for t in taken.get(key, []) if t > at - timedelta(seconds=window)]
        out[i] = len(live) < limit
        taken[key] = live + [at] * out[i]
    return out


@pytest.mark.parametrize("limit, window", [(3, 3_600), (1, 1_800)])
def test_batches_with_late_rows(spark, tmp_path, limit, window):
    rng = random.Random(limit)
    rows = [(rng.choice(["hot"] * 4 + list("abcdef")), START + timedelta(seconds=rng.randrange(40_000), microseconds=i), i) for i in range(900)]
    rows.append((None, START, 9_000))
    rows.append(("hot", START + timedelta(seconds=44_000), 9_001))
    # Up to ten minutes late, in six files one after the other.
    arriving = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(600)))
    for n in range(6):
        part = arriving[n * 151 : (n + 1) * 151] if n < 5 else arriving[5 * 151 :]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
    decided = K.admissions(stream, limit, window, "15 minutes")
    writer = decided.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    got = {r.id: r.admitted for r in spark.read.schema(K.DECISIONS).parquet(str(tmp_path / "out")).collect()}
    final = START + timedelta(seconds=44_000 - 900)
    want = loop([r for r in rows if r[0] is not None], limit, window)
    assert got == {i: ok for i, ok in want.items() if dict((r[2], r[1]) for r in rows)[i] <= final}
    assert len(sizes) >= 6 and len(got) == 900
    # All but the last request is decided and has expired.
    assert sizes[-1] < max(sizes) / 4


def test_state_is_called_for_buckets_not_for_keys(spark, tmp_path):
    """Thousands of keys share few states; the decisions are those of a plain loop."""
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(3_000)}", START + timedelta(seconds=rng.randrange(20_000), microseconds=i), i) for i in range(9_000)]
    rows.append(("end", START + timedelta(days=2), 9_999))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), SCHEMA)
    writer = K.admissions(stream, 1, 1_800, buckets=16).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.id: r.admitted for r in spark.read.schema(K.DECISIONS).parquet(str(tmp_path / "out")).collect()}
    want = loop(rows, 1, 1_800)
    assert got == {i: ok for i, ok in want.items() if i != 9_999}
    # Two lists and their timers for each bucket.
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 16 * 8


def windows_of(rows, window=3_600, slide=300):
    counts = {}
    for ip, at in rows:
        for start in range(at // slide * slide, at - window, -slide):
            counts[ip, start] = counts.get((ip, start), 0) + 1
    return counts


def test_window_counts_keep_slices_not_windows(spark, tmp_path):
    """Batches with rows that come late, without a time and without a key; the state has no row for each window."""
    rng, base = random.Random(3), int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
    sent = []
    for n in range(4):
        # Up to 50 minutes behind the newest time of the batches before.
        rows = [(rng.choice([None, "", *map(str, range(300))]), base + n * 6_000 + rng.randrange(-3_000, 6_000)) for _ in range(500)]
        sent += rows
        rows = [(ip, datetime.fromtimestamp(at, timezone.utc)) for ip, at in rows] + [("no time", None)]
        frame = spark.createDataFrame(rows, "ip_address string, created_at timestamp").coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
    counts = T.request_counts(stream)
    writer = counts.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(counts.schema).parquet(str(tmp_path / "out"))
    got = [((r.ip_address, r.s), r.request_count) for r in done.selectExpr("*", "unix_seconds(start) AS s").collect()]
    final = max(at for _, at in sent) - 3_600
    expected = {k: n for k, n in windows_of(sent).items() if k[1] + 3_600 <= final}
    assert len(got) == len(dict(got)) and dict(got) == expected
    assert done.filter("end != start + INTERVAL 1 HOUR").isEmpty()
    kept = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert 0 < kept < len(sent)


@pytest.mark.parametrize("window, slide", [("10 minutes", "10 minutes"), ("10 minutes", "4 minutes"), ("2 minutes", "5 minutes")])
def test_window_counts_of_any_length(spark, tmp_path, window, slide):
    rng, base = random.Random(5), 1_700_000_000
    sent = [(rng.choice("abc"), base + rng.randrange(4_000)) for _ in range(200)]
    rows = [(k, datetime.fromtimestamp(at, timezone.utc)) for k, at in sent]
    spark.createDataFrame(rows, "key string, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), "key string, created_at timestamp")
    writer = K.window_counts(stream, window, slide, "1 minute", buckets=2).writeStream.format("parquet")
    T.run_available(writer.option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    got = {(r.key, r.start // 10**6): r.n for r in spark.read.schema(K.COUNTS).parquet(str(tmp_path / "out")).collect()}
    length, step = int(window.split()[0]) * 60, int(slide.split()[0]) * 60
    final = max(at for _, at in sent) - 60
    assert got == {k: n for k, n in windows_of(sent, length, step).items() if k[1] + length <= final}
    assert got


def test_window_ends_exactly_at_the_watermark(spark, tmp_path, monkeypatch):
    """The watermark moves by a millisecond, onto the end of a window; frames are added up on the way."""
    monkeypatch.setattr(K.WindowCounts, "FRAME", 3)
    first = [START + timedelta(hours=11, minutes=m) for m in range(60)] * 3 + [START + timedelta(hours=13, milliseconds=-1)]
    for times in (first, [START + timedelta(hours=13)]):
        rows = [("a", t) for t in times]
        spark.createDataFrame(rows, "key string, created_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), "key string, created_at timestamp", files_per_batch=1)
    writer = K.window_counts(stream, "1 hour", "1 hour", "1 hour", buckets=1).writeStream.format("parquet")
    T.run_available(writer.option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    got = spark.read.schema(K.COUNTS).parquet(str(tmp_path / "out")).collect()
    assert [(r.key, r.n) for r in got] == [("a", 180)]
