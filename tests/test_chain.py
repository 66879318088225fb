"""The limit of one by pointer doubling, against the plain loop."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from sitelens.operators import cache as C
from sitelens.operators import chain


def loop(rows, window, last=()):
    """Ids admitted, one after the other."""
    last, out = dict(last), set()
    for key, at, i in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in last or at >= last[key] + window:
            last[key] = at
            out.add(i)
    return out


@pytest.mark.parametrize("window, span", [(10, 400), (1, 50), (1_000, 900), (7, 100_000)])
def test_equals_the_loop(spark, tmp_path, window, span):
    rng = random.Random(window)
    rows = [(rng.choice(["hot"] * 3 + list("abcdef") + [None]), rng.choice([rng.randrange(-span, span), None if i % 50 == 0 else 5]), i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint")
    folder = str(tmp_path / "one")
    got = chain.admit_one(df, window, folder=folder).collect()
    assert len(got) == len(rows) and {r.id for r in got if r.admitted} == loop(rows, window)
    # Rounds follow the longest chain, not the rows.
    rounds = sum(1 for name in os.listdir(folder) if name.startswith("jumps-"))
    assert rounds <= math.log2(2 * span / window + 2) + 3
    last = [("hot", -span // 2), ("a", span), ("z", 0)]
    earlier = spark.createDataFrame(last, "key string, at bigint")
    late = [r for r in rows if r[0] not in ("hot", "a") or r[1] is None or r[1] >= dict(last)[r[0]]]
    got = chain.admit_one(df, window, earlier).join(spark.createDataFrame([(r[2],) for r in late], "id bigint"), "id").collect()
    assert {r.id for r in got if r.admitted} == loop(late, window, last)


def test_a_key_with_a_third_of_the_rows(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5_000)).alias("key"),
        (F.col("id") * 7 % n).alias("at"), "id",
    )
    folder = str(tmp_path / "hot")
    got = {r.id for r in chain.admit_one(rows, 60, folder=folder).filter("admitted").collect()}
    assert got == loop([tuple(r) for r in rows.collect()], 60)
    assert sum(1 for name in os.listdir(folder) if name.startswith("jumps-")) <= math.log2(n / 60) + 3


def test_no_python_and_no_rows_lost(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "a", None), (3, "a", 5), (4, "a", 6)], "id bigint, cache_key string, s bigint")
    df = df.select("id", "cache_key", F.timestamp_seconds("s").alias("created_at"))
    replayed = C.cache_replay(df, 100)
    assert {r.id: r.hit for r in replayed.collect()} == {1: False, 2: False, 3: False, 4: True}
    plan = replayed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    empty = chain.admit_one(df.limit(0).selectExpr("cache_key AS key", "id AS at", "id"), 5)
    assert empty.collect() == []
