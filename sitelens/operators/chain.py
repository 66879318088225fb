"""The limit of one as a chain of pointers.

With one admission per window, the request admitted after the one at ``at`` is the
first at or after ``at + window``: a pointer that depends on nothing else.  What is
admitted is what the first request of a key reaches.  Pointers are doubled: one join gives
the pointers over 2, 4, 8, ... admissions, and the set reached doubles with each, so a chain
of n admissions takes log2(n) rounds, whatever the number of rows or keys.  Joins are
on (key, time), which is unique, so a hot key is spread like any other.
"""

from pyspark.sql import DataFrame, functions as F

from ..plans.shared import shared_dir
from .running import latest_before

def next_after(instants: DataFrame, window: int) -> DataFrame:
    """``instants`` (key, at; distinct) with ``then``: the first instant of the key at or
    after ``at + window``, or null."""
    # The as-of lookup runs on mirrored time: the greatest -at at or before -(at + window).
    mirrored = instants.select(
        "key",
        F.explode(
            F.array(
                F.struct((-F.col("at")).alias("t"), (-F.col("at")).alias("value"), F.lit(None).cast("bigint").alias("asked")),
                F.struct((-F.col("at") - window).alias("t"), F.lit(None).cast("bigint").alias("value"), F.col("at").alias("asked")),
            )
        ).alias("e"),
    ).select("key", "e.*")
    found = latest_before(mirrored, ["key"], "t", "value", "mirrored", cell=max(window, 1))
    return found.filter("asked IS NOT NULL").select("key", F.col("asked").alias("at"), (-F.col("mirrored")).alias("then"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reached(starts: DataFrame, pointers: DataFrame, folder: str) -> DataFrame:
    """(key, at) of all that ``starts`` (key, at) reach by ``pointers`` (key, at, then)."""
    levels = [_stored(pointers.filter("then IS NOT NULL").select("key", "at", "then"), f"{folder}/jumps-0")]
    while not levels[-1].isEmpty():
        one = levels[-1]
        again = one.select("key", F.col("at").alias("then"), F.col("then").alias("last"))
        doubled = one.join(again, ["key", "then"]).select("key", "at", F.col("last").alias("then"))
        levels.append(_stored(doubled, f"{folder}/jumps-{len(levels)}"))
    # From the longest jumps to the shortest, the set reached doubles with each.
    done = starts.select("key", "at")
    for jumps in reversed(levels[:-1]):
        both = done.join(jumps, ["key", "at"], "left").select("key", F.array_compact(F.array("at", "then")).alias("ats"))
        done = both.select("key", F.explode("ats").alias("at"))
    return done


def admit_one(requests: DataFrame, window: int, earlier: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """``requests`` (key, at, id) with ``admitted``: one in each window of a key.

    Of one instant the smallest id counts.  ``earlier`` (key, at) holds admissions made before; a key's
    first request is then the first that they leave free.  Requests without key or time
    are not admitted.
    """
    folder = folder or shared_dir(requests.sparkSession, "chain")
    known = F.col("key").isNotNull() & F.col("at").isNotNull()
    rows = requests.select("key", "at", "id")
    firsts = rows.filter(known).groupBy("key", "at").agg(F.min("id").alias("first"))
    firsts = _stored(firsts, f"{folder}/instants")
    instants = firsts.select("key", "at")
    starts = instants
    if earlier is not None:
        last = earlier.groupBy("key").agg(F.max("at").alias("last"))
        starts = instants.join(last, "key", "left").filter(F.col("last").isNull() | (F.col("at") >= F.col("last") + window))
    starts = starts.groupBy("key").agg(F.min("at").alias("at"))
    admitted = reached(starts, next_after(instants, window), folder)
    chosen = firsts.join(admitted, ["key", "at"]).select("key", "at", F.col("first").alias("id"), F.lit(True).alias("admitted"))
    decided = rows.join(chosen, ["key", "at", "id"], "left")
    return decided.withColumn("admitted", F.coalesce("admitted", F.lit(False)))
