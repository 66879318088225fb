"""Replay of a limit in time order: only admitted requests count towards later ones.

A request is admitted when fewer than ``limit`` requests of its key were admitted in
the ``window`` before it.  Each decision depends on earlier ones, so the work is cut
where it does not: a key's requests are split at every empty window, since nothing
before an empty window can still count.  The pieces ("sessions") are then handled by
size, all with the same result:

- up to ``limit`` requests: all are admitted;
- up to ``max_session``: folded in order, streaming over sorted partitions with at
  most ``limit`` times of state;
- longer: window by window, all such sessions side by side.  Inside one window every
  place freed is known from the window before, and the number admitted so far is a running minimum,
  ``A(n) = n + min(0, min over m <= n of (places freed by m) - m)``, which is
  computed like a running sum over time cells (see ``running``).  A hot key is thus
  spread over many tasks; only its windows follow one another.
"""

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.shared import shared_dir
from .running import floor_to

MAX_SESSION = 5_000_000
CELLS_PER_WINDOW = 3_600


def _fold(limit: int, window: int):
    def run(batches):
        session, recent = None, deque()
        for pdf in batches:
            admitted = []
            for key, start, at, known in zip(
                pdf["key"].array, pdf["session"].array, pdf["at"].array, pdf["known"].array
            ):
                if (key, start) != session:
                    session = (key, start)
                    recent.clear()
                while recent and recent[0] <= at - window:
                    recent.popleft()
                ok = bool(known) or len(recent) < limit
                if ok:
                    recent.append(at)
                admitted.append(ok)
            pdf = pdf.assign(admitted=pd.Series(admitted, index=pdf.index, dtype=bool))
            yield pdf.loc[~pdf["known"], ["key", "at", "id", "admitted"]]

    return run


def _sessions(rows: DataFrame, window: int) -> DataFrame:
    """Size of the session each (key, window) belongs to."""
    counts = rows.groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"))
    by_time = Window.partitionBy("key").orderBy("w")
    starts = counts.withColumn(
        "start", F.when(F.coalesce(F.col("w") - F.lag("w").over(by_time) > window, F.lit(True)), F.col("w"))
    )
    named = starts.withColumn(
        "session",
        F.max("start").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    size = F.sum("n").over(Window.partitionBy("key", "session"))
    return named.select("key", "w", "session", size.alias("size"))


def _one_window(requests: DataFrame, taken: DataFrame, limit: int, window: int) -> DataFrame:
    """The admitted requests of one window (starting at ``w``) of each session.

    ``taken`` are earlier admissions that still count after the window's start.
    """
    cell = max(window // CELLS_PER_WINDOW, 1)
    session = ["key", "session"]
    # Of one instant no more than ``limit`` can be admitted, the first by id.
    tied = Window.partitionBy(*session, "at").orderBy("id")
    requests = requests.withColumn("_rank", F.row_number().over(tied)).filter(
        F.col("_rank") <= limit
    )
    freed = taken.filter(F.col("at") > F.col("w") - window)
    in_use = freed.groupBy(*session).agg(F.count(F.lit(1)).alias("used"))
    returns = freed.filter(F.col("at") < F.col("w")).withColumn("at", F.col("at") + window)
    steps = (
        requests.select(*session, "w", "at", "id", F.lit(1).alias("request"))
        .unionByName(returns.withColumn("request", F.lit(0)), allowMissingColumns=True)
        .withColumn("cell", floor_to(F.col("at") - F.col("w"), cell))
    )
    inside = Window.partitionBy(*session, "cell").orderBy("at", "request", "id")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    change = 1 - 2 * F.col("request")
    level = F.when(F.col("request") == 1, F.sum(change).over(upto))
    local = steps.withColumn("level", level)
    local = local.withColumn("low", F.min("level").over(prior))

    cells = local.groupBy(*session, "cell").agg(
        F.sum(change).alias("change"), F.min("level").alias("low")
    )
    by_cell = Window.partitionBy(*session).orderBy("cell")
    by_cell = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cells.join(in_use, session, "left")
        .withColumn("free", F.lit(limit) - F.coalesce("used", F.lit(0)))
        .withColumn("base", F.col("free") + F.coalesce(F.sum("change").over(by_cell), F.lit(0)))
        .withColumn("floor", F.min(F.col("base") + F.col("low")).over(by_cell))
        .select(*session, "cell", "base", "floor")
    )
    placed = local.filter("request = 1").join(carried, [*session, "cell"])
    lowest = F.least(F.lit(0), F.col("floor"), F.col("base") + F.col("low"))
    return placed.filter(F.col("base") + F.col("level") >= lowest).select(
        *session, "w", "at", "id"
    )


def _window_by_window(rows: DataFrame, limit: int, window: int) -> DataFrame:
    """Decisions for long sessions.

    Step n decides window n of every long session at once, so there are as many steps
    as the longest session has windows.  Rows and admissions live in the shared
    folder, one partition per step, and a step reads only its own and the last one.
    """
    spark = rows.sparkSession
    root = shared_dir(spark, "admission")
    numbered = rows.withColumn("step", ((F.col("w") - F.col("session")) / window).cast("int"))
    columns = ["key", "session", "w", "at", "id"]
    numbered.select(*columns, "known", "step").write.partitionBy("step").parquet(f"{root}/rows")
    stored = spark.read.schema(
        numbered.select(*columns, "known", "step").schema
    ).parquet(f"{root}/rows")
    schema = stored.select(*columns).schema
    # The longest session in windows: bounded by the time covered, not by the rows.
    last = stored.agg(F.max("step")).first()[0]
    paths = []
    for step in range(last + 1):
        mine = stored.filter(F.col("step") == step)
        before = stored.filter((F.col("step") == step - 1) & F.col("known")).select(*columns)
        if paths:
            before = before.unionByName(spark.read.schema(schema).parquet(paths[-1]))
        taken = before.withColumn("w", F.col("w") + window).unionByName(
            mine.filter("known").select(*columns)
        )
        paths.append(f"{root}/admitted/step={step}")
        decided = _one_window(mine.filter("not known"), taken.drop("id"), limit, window)
        decided.write.parquet(paths[-1])
    admitted = spark.read.schema(schema).parquet(*paths).select("key", "at", "id")
    asked = stored.filter("not known").select("key", "at", "id")
    return asked.join(
        admitted.withColumn("admitted", F.lit(True)), ["key", "at", "id"], "left"
    ).fillna(False, ["admitted"])


def replay(
    requests: DataFrame,
    limit: int,
    window: int,
    earlier: DataFrame | None = None,
    max_session: int = MAX_SESSION,
) -> DataFrame:
    """``requests`` (key, at, id) with ``admitted``.

    ``at`` and ``window`` are in the same unit (BIGINT); requests of a key are taken
    in order of ``at``, then ``id`` (unique).  ``earlier`` (key, at) holds admissions
    decided before, for instance by the previous batch of a stream; they precede all
    requests of their key.
    """
    rows = requests.select("key", "at", "id", F.lit(False).alias("known"))
    if earlier is not None:
        rows = rows.unionByName(
            earlier.select("key", "at", F.lit(True).alias("known")), allowMissingColumns=True
        )
    rows = rows.withColumn("w", floor_to(F.col("at"), window))
    sessions = _sessions(rows, window)
    sized = rows.join(sessions, ["key", "w"])

    free = sized.filter((F.col("size") <= limit) & ~F.col("known")).select(
        "key", "at", "id", F.lit(True).alias("admitted")
    )
    limited = sized.filter((F.col("size") > limit) & (F.col("size") <= max_session))
    schema = requests.select("key", "at", "id").schema.simpleString()[7:-1]
    folded = (
        limited.select("key", "session", "at", "id", "known")
        .repartition("key", "session")
        .sortWithinPartitions("key", "session", "at", F.col("known").desc(), "id")
        .mapInPandas(_fold(limit, window), schema=f"{schema},admitted:boolean")
    )
    out = free.unionByName(folded)
    long_sessions = sessions.filter(F.col("size") > max_session)
    if long_sessions.limit(1).count():
        hot = sized.filter(F.col("size") > max_session)
        out = out.unionByName(_window_by_window(hot, limit, window))
    return out
