"""Running totals over time for keys of any size.

A plain window function sorts all rows of a key in one task.  Here time is cut into
cells: rows are reduced per (key, cell), the cell values are accumulated per key, and
a window function over rows runs only inside one cell.  A key that holds a third of
the table is spread over as many tasks as it has cells.  What one task sees of a key
is the rows of one cell, or one value per cell of the covered time (half a million
for a year of minutes), however many rows there are.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

CELL = 60 * 1_000_000


def floor_to(at: Column, step: int) -> Column:
    """Start of the step ``at`` (BIGINT) lies in."""
    return at - F.pmod(at, F.lit(step))


def _over_time(
    rows: DataFrame, keys: list[str], at: str, value: str, out: str, cell: int, reduce, merge
) -> DataFrame:
    """``reduce(value)`` over all rows of a key at or before ``at``; ``merge`` joins the
    result for earlier cells with that inside the cell."""
    rows = rows.withColumn("_cell", floor_to(F.col(at), cell))
    earlier = Window.partitionBy(*keys).orderBy("_cell")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_cell").agg(reduce(F.col(value)).alias("_value"))
    carried = cells.select(*keys, "_cell", reduce(F.col("_value")).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(at)
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(carried, [*keys, "_cell"])
    here = reduce(F.col(value)).over(inside)
    return joined.withColumn(out, merge(F.col("_carried"), here)).drop("_cell", "_carried")


def running_sum(
    rows: DataFrame, keys: list[str], at: str, value: str, out: str, cell: int = CELL
) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over all rows of the same key at or
    before ``at`` (BIGINT).  Rows of the same instant get the same sum."""
    return _over_time(
        rows, keys, at, value, out, cell, F.sum,
        lambda before, here: F.coalesce(before, F.lit(0)) + here,
    )


def latest_before(
    rows: DataFrame, keys: list[str], at: str, value: str, out: str, cell: int = CELL
) -> DataFrame:
    """``rows`` with ``out``: the greatest non-null ``value`` of the same key at or
    before ``at``.  With a value that grows with time this is an as-of join."""
    return _over_time(
        rows, keys, at, value, out, cell, F.max, lambda before, here: F.coalesce(here, before)
    )
