"""Connected components of a graph of links, by alternating star operations.

Every round first joins the larger neighbours of a node to its smallest one, then the
node and its smaller neighbours to the smallest; the number of rounds is logarithmic
in practice.  Each round is written to the shared folder, which cuts the lineage.
"""

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import join_unique

MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b) with a < b, after one star operation on ``edges``."""
    # Only towards smaller neighbours: u is the larger end.
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # A hot node is split.
    joined = join_unique(both, least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select("m", "v")
    else:
        ends = F.array("v", "u")
        moved = joined.select("m", F.explode(ends).alias("v"))
    return moved.filter("m != v").select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller neighbour, which has none: the edges are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("larger"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("larger")))
    found = ends.groupBy("node").agg(F.min("larger").alias("least"), F.sum("larger").alias("n"))
    return found.filter("n > 1 OR (least = 0 AND n > 0)").isEmpty()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: bigint); the smallest node names it.

    Repeated links, links in both directions and links of a node to itself are fine;
    links with a null end are ignored; without links the result is empty.
    """
    spark = links.sparkSession
    schema = "a bigint, b bigint"
    edges = links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges.write.parquet(f"{folder}/0")
    edges = spark.read.schema(schema).parquet(f"{folder}/0")

    for i in range(1, MAX_ROUNDS):
        if _settled(edges):
            break
        for large in (True, False):
            path = f"{folder}/{i}-{'large' if large else 'small'}"
            _star(edges, large).write.parquet(path)
            edges = spark.read.schema(schema).parquet(path)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
