"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Rows of a file that a round writes; a small rest of edges takes one small job a step.
FILE_ROWS = 500_000


def _star(edges: DataFrame, mins: DataFrame) -> DataFrame:
    """Hangs the far end ``v`` of each edge (u, v) on the least neighbour of ``u``, if it has a smaller one.

    The minima are a written table: both sides of the join are then plain shuffles, and Spark splits
    the partition of a node that has a large part of all edges.
    """
    mins = mins.withColumnRenamed("u", "w")
    return edges.join(mins, F.col("u") == F.col("w"), "left").select("v", F.coalesce("m", "u").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only, and no node that others hang on hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs > 1 or hangs > 0 and holds > 0").isEmpty()


def connected_components(edges: DataFrame, tables: Scratch, name: str = "cc") -> DataFrame:
    """node and component (its least reachable node, itself included) for all nodes of an edge.

    ``edges`` has two columns of one integer type; loops, repeated edges and edges with a null end
    don't matter (a null end is no node; a node that has only loops isn't returned). Every round is
    written to the shared folder; nothing but a count of the edges gets to the driver.
    """
    a, b = edges.columns
    own = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    own, k = tables.put(own, f"{name}-0"), 0
    while not _stars(own):
        k += 1
        files = 1 + 2 * own.count() // FILE_ROWS
        put = lambda df, part: tables.put(df.coalesce(files), f"{name}-{k}{part}")  # noqa: B023, E731
        # large-star: the larger neighbours of each node get its least neighbour, or itself
        away = own.select(F.col("v").alias("u"), F.col("u").alias("v"))
        mins = put(own.unionAll(away).groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "-large-min")
        large = put(_star(away, mins).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "-large")
        # small-star: a node and its smaller neighbours get the least of these
        mins = put(large.groupBy("u").agg(F.min("v").alias("m")), "-small-min")
        out = _star(large, mins).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = put(out.unionAll(mins.select("u", F.col("m").alias("v"))).distinct(), "")
        for old in (f"{name}-{k - 1}", *(f"{name}-{k}{part}" for part in ("-large-min", "-large", "-small-min"))):
            tables.drop(old)
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
