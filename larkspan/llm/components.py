"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Each edge with the lowest ``b`` of its ``a``, summed up before the shuffle."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "of")
    return edges.join(lowest, F.col("a") == F.col("of")).select("a", "b", "low")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    return (
        _lowest(both.toDF("a", "b"))
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger ``a`` to the smaller ``b``, before and after."""
    near = _lowest(edges)
    onward = near.filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return near.select("a", F.col("low").alias("b")).union(onward).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge ``a, b``; the root is the lowest node.

    Large and small stars in turn (Kiveris et al. 2014) until the edges stay as they
    are: then each node but the root has one edge, to its root. Every round is written
    to the shared folder; only two numbers a round come to the driver. A node with many
    neighbours is a hot key of a join, which Spark splits, and of a minimum, which is
    taken before the shuffle. Loops and repeated edges are allowed.
    """
    edges = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(state) or state[0] == 0:
            break
        seen = tuple(state)
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
