"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import drop, durable

MOST_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the least of them; edges run from the larger node to the smaller."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
    return moved.select("x.a", "x.b").filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node of an edge (BIGINT ids) with the least node of its component: node, component.

    Alternates large and small stars until nothing changes, a number of rounds that grows with the logarithm of the longest path.
    A node's neighbours are never collected: only their minimum is, after a partial aggregation, so hubs need no special care. Each round
    is a table in the shared folder, which survives the loss of executors; only two numbers per round reach the driver.
    Self-links and repeated edges change nothing, edges with a null end are left out; no edges give no rows.
    """
    start = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    loops = start.filter("a = b").select("a").distinct()
    e = durable(start.filter("a <> b").distinct(), "edges")
    known = None
    for _ in range(MOST_ROUNDS):
        new = durable(_small_star(_large_star(e)), "stars")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop(e)
        e = new
        if state == known:
            break
        known = state
    else:
        raise RuntimeError("the components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").union(loops.select(F.col("a").alias("node"), F.col("a").alias("component")))
    return stars.union(roots).groupBy("node").agg(F.min("component").alias("component"))
