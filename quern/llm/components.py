"""Connected components by alternating large-star and small-star rounds.

Every round is two partial aggregations and two joins over an edge table that
is cut into the shared checkpoint folder.  Hub nodes are joined, never
gathered, so adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node around it."""
    sides = _both_ways(edges)
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return sides.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that isn't its component's least.

    Self-loops and edges with a null end are ignored; repeated edges count
    once; an empty edge table gives an empty result.  Rounds grow with the
    logarithm of the longest chain.
    """
    found = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a > b").distinct()
    found = checkpoint(found)
    mark = _mark(found)
    while mark[0]:
        found = checkpoint(_small_star(_large_star(found)))
        now = _mark(found)
        if now == mark:
            break
        mark = now
    return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
