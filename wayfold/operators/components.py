"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.sources.checkpoints import cut


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("u").alias("_u")).agg(F.least(F.col("_u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, u: str, v: str, *, most_rounds: int = 60) -> DataFrame:
    """``node, root``: for every node that is not the smallest of its component, the smallest one.

    Nodes are comparable and not null; edges without one end, and of a node with itself, tie nothing.
    Alternates large stars and small stars until nothing changes; each round is two joins and a
    checkpoint, and about log n rounds are needed.  A hot node is met by partial aggregation and joins
    that Spark may split, never by a collected neighbour list.
    """
    a, b = F.greatest(u, v), F.least(u, v)
    now = cut(edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).select(a.alias("u"), b.alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), F.col("u") == F.col("_u")).filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _mins(large)
        small = large.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        now = cut(small.filter(F.col("u") != F.col("v")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(state)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
