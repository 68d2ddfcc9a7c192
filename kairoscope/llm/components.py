"""Connected components of a link table, without a task that holds a component.

Alternating star operations: the large star links every larger neighbour of a node to the node's smallest
neighbour, the small star does so with the smaller ones; both keep components as they are and end when every node hangs on the smallest of
its component.  Minima are taken by ``groupBy`` (pre-aggregated before the shuffle, so a node with very many links
is one row a task), and each round is cut to the shared folder.  They go back to the links by joins on the complement of a node: both
sides are then dealt for the join alone, so adaptive execution can split a node that very many links have over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.session import cut


def _state(edges: DataFrame) -> tuple:
    """A checksum of the edges: when two rounds agree, nothing moves any more."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is the smallest node reachable.

    Links may repeat, point either way or at themselves; a null end is no link.  Nodes without links aren't listed.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = cut(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(u, v).distinct())
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # Large star: for node x and each larger neighbour y, link y to the smallest of x and its neighbours.
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")).select(F.bitwise_not("x").alias("not_x"), "m")
        large = edges.join(least, F.bitwise_not("v") == F.col("not_x")).select("u", F.col("m").alias("v")).distinct()
        # Small star: for node u and each smaller neighbour v, link v to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.select(F.bitwise_not("u").alias("not_u"), "m"), F.bitwise_not("u") == F.col("not_u"))
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
