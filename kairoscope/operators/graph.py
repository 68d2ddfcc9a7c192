"""Networks (src, dst with src < dst): degrees, connectivity between clusters, components, distances, diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.operators import paths
from kairoscope.operators.prep import ratio
from kairoscope.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other: each edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def max_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.max("degree").alias("max_degree"))


def edges_by_degree(edges: DataFrame) -> DataFrame:
    """d1 <= d2, edges: how many edges join nodes of these degrees."""
    d = degrees(edges)
    a = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("x")), "src")
    both = a.join(d.select(F.col("node").alias("dst"), F.col("degree").alias("y")), "dst")
    return both.groupBy(F.least("x", "y").alias("d1"), F.greatest("x", "y").alias("d2")).agg(F.count("*").alias("edges"))


def edge_probability(edges: DataFrame, quirk: bool = False) -> DataFrame:
    """d1, d2, prob: edges between nodes of these degrees over the pairs of such nodes.

    Of one degree there are n (n - 1) / 2 + n pairs; with ``quirk`` (n n - 1) / 2 + n, as published.
    """
    h = degree_histogram(edges)
    pairs = edges_by_degree(edges).join(h.select(F.col("degree").alias("d1"), F.col("nodes").alias("n1")), "d1").join(h.select(F.col("degree").alias("d2"), F.col("nodes").alias("n2")), "d2")
    n = F.col("n1")
    same = ((n * n - 1) / 2 + n) if quirk else (n * (n - 1) / 2 + n)
    return pairs.select("d1", "d2", ratio(F.col("edges").cast("double"), F.when(F.col("d1") == F.col("d2"), same).otherwise(n * F.col("n2")), 0.0).alias("prob"))


def observed_edges(edges: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """c1, c2, observed: edges from a node of c1 to one of c2; left and right have node, cluster.  Within a cluster an edge counts once."""
    right = left if right is None else right
    a = both_ways(edges).join(left.select("node", F.col("cluster").alias("c1")), "node")
    b = a.join(right.select(F.col("node").alias("other"), F.col("cluster").alias("c2")), "other")
    counts = b.groupBy("c1", "c2").agg(F.count("*").alias("n"))
    return counts.select("c1", "c2", F.when(F.col("c1") == F.col("c2"), F.col("n") / 2).otherwise(F.col("n")).cast("double").alias("observed"))


def expected_edges(edges: DataFrame, left: DataFrame, right: DataFrame | None = None, quirk: bool = False) -> DataFrame:
    """c1, c2, expected: the sum of the edge probability over the pairs of members, from the clusters' degree histograms.

    Pairs within a cluster count once; between clusters of one label of two clusterings, half, as their observed edges do.
    """
    one = right is None
    right = left if one else right
    d = degrees(edges)
    histogram = lambda c: c.join(d, "node").groupBy("cluster", "degree").agg(F.count("*").alias("n"))
    a = histogram(left).select(F.col("cluster").alias("c1"), F.col("degree").alias("x"), F.col("n").alias("n1"))
    b = histogram(right).select(F.col("cluster").alias("c2"), F.col("degree").alias("y"), F.col("n").alias("n2"))
    p = edge_probability(edges, quirk)
    two = p.select(F.col("d1").alias("x"), F.col("d2").alias("y"), "prob").union(p.where("d1 <> d2").select(F.col("d2").alias("x"), F.col("d1").alias("y"), "prob"))
    n1, n2 = F.col("n1"), F.col("n2")
    within = F.when(F.col("x") == F.col("y"), n1 * (n1 - 1) / 2).otherwise(n1 * n2 / 2) if one else n1 * n2 / 2
    pairs = F.when(F.col("c1") != F.col("c2"), n1 * n2).otherwise(within)
    return two.join(a, "x").join(b, "y").groupBy("c1", "c2").agg(F.sum(F.col("prob") * pairs).alias("expected"))


def connectivity(edges: DataFrame, left: DataFrame, right: DataFrame | None = None, quirk: bool = False) -> DataFrame:
    """c1, c2, observed, expected, log_odds (0 where either is 0) and normalised (by the size of c1 and c2)."""
    size = lambda c, n: c.groupBy(F.col("cluster").alias(n)).agg(F.count("*").alias(f"{n}_size"))
    s1, s2 = size(left, "c1"), size(left if right is None else right, "c2")
    grid = s1.crossJoin(s2)  # clusters x clusters
    out = grid.join(observed_edges(edges, left, right), ["c1", "c2"], "left").join(expected_edges(edges, left, right, quirk), ["c1", "c2"], "left")
    seen, hoped = F.coalesce("observed", F.lit(0.0)), F.coalesce("expected", F.lit(0.0))
    odds = F.when((seen > 0) & (hoped > 0), F.log2(F.try_divide(seen, hoped))).otherwise(0.0)
    return out.select("c1", "c2", seen.alias("observed"), hoped.alias("expected"), odds.alias("log_odds"), (odds / (F.col("c1_size") + F.col("c2_size"))).alias("normalised"))


def induced(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """group, src, dst: edges both of whose ends are in one group; members has group and node."""
    a = edges.join(members.select(F.col("node").alias("src"), group), "src")
    return a.join(members.select(F.col("node").alias("dst"), group), ["dst", group]).select(group, "src", "dst")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest member): labels spread by minima, and each round also jumps to the label's label."""
    labels = both_ways(edges).groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))
    while True:
        labels = cut(labels)
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        up = labels.join(jump, "component").select("node", F.col("up").alias("component"))
        near = both_ways(edges).join(up.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        new = up.join(near, "node").select("node", F.least("component", "near").alias("component"))
        new = cut(new)
        if new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty():
            break
        labels = new
    if nodes is not None:
        alone = nodes.join(new, "node", "left_anti").select("node", F.col("node").alias("component"))
        return new.union(alone)
    return new


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, node, distance: steps from each source (sources: source), by frontiers of bits."""
    return paths.rows(paths.levels(both_ways(edges), sources.select(F.col("source").alias("node")), most))


def inverse_distance(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, closeness: (longest - distance) / longest over the pairs that can be reached."""
    found = paths.levels(both_ways(edges), sources.select(F.col("source").alias("node")))
    return paths.rows(found).select("source", "node", ratio(found.longest - F.col("distance"), F.lit(found.longest), 0.0).alias("closeness"))


def diffusion(edges: DataFrame, seeds: DataFrame, steps: int = 20, threshold: float = 0.5) -> DataFrame:
    """node, layer: linear-threshold spread; a node joins once the active share of its neighbours reaches the threshold.  Seeds (node) have layer 0."""
    hop, degree = both_ways(edges), degrees(edges)
    active = cut(seeds.select("node").distinct().withColumn("layer", F.lit(0)))
    for layer in range(1, steps + 1):
        push = hop.join(active.select("node"), "node").groupBy(F.col("other").alias("node")).agg(F.count("*").alias("n"))
        new = push.join(degree, "node").where(ratio(F.col("n"), F.col("degree")) >= threshold).join(active, "node", "left_anti")
        new = cut(new.select("node", F.lit(layer).alias("layer")))
        if new.isEmpty():
            break
        active = cut(active.unionByName(new))
    return active


def prizes(layers: DataFrame, factor: float) -> DataFrame:
    """node, prize: 1 for seeds, factor ** layer for what they reach."""
    return layers.select("node", F.when(F.col("layer") == 0, F.lit(1.0)).otherwise(F.pow(F.lit(factor), F.col("layer"))).alias("prize"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (node, cluster)."""
    m = edges.agg(F.count("*").alias("m"))
    inside = induced(edges, members, "cluster").groupBy("cluster").agg(F.count("*").alias("inside"))
    volume = degrees(edges).join(members, "node").groupBy("cluster").agg(F.sum("degree").alias("volume"))
    both = volume.join(inside, "cluster", "left").crossJoin(F.broadcast(m))  # one row
    share = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("volume") / (2.0 * F.col("m")), F.lit(2.0))
    return both.agg(F.sum(share).alias("modularity"))


def top_degree(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def rank_degree(edges: DataFrame) -> DataFrame:
    h = degree_histogram(edges)  # a row a degree
    above = F.sum("nodes").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("degree")))
    return h.select("degree", "nodes", above.alias("at_least"))
