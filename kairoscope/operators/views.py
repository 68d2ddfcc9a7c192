"""The tables behind the usual figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions.tests_udf import t_quantile_column
from kairoscope.operators import cluster, graph, prep


def cluster_lines(series: DataFrame, how: str = "median") -> DataFrame:
    """cluster, kind (object or prototype), object_idx, tp, value."""
    objects = cluster.long_of(series).select("cluster", F.lit("object").alias("kind"), "object_idx", "tp", "value")
    lines = cluster.prototypes(series, how).select("cluster", F.lit("prototype").alias("kind"), F.lit(None).cast("long").alias("object_idx"), "tp", "value")
    return objects.unionByName(lines)


def one_cluster(expr: DataFrame, members: DataFrame, label: int) -> DataFrame:
    """gene_id, tp, value: means over replicates of the members (gene_id, cluster) of one cluster."""
    inside = expr.join(members.where(F.col("cluster") == label).select("gene_id"), "gene_id", "left_semi")
    return inside.groupBy("gene_id", "tp").agg(F.avg("value").alias("value"))


def heat_map(series: DataFrame, scale: str | None = "z") -> DataFrame:
    """cluster, object_idx, tp, value: rows scaled (z, minmax or None)."""
    long = cluster.long_of(series)
    if scale is None:
        return long
    scaled = prep.z_scores(long, ("object_idx",)) if scale == "z" else prep.min_max(long, ("object_idx",))
    return scaled.select("object_idx", "cluster", "tp", F.col("scaled").alias("value"))


def switch_plot(expr: DataFrame, events: DataFrame, relative: bool = True) -> DataFrame:
    """gene_id, role (major or minor), transcript_id, rep, tp, value of the transcripts of events."""
    shown = prep.relative_abundance(expr).withColumn("value", F.col("abundance")).drop("abundance") if relative else expr
    side = lambda role: events.select(F.col(f"{role}_transcript").alias("transcript_id"), F.lit(role).alias("role")).distinct()
    return shown.join(side("major").unionByName(side("minor")), "transcript_id").select("gene_id", "role", "transcript_id", "rep", "tp", "value")


def gene_expression(expr: DataFrame, genes: list[str]) -> DataFrame:
    return expr.where(F.col("gene_id").isin(genes))


def top_terms(terms: DataFrame, p: str, n: int, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("pathway",)) -> DataFrame:
    """The n smallest p-values (of each key) with ``minus_log_p``."""
    scored = terms.withColumn("minus_log_p", -F.log10(F.greatest(F.col(p), F.lit(1e-300))))
    if not keys:
        return scored.orderBy(p, *order).limit(n)
    return scored.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(p, *order))).where(F.col("__k") <= n).drop("__k")


def node_classes(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """node, class: switch with a domain change, switch without, or interactor (events: gene_id, exclusive_domains as an array)."""
    genes = events.groupBy(F.col("gene_id").alias("node")).agg(F.max(F.size("exclusive_domains")).alias("changed"))
    return nodes.select("node").distinct().join(genes, "node", "left").select("node", F.when(F.col("changed") > 0, "domain switch").when(F.col("changed") == 0, "switch").otherwise("interactor").alias("class"))


def affected_marks(edges: DataFrame, affected: DataFrame, joint: DataFrame) -> DataFrame:
    """src, dst, affected: whether an affected domain of one end meets the other end in the joint network (exact ids)."""
    hop = graph.both_ways(joint)
    domain = affected.select(F.concat_ws("/", "gene_id", "domain_id").alias("node"), F.col("gene_id").alias("g")).distinct()
    met = domain.join(hop, "node").select("g", F.split_part("other", F.lit("/"), F.lit(1)).alias("h"))
    pairs = met.select(F.least("g", "h").alias("src"), F.greatest("g", "h").alias("dst")).distinct().withColumn("__hit", F.lit(True))
    return edges.join(pairs, ["src", "dst"], "left").select("src", "dst", F.coalesce("__hit", F.lit(False)).alias("affected"))


def pathway_subgraph(network: DataFrame, membership: DataFrame, pathway: str, spliced: DataFrame) -> DataFrame:
    """src, dst, src_class, dst_class: edges among a pathway's genes and spliced genes that meet them."""
    path = membership.where(F.col("pathway") == pathway).select(F.col("gene_id").alias("node")).distinct().withColumn("p", F.lit(True))
    own = spliced.select(F.col("gene_id").alias("node")).distinct().withColumn("s", F.lit(True))
    kind = path.join(own, "node", "full").select("node", F.when(F.col("p") & F.col("s"), "both").when(F.col("p"), "pathway").otherwise("spliced").alias("c"))
    a = network.join(kind.select(F.col("node").alias("src"), F.col("c").alias("src_class")), "src")
    both = a.join(kind.select(F.col("node").alias("dst"), F.col("c").alias("dst_class")), "dst")
    return both.where("src_class <> 'spliced' OR dst_class <> 'spliced'").select("src", "dst", "src_class", "dst_class")


def mean_interval(expr: DataFrame, keys: tuple[str, ...], level: float = 0.95) -> DataFrame:
    """keys, tp, mean, low, high: the t interval of the mean."""
    m = expr.groupBy(*keys, "tp").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    half = F.col("sd") / F.sqrt("n") * t_quantile_column((1 + level) / 2)(F.col("n") - 1)
    return m.withColumn("half", half).select(*keys, "tp", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def cluster_matrix(connectivity: DataFrame, value: str = "log_odds", clusters: list[int] | None = None) -> DataFrame:
    """One row a cluster (c1) with a column a cluster (those of ``clusters``, if given; else at most as many as Spark pivots): a square table of clusters."""
    return connectivity.groupBy("c1").pivot("c2", clusters).agg(F.first(value))
