"""Splicing events to affected domains, and enrichment of pathways by affected edges or by membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.operators import graph, stats


def numbers(text: Column, separator: str = ";") -> Column:
    """Separated numbers as an array; what isn't a number is null."""
    return F.transform(F.split(text, separator), lambda x: x.try_cast("double"))


def confident_events(events: DataFrame, min_delta: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """Exon-skipping events with a change and a probability at the cutoffs or above, and ``max_change``: the change of largest size."""
    e = events.where("es").withColumn("d", numbers(F.col("delta"))).withColumn("q", numbers(F.col("prob")))
    kept = e.where(F.exists("d", lambda x: F.abs(x) >= min_delta) & F.exists("q", lambda x: x >= confidence))
    top = F.array_max(F.transform("d", lambda x: F.struct(F.abs(x).alias("size"), x.alias("change"))))
    return kept.withColumn("max_change", top["change"]).drop("d", "q")


def junctions(events: DataFrame) -> DataFrame:
    """events with ``source`` (the coordinate that half of the tokens are) and a row a ``target`` (each of the rest)."""
    tokens = F.filter(F.split("coords", "[;-]"), lambda x: x != "")
    e = events.withColumn("t", tokens)
    source = F.element_at(F.filter(F.array_distinct("t"), lambda v: F.size(F.filter("t", lambda x: x == v)) == F.size("t") / 2), 1)
    e = e.withColumn("source", F.when(F.size(F.filter(F.array_distinct("t"), lambda v: F.size(F.filter("t", lambda x: x == v)) == F.size("t") / 2)) > 0, source))
    return e.select(*(c for c in e.columns if c != "t"), F.explode(F.filter("t", lambda x: x != F.col("source"))).alias("target"))


def standard_events(events: DataFrame, min_delta: float | None = None, delta: str = "delta") -> DataFrame:
    """gene_id, start, end, delta: rows whose coordinates are whole numbers; raises if a gene id doesn't begin with ENS."""
    checked = events.withColumn("gene_id", F.when(F.assert_true(F.col("gene_id").startswith("ENS"), F.lit("gene ids must begin with ENS")).isNull(), F.col("gene_id")))
    whole = checked.where(F.col("start").cast("string").rlike("^[0-9]+$") & F.col("end").cast("string").rlike("^[0-9]+$"))
    out = whole.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))
    return out if min_delta is None else out.where(F.abs(F.col(delta)) >= min_delta)


def by_change(events: DataFrame, change: str = "max_change") -> DataFrame:
    """Events in order of the size of their change, the largest first; null changes last."""
    return events.orderBy(F.abs(F.col(change)).desc_nulls_last(), *(c for c in events.columns if c != change))


def with_links(affected: DataFrame, base: str) -> DataFrame:
    """affected (exon_id, interacting) with ``link``: the base address and the exon where the domain interacts, else empty."""
    return affected.withColumn("link", F.when(F.col("interacting"), F.concat(F.lit(base), F.col("exon_id"))).otherwise(F.lit("")))


def public_domains(affected: DataFrame, human: bool = True) -> DataFrame:
    """affected without its internal id, and without the links where the organism has none."""
    return affected.drop("domain_node") if human else affected.drop("domain_node", "link")


def composite_events(ids: DataFrame, mapping: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the mapping (gene_id, domain_id) for ids of the form gene/domain."""
    parts = ids.select(F.split_part(id_col, F.lit("/"), F.lit(1)).alias("gene_id"), F.split_part(id_col, F.lit("/"), F.lit(2)).alias("domain_id"))
    return mapping.join(parts.distinct(), ["gene_id", "domain_id"])


def overlaps(exons: DataFrame, domains: DataFrame, width: int = 1000) -> DataFrame:
    """gene_id, exon_id, domain_id of intervals of a gene that touch (closed ends), distinct.

    Intervals are dealt by gene and stretches of ``width``, so that a gene of very many intervals is spread; a
    pair counts in the stretch in which the later one begins.
    """
    cells = lambda t: t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))))
    a = cells(exons.select("gene_id", "exon_id", "start", "end")).select("gene_id", "cell", "exon_id", F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = cells(domains.select("gene_id", "domain_id", "start", "end")).select("gene_id", "cell", "domain_id", F.col("start").alias("s2"), F.col("end").alias("e2"))
    met = a.join(b, ["gene_id", "cell"]).where((F.greatest("s1", "s2") <= F.least("e1", "e2")) & (F.floor(F.greatest("s1", "s2") / width) == F.col("cell")))
    return met.select("gene_id", "exon_id", "domain_id").distinct()


def junction_exons(junction: DataFrame, mapping: DataFrame) -> DataFrame:
    """Junctions whose target is the coding start of an exon of the same gene (mapping: gene_id, start, exon_id)."""
    m = mapping.select("gene_id", F.col("start").cast("string").alias("target"), "exon_id")
    return junction.join(m, ["gene_id", "target"])


def interacting(affected: DataFrame, joint: DataFrame) -> DataFrame:
    """affected with ``interacting``: whether gene/domain is a node of the joint network."""
    nodes = joint.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("__in", F.lit(True))
    key = F.concat_ws("/", "gene_id", "domain_id")
    return affected.withColumn("id", key).join(nodes, "id", "left").withColumn("interacting", F.coalesce("__in", F.lit(False))).drop("__in", "id")


def affected_edges(affected: DataFrame, joint: DataFrame) -> DataFrame:
    """gene_id, neighbour: distinct genes that a gene's affected domains meet in the joint network (ids gene/domain)."""
    hop = graph.both_ways(joint)
    met = affected.select(F.concat_ws("/", "gene_id", "domain_id").alias("node"), "gene_id").distinct().join(hop, "node")
    return met.select("gene_id", F.split_part("other", F.lit("/"), F.lit(1)).alias("neighbour")).where("gene_id <> neighbour").distinct()


def edge_list(edges: DataFrame) -> DataFrame:
    """gene_id, n, neighbours (comma-joined, in order), most first."""
    out = edges.groupBy("gene_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("neighbour")), ",").alias("neighbours"))
    return out.orderBy(F.desc("n"), "gene_id")


def pathway_degrees(membership: DataFrame, network: DataFrame) -> DataFrame:
    """pathway, degree: the summed degree of its genes."""
    d = graph.degrees(network).withColumnRenamed("node", "gene_id")
    return membership.select("pathway", "gene_id").distinct().join(d, "gene_id").groupBy("pathway").agg(F.sum("degree").alias("degree"))


def gene_counts(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """pathway, gene_id, inside, outside: how many of a gene's affected neighbours are in the pathway; genes with one at least."""
    total = edges.groupBy("gene_id").agg(F.count("*").alias("all"))
    members = membership.select("pathway", F.col("gene_id").alias("neighbour")).distinct()
    inside = edges.join(members, "neighbour").groupBy("pathway", "gene_id").agg(F.count("*").alias("inside"))
    return inside.join(total, "gene_id").select("pathway", "gene_id", "inside", (F.col("all") - F.col("inside")).alias("outside"))


def pathway_enrichment(edges: DataFrame, membership: DataFrame, network: DataFrame, cutoff: float = 0.05, total_edges: int | None = None) -> DataFrame:
    """pathway, source, degree, inside, outside, p_value, gene_count, score: exact tests of the affected edges that end in each pathway.

    total_edges: of the network, counted where it isn't given.  score: -(sqrt(gene_count) * log10(p)) under the cutoff, else 0.
    """
    n = network.agg(F.count("*").cast("long").alias("edges")) if total_edges is None else network.sparkSession.range(1).select(F.lit(total_edges).cast("long").alias("edges"))
    degree = pathway_degrees(membership, network)
    counts = gene_counts(edges, membership).join(degree, "pathway").crossJoin(F.broadcast(n))  # one row
    each = counts.withColumn("gene_p", stats.fisher_exact_greater(F.col("inside"), F.col("outside"), F.col("degree"), F.col("edges")))
    hits = each.groupBy("pathway").agg(F.sum("inside").alias("inside"), F.count_if(F.col("gene_p") <= cutoff).alias("gene_count"))
    whole = edges.agg(F.count("*").alias("all"))
    rows = hits.join(degree, "pathway").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(whole))  # one row each
    rows = rows.withColumn("outside", F.col("all") - F.col("inside"))
    rows = rows.withColumn("p_value", stats.fisher_exact_greater(F.col("inside"), F.col("outside"), F.col("degree"), F.col("edges")))
    score = F.when(F.col("p_value") < cutoff, -(F.sqrt("gene_count") * F.log10(F.greatest(F.col("p_value"), F.lit(1e-300))))).otherwise(F.lit(0.0))
    source = membership.groupBy("pathway").agg(F.min("source").alias("source"))
    return rows.join(source, "pathway").select("pathway", "source", "degree", "inside", "outside", "p_value", "gene_count", score.alias("score"))


def enrich(edges: DataFrame, membership: DataFrame, network: DataFrame, sources: list[str] | None = None, cutoff: float = 0.05) -> DataFrame:
    """pathway_enrichment of the chosen sources with the standard correction, by score and p."""
    chosen = membership if sources is None else membership.where(F.col("source").isin(sources))
    return stats.adjust(pathway_enrichment(edges, chosen, network, cutoff), "p_value", "adj_p", "fdr_bh_standard").orderBy(F.desc("score"), "p_value", "pathway")


def pathway_genes(edges: DataFrame, membership: DataFrame, network: DataFrame, pathway: str) -> DataFrame:
    """One pathway gene by gene: member, share ("inside/all"), p_value, neighbours in it."""
    own = membership.where(F.col("pathway") == pathway)
    degree, n = pathway_degrees(own, network), network.agg(F.count("*").cast("long").alias("edges"))
    counts = gene_counts(edges, own).join(degree, "pathway").crossJoin(F.broadcast(n))  # one row
    names = edges.join(own.select(F.col("gene_id").alias("neighbour")).distinct(), "neighbour", "left_semi").groupBy("gene_id").agg(F.array_join(F.array_sort(F.collect_set("neighbour")), ",").alias("neighbours"))
    member = own.select("gene_id").distinct().withColumn("member", F.lit(True))
    out = counts.join(names, "gene_id").join(member, "gene_id", "left")
    p = stats.fisher_exact_greater(F.col("inside"), F.col("outside"), F.col("degree"), F.col("edges"))
    return out.select("gene_id", F.coalesce("member", F.lit(False)).alias("member"), F.concat_ws("/", "inside", F.col("inside") + F.col("outside")).alias("share"), p.alias("p_value"), "neighbours")


def affected_stats(affected: DataFrame, spliced: DataFrame) -> DataFrame:
    """One row: shares of spliced genes with an affected domain, and of affected domains that interact (2 decimals)."""
    a = affected.agg(F.count_distinct("gene_id").alias("genes"), F.count_distinct("gene_id", "domain_id").alias("domains"), F.count_distinct(F.when(F.col("interacting"), F.struct("gene_id", "domain_id"))).alias("met"))
    s = spliced.agg(F.count_distinct("gene_id").alias("spliced"))
    return a.crossJoin(s).select("genes", "spliced", F.round(F.try_divide(F.col("genes"), F.col("spliced")), 2).alias("gene_share"), F.round(F.try_divide(F.col("met"), F.col("domains")), 2).alias("domain_share"))  # one row each


def over_representation(queries: DataFrame, membership: DataFrame, method: str = "fdr_bh", cutoff: float | None = None) -> DataFrame:
    """grp, pathway, hits, size, drawn, p_value, adj_p: membership of the genes of each group (grp, gene_id) against all genes that have a pathway."""
    m = membership.select("pathway", "gene_id").distinct()
    total = m.agg(F.count_distinct("gene_id").alias("total"))
    q = queries.select("grp", "gene_id").distinct().join(m.select("gene_id").distinct(), "gene_id", "left_semi")
    drawn, size = q.groupBy("grp").agg(F.count("*").alias("drawn")), m.groupBy("pathway").agg(F.count("*").alias("size"))
    hits = q.join(m, "gene_id").groupBy("grp", "pathway").agg(F.count("*").alias("hits"))
    rows = hits.join(drawn, "grp").join(size, "pathway").crossJoin(F.broadcast(total))  # one row
    p = rows.withColumn("p_value", stats.hypergeometric_tail(F.col("total"), F.col("size"), F.col("drawn"), F.col("hits")))
    out = stats.adjust(p, "p_value", "adj_p", method).select("grp", "pathway", "hits", "size", "drawn", "p_value", "adj_p")
    return out if cutoff is None else out.where(F.col("adj_p") < cutoff)


def keep_first(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return frame.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
