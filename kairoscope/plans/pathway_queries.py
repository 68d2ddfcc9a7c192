"""Queries on splicing events, pathways, motifs and figure tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.operators import cluster, graph, motif, prep, switch, views
from kairoscope.operators import pathways as P
from kairoscope.plans import graph_queries as GQ
from kairoscope.plans import switch_queries as SQ
from kairoscope.plans.switch_queries import tail_sql
from kairoscope.sources import tables as T
from kairoscope.sources.tables import with_views as V

R6 = lambda c: F.round(c, 6)
#: Counts of a, c, g, t at each position of two motifs; one count is zero.
MOTIFS = {"TATA": [(2, 1, 1, 16), (15, 1, 2, 2), (1, 2, 1, 16), (14, 2, 2, 2)], "GCAG": [(1, 2, 15, 2), (2, 14, 2, 2), (16, 1, 1, 2), (0, 3, 15, 2)]}
THRESHOLD = 3.2101
#: Share of random words over a motif's own threshold.
RATE = 0.01
TESTS = ("lost_vs_background", "gained_vs_background", "lost_vs_gained")


def _pwm(spark):
    rows = [("sf" + name[0], name, k, *map(float, counts)) for name, table in MOTIFS.items() for k, counts in enumerate(table)]
    return spark.createDataFrame(rows, "sf string, motif_id string, pos int, a double, c double, g double, t double")


def _affected(spark, d):
    return P.overlaps(T.exons(spark, d), T.domains(spark, d)).select("gene_id", "domain_id").distinct()


def _joint(spark, d):
    """The network on gene/domain ids: each gene with its first domain."""
    first = T.domains(spark, d).groupBy("gene_id").agg(F.min("domain_id").alias("domain"))
    name = lambda side: first.select(F.col("gene_id").alias(side), F.concat_ws("/", "gene_id", "domain").alias(f"{side}_id"))
    e = T.network(spark, d).join(name("src"), "src").join(name("dst"), "dst")
    return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def exon_domain_overlap(spark, d):
    return P.overlaps(T.exons(spark, d), T.domains(spark, d))


def interacting_domains(spark, d):
    return P.interacting(_affected(spark, d), _joint(spark, d))


def affected_edges(spark, d):
    return P.affected_edges(_affected(spark, d), _joint(spark, d))


def gene_edges(spark, d):
    return P.edge_list(P.affected_edges(_affected(spark, d), _joint(spark, d)))


def pathway_degree(spark, d):
    return P.pathway_degrees(T.pathways(spark, d), T.network(spark, d))


def pathway_enrichment(spark, d):
    p = P.pathway_enrichment(P.affected_edges(_affected(spark, d), _joint(spark, d)), T.pathways(spark, d), T.network(spark, d))
    return p.select("pathway", "source", "degree", "inside", "outside", R6("p_value").alias("p_value"), "gene_count")


def pathway_adjusted(spark, d):
    p = P.enrich(P.affected_edges(_affected(spark, d), _joint(spark, d)), T.pathways(spark, d), T.network(spark, d))
    return p.select("pathway", R6("p_value").alias("p_value"), R6("adj_p").alias("adj_p"), R6("score").alias("score"))


def pathway_drilldown(spark, d):
    p = P.pathway_genes(P.affected_edges(_affected(spark, d), _joint(spark, d)), T.pathways(spark, d), T.network(spark, d), "Brand#11")
    return p.select("gene_id", "member", "share", R6("p_value").alias("p_value"), "neighbours")


def affected_stats(spark, d):
    return P.affected_stats(P.interacting(_affected(spark, d), _joint(spark, d)), T.exons(spark, d))


def over_representation(spark, d):
    q = T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("grp"), F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene_id"))
    o = P.over_representation(q, T.pathways(spark, d), "fdr_bh_standard")
    return o.select("grp", "pathway", "hits", "size", "drawn", R6("p_value").alias("p_value"), R6("adj_p").alias("adj_p"))


def majiq_filter(spark, d):
    return P.confident_events(T.splice_events(spark, d)).select("event_id", "gene_id", R6("max_change").alias("max_change"))


def majiq_explode(spark, d):
    return P.junctions(T.splice_events(spark, d)).select("event_id", "source", "target")


def gc_fraction(spark, d):
    return T.sequences(spark, d).select("doc_id", motif.gc_fraction(F.col("seq")).alias("gc"))


def _scans(spark, d):
    return motif.scan(T.sequences(spark, d), _pwm(spark))


def pssm_scan(spark, d):
    return motif.hits(_scans(spark, d), THRESHOLD).select("doc_id", "motif_id", "n_hits", R6("best").alias("best"))


def motif_groups(spark, d):
    return motif.group_table(_scans(spark, d), THRESHOLD).select("motif_id", "grp", "label", "n_sequences", "n_hits", R6("mean_hit").alias("mean_hit"))


def _limits(spark, d):
    return motif.thresholds(_pwm(spark), motif.background(T.sequences(spark, d)), RATE)


def motif_thresholds(spark, d):
    return _limits(spark, d).select("motif_id", R6("threshold").alias("threshold"), R6("share").alias("share"))


def motif_threshold_groups(spark, d):
    return motif.group_table(_scans(spark, d), _limits(spark, d)).select("motif_id", "grp", "label", "n_sequences", "n_hits", R6("mean_hit").alias("mean_hit"))


def motif_tests(spark, d):
    return motif.group_tests(_scans(spark, d), _limits(spark, d)).select("motif_id", *(R6(c).alias(c) for c in TESTS))


def motif_best_tests(spark, d):
    return motif.group_tests(_scans(spark, d)).select("motif_id", *(R6(c).alias(c) for c in TESTS))


#: Of co-expression: time points, genes, correction and cutoffs.
COEXPRESSION = (T.REPS, T.TIMEPOINTS, None, "fdr_bh", 0.3, 1.0)


def _factors(spark, d):
    return T.table(spark, d, "supplier").where("s_nationkey < 3").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene_id"))


def _gene_clusters(spark, d):
    return T.table(spark, d, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene_id"), (F.col("s_nationkey") % 4).cast("int").alias("cluster"))


def _sets(spark, d):
    return motif.coexpression_sets(T.expression(spark, d), _factors(spark, d), _gene_clusters(spark, d), *COEXPRESSION)


def factor_sets(spark, d):
    return _sets(spark, d).select("cluster", "direction", F.concat_ws(",", "sfs").alias("sfs"))


def unique_factors(spark, d):
    sets = motif.unique_factors(_sets(spark, d))
    return sets.select("cluster", *(F.concat_ws(",", c).alias(c) for c in ("both", "positive", "negative")))


def balanced_factors(spark, d):
    return motif.coexpression_balanced(T.expression(spark, d), _factors(spark, d), *COEXPRESSION)


def sequence_windows(spark, d):
    genome = T.sequences(spark, d).select(F.concat(F.lit("G"), F.col("doc_id").cast("string")).alias("seqname"), F.col("seq").alias("sequence"))
    exons = T.exons(spark, d).withColumnRenamed("gene_id", "seqname")
    both = motif.windows(exons, genome, "5p", 20).withColumn("site", F.lit("5p")).unionByName(motif.windows(exons, genome, "3p", 15).withColumn("site", F.lit("3p")))
    return both.select("exon_id", "site", "seq")


def exon_sets(spark, d):
    ann = T.annotations(spark, d).groupBy("gene_id", "transcript_id").agg(F.collect_set("exon").alias("exons"), F.collect_set("pfam").alias("pfams"))
    a = ann.select("gene_id", F.col("transcript_id").alias("major_transcript"))
    pairs = a.join(ann.select("gene_id", F.col("transcript_id").alias("minor_transcript")), "gene_id").where("major_transcript < minor_transcript")
    events = switch.with_annotation(pairs, ann.drop("gene_id")).withColumn("p_value", F.substring("minor_transcript", -1, 1).cast("double") / 10)
    sets = [motif.exon_sets(events, which, mode).select("gene_id", "exon", F.lit(which).alias("which"), F.lit(mode).alias("mode")) for which in ("loss", "gain", "constant") for mode in ("all", "last")]
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out


def composite_events(spark, d):
    ids = _joint(spark, d).select(F.col("src").alias("id"))
    return P.composite_events(ids, _affected(spark, d))


def junction_exons(spark, d):
    e = T.splice_events(spark, d)
    mapping = e.where("es").select("gene_id", (F.col("event_id").cast("long") + 10).alias("start"), F.concat(F.lit("X"), F.col("event_id").cast("string")).alias("exon_id"))
    return P.junction_exons(P.junctions(e), mapping).select("event_id", "gene_id", "target", "exon_id")


def standard_events(spark, d):
    e = T.exons(spark, d).select(F.concat(F.lit("ENS"), "gene_id").alias("gene_id"), "exon_id", F.when(F.col("start") % 7 == 0, F.concat(F.col("start").cast("string"), F.lit("x"))).otherwise(F.col("start").cast("string")).alias("start"), F.col("end").cast("string").alias("end"), ((F.col("start") % 11 - 5) / F.lit(50.0)).alias("delta"))
    return P.standard_events(e, 0.05).select("gene_id", "exon_id", "start", "end", R6("delta").alias("delta"))


def largest_changes(spark, d):
    return P.by_change(P.confident_events(T.splice_events(spark, d)).select("event_id", R6("max_change").alias("max_change"))).limit(25)


def domain_links(spark, d):
    hits = P.overlaps(T.exons(spark, d), T.domains(spark, d))
    met = P.interacting(hits, _joint(spark, d)).withColumn("domain_node", F.concat_ws("/", "gene_id", "domain_id"))
    return P.public_domains(P.with_links(met, "https://example.org/exon/"))


def over_representation_cutoff(spark, d):
    q = _gene_clusters(spark, d).select(F.col("cluster").alias("grp"), "gene_id")
    o = P.over_representation(q, T.pathways(spark, d), "fdr_bh_standard", 0.9)
    return o.select("grp", "pathway", "hits", R6("p_value").alias("p_value"), R6("adj_p").alias("adj_p"))


def pathway_sources(spark, d):
    chosen = [r[0] for r in T.pathways(spark, d).groupBy("source").agg(F.count_distinct("pathway").alias("n")).orderBy("source").limit(6).collect()]
    p = P.enrich(P.affected_edges(_affected(spark, d), _joint(spark, d)), T.pathways(spark, d), T.network(spark, d), chosen)
    return p.select("pathway", "source", R6("p_value").alias("p_value"), R6("adj_p").alias("adj_p"))


def first_events(spark, d):
    e = P.confident_events(T.splice_events(spark, d)).select("gene_id", "event_id", "max_change")
    return P.keep_first(e, ["gene_id"], [F.abs("max_change").desc(), F.col("event_id")]).select("gene_id", "event_id")


def gene_expression(spark, d):
    return views.gene_expression(T.expression(spark, d), ["G1", "G3", "G5"]).select("gene_id", "transcript_id", "rep", "tp", R6("value").alias("value"))


def factor_coexpression(spark, d):
    found = motif.factor_coexpression(T.expression(spark, d), _factors(spark, d), *COEXPRESSION, digits=6)
    return found.select("sf", "gene_id", "transcript_id", R6("corr").alias("corr"), R6("p_value").alias("p_value"), R6("adj_p").alias("adj_p"), "direction")


def cluster_lines(spark, d):
    return views.cluster_lines(T.series(spark, d)).select("cluster", "kind", "object_idx", "tp", R6("value").alias("value"))


def heat_map(spark, d):
    return views.heat_map(T.series(spark, d)).select("object_idx", "cluster", "tp", R6("value").alias("value"))


def one_cluster(spark, d):
    members = T.table(spark, d, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene_id"), F.col("s_nationkey").alias("cluster"))
    return views.one_cluster(T.expression(spark, d), members, 3).select("gene_id", "tp", R6("value").alias("value"))


def top_terms(spark, d):
    p = P.pathway_enrichment(P.affected_edges(_affected(spark, d), _joint(spark, d)), T.pathways(spark, d), T.network(spark, d)).withColumn("p6", R6("p_value"))
    return views.top_terms(p, "p6", 10).select("pathway", F.col("p6").alias("p_value"))


def top_by_group(spark, d):
    o = over_representation(spark, d)
    return views.top_terms(o, "p_value", 3, ("grp",)).select("grp", "pathway", "p_value")


def mean_interval(spark, d):
    return views.mean_interval(prep.gene_level(T.expression(spark, d)), ("gene_id",)).select("gene_id", "tp", R6("mean").alias("mean"), R6("low").alias("low"), R6("high").alias("high"))


def affected_marks(spark, d):
    return views.affected_marks(T.network(spark, d), _affected(spark, d), _joint(spark, d))


def pathway_subgraph(spark, d):
    return views.pathway_subgraph(T.network(spark, d), T.pathways(spark, d), "Brand#11", T.exons(spark, d))


def node_classes(spark, d):
    e = T.expression(spark, d)
    sets = T.annotations(spark, d).groupBy("gene_id").agg(F.collect_set("pfam").alias("exclusive_domains"))
    return views.node_classes(prep.nodes_of(T.network(spark, d)).withColumnRenamed("gene_id", "node"), sets.join(e.select("gene_id").distinct(), "gene_id", "left_semi"))


def switch_plot(spark, d):
    events = switch.candidates(T.expression(spark, d), T.REPS, T.TIMEPOINTS).where("p_value < 0.02")
    return views.switch_plot(T.expression(spark, d), events).select("gene_id", "role", "transcript_id", "rep", "tp", R6("value").alias("value"))


def cluster_matrix(spark, d):
    nodes = T.table(spark, d, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("node"), (F.col("s_nationkey") % 4).cast("int").alias("cluster"))
    square = views.cluster_matrix(graph.connectivity(T.network(spark, d), nodes), "log_odds", list(range(4)))
    return square.select("c1", *(R6(F.col(str(k))).alias(f"c{k}_odds") for k in range(4)))


def cluster_merge_lines(spark, d):
    return cluster.prototype_variance(cluster.combine(T.series(spark, d), [1, 2])).select("cluster", F.round("variance", 9).alias("variance"))


QUERIES = {f.__name__: f for f in (exon_domain_overlap, interacting_domains, affected_edges, gene_edges, pathway_degree, pathway_enrichment, pathway_adjusted, pathway_drilldown, affected_stats, over_representation, majiq_filter, majiq_explode, gc_fraction, pssm_scan, motif_groups, motif_thresholds, motif_threshold_groups, motif_tests, motif_best_tests, factor_coexpression, factor_sets, unique_factors, balanced_factors, sequence_windows, exon_sets, composite_events, junction_exons, standard_events, largest_changes, domain_links, over_representation_cutoff, pathway_sources, first_events, gene_expression, cluster_lines, heat_map, one_cluster, top_terms, top_by_group, mean_interval, affected_marks, pathway_subgraph, node_classes, switch_plot, cluster_matrix, cluster_merge_lines)}

_OV = "ov AS (SELECT DISTINCT gene_id, exon_id, domain_id FROM exon JOIN dom USING (gene_id) WHERE greatest(exon.s, dom.s) <= least(exon.e, dom.e)), af AS (SELECT DISTINCT gene_id, domain_id FROM ov)"
_JO = "fd AS (SELECT gene_id, gene_id || '/' || min(domain_id) AS id FROM dom GROUP BY gene_id), jo AS (SELECT a.id AS src, b.id AS dst FROM net JOIN fd a ON src = a.gene_id JOIN fd b ON dst = b.gene_id), jb AS (SELECT src AS x, dst AS y FROM jo UNION ALL SELECT dst, src FROM jo)"
_AE = f"{_OV}, {_JO}, ae AS (SELECT DISTINCT gene_id, split_part(y, '/', 1) AS neighbour FROM af JOIN jb ON x = gene_id || '/' || domain_id WHERE gene_id <> split_part(y, '/', 1))"
_PD = "bw AS (SELECT src AS n FROM net UNION ALL SELECT dst FROM net), dg AS (SELECT n, count(*) AS d FROM bw GROUP BY n), pd AS (SELECT pathway, sum(d) AS degree FROM (SELECT DISTINCT pathway, gene_id FROM pw) JOIN dg ON gene_id = n GROUP BY pathway)"
_GC = f"{_AE}, {_PD}, tl AS (SELECT gene_id, count(*) AS al FROM ae GROUP BY gene_id), ins AS (SELECT pathway, ae.gene_id, count(*) AS inside FROM ae JOIN (SELECT DISTINCT pathway, gene_id AS g FROM pw) ON neighbour = g GROUP BY ALL), gc AS (SELECT pathway, gene_id, inside, al - inside AS outside FROM ins JOIN tl USING (gene_id)), ne AS (SELECT count(*) AS m FROM net), gt AS (SELECT gc.*, degree, {tail_sql('2 * m', 'degree', 'inside + outside', 'inside')} AS gp FROM gc JOIN pd USING (pathway), ne WHERE inside <= degree)"
_PE = f"{_GC}, hs AS (SELECT pathway, sum(inside) AS inside, count(*) FILTER (gp <= 0.05) AS gene_count FROM gt GROUP BY pathway), pe AS (SELECT hs.pathway, (SELECT min(source) FROM pw WHERE pw.pathway = hs.pathway) AS source, degree, inside, na - inside AS outside, {tail_sql('2 * m', 'degree', 'na', 'CAST(inside AS BIGINT)')} AS p, gene_count FROM hs JOIN pd USING (pathway), ne, (SELECT count(*) AS na FROM ae))"
_MOT = "mt AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {k}, {a}.0, {c}.0, {g}.0, {t}.0)" for m, table in MOTIFS.items() for k, (a, c, g, t) in enumerate(table)) + ") v(motif_id, pos, a, c, g, t)), mn AS (SELECT motif_id, pos, a / (a + c + g + t) AS a, c / (a + c + g + t) AS c, g / (a + c + g + t) AS g, t / (a + c + g + t) AS t FROM mt)"
_SC = f"{_MOT}, sq AS (SELECT doc_id, grp, seq, len(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / len(seq) AS gcr FROM seqs), ofs AS (SELECT doc_id, grp, seq, gcr, unnest(range(0, len(seq) - 3)) AS o_at FROM sq), lt AS (SELECT ofs.doc_id, ofs.grp, motif_id, o_at, pos, CASE seq[o_at + pos + 1] WHEN 'A' THEN a / ((1 - gcr) / 2) WHEN 'C' THEN c / (gcr / 2) WHEN 'G' THEN g / (gcr / 2) ELSE t / ((1 - gcr) / 2) END AS o FROM ofs, mn), sc AS (SELECT doc_id, grp, motif_id, o_at, CASE WHEN min(o) > 0 THEN sum(log2(CASE WHEN o > 0 THEN o END)) END AS s FROM lt GROUP BY ALL)"
_OR = f"mb AS (SELECT DISTINCT pathway, gene_id FROM pw), tt AS (SELECT count(DISTINCT gene_id) AS t FROM mb), qs AS (SELECT DISTINCT s_nationkey AS grp, 'G' || s_suppkey AS gene_id FROM supplier WHERE 'G' || s_suppkey IN (SELECT gene_id FROM mb)), dr AS (SELECT grp, count(*) AS drawn FROM qs GROUP BY grp), sz AS (SELECT pathway, count(*) AS size FROM mb GROUP BY pathway), hh AS (SELECT grp, pathway, count(*) AS hits FROM qs JOIN mb USING (gene_id) GROUP BY ALL), pp AS (SELECT hh.*, size, drawn, {tail_sql('t', 'size', 'drawn', 'hits')} AS p FROM hh JOIN dr USING (grp) JOIN sz USING (pathway), tt), rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM pp), orr AS (SELECT *, least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM rk)"
_GCL = "gcl AS (SELECT 'G' || s_suppkey AS gene_id, CAST(s_nationkey % 4 AS INT) AS cluster FROM supplier)"
#: P(|T| > t) for r of 21 points, 19 degrees of freedom: an odd number has a finite sum in the angle.
_T19 = "(SELECT 1 - 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, 9), lambda k: exp(lgamma(k + 1) * 2 + 2 * k * ln(2) - lgamma(2 * k + 2)) * power(cos(th), 2 * k + 1)))) FROM (SELECT atan(abs(r) / sqrt(greatest(1 - r * r, 1e-300))) AS th))"
_FC = f"gl AS (SELECT gene_id, rep, tp, sum(value) AS v FROM expr GROUP BY ALL), sf AS (SELECT gene_id AS sf, rep, tp, v FROM gl WHERE gene_id IN (SELECT 'G' || s_suppkey FROM supplier WHERE s_nationkey < 3) AND gene_id IN (SELECT gene_id FROM gl GROUP BY gene_id HAVING var_pop(v) > 1)), ab AS (SELECT *, CASE WHEN sum(value) OVER w = 0 THEN 1.0 ELSE value / sum(value) OVER w END AS ab FROM expr WINDOW w AS (PARTITION BY gene_id, rep, tp)), mg AS (SELECT gene_id FROM expr GROUP BY gene_id HAVING count(DISTINCT transcript_id) > 1), cr AS (SELECT sf, gene_id, transcript_id, CASE WHEN var_pop(v) = 0 OR var_pop(ab) = 0 THEN NULL ELSE corr(v, ab) END AS r FROM ab JOIN sf USING (rep, tp) WHERE gene_id IN (SELECT gene_id FROM mg) GROUP BY sf, gene_id, transcript_id), ct AS (SELECT *, {_T19} AS p FROM cr WHERE r IS NOT NULL), ca AS (SELECT *, least(1.0, max(p * (n - i + 1) / n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM ct)), fc AS (SELECT sf, gene_id, transcript_id, r, p, adj, CASE WHEN r > 0 THEN '+' ELSE '-' END AS direction FROM ca WHERE abs(r) > 0.3 AND adj < 1.0), fs AS (SELECT cluster, direction, list_sort(list(DISTINCT sf)) AS sfs FROM fc JOIN gcl USING (gene_id) GROUP BY ALL)"
_BEST = f"{_SC}, bt AS (SELECT motif_id, doc_id, grp, round(max(s), 9) AS v FROM sc GROUP BY ALL HAVING max(s) IS NOT NULL)"


def _one_sided(x: str, y: str) -> str:
    """The rank test of large samples, with corrections for ties and continuity."""
    z = "((t2 / 2 - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))))"
    return f"(SELECT round(0.5 * {SQ.erfc_sql(z + ' / sqrt(2)')}, 6) FROM (SELECT (SELECT count(*) FROM bt WHERE motif_id = m.motif_id AND grp = '{x}') AS n1, (SELECT count(*) FROM bt WHERE motif_id = m.motif_id AND grp = '{y}') AS n2, (SELECT sum(CASE WHEN b.v < a.v THEN 2 WHEN b.v = a.v THEN 1 ELSE 0 END) FROM bt a JOIN bt b USING (motif_id) WHERE motif_id = m.motif_id AND a.grp = '{x}' AND b.grp = '{y}')::DOUBLE AS t2, (SELECT sum(c * c * c - c) FROM (SELECT count(*) AS c FROM bt WHERE motif_id = m.motif_id AND grp IN ('{x}', '{y}') GROUP BY v))::DOUBLE AS ties))"


#: Thresholds from a list of all words: th (motif_id, threshold, share).
_TH = (
    "bg AS (SELECT sum(len(regexp_replace(seq, '[^GC]', '', 'g')))::DOUBLE / sum(len(seq)) AS g FROM seqs), "
    "lo AS (SELECT motif_id, pos, b, CAST(round(log2(CASE WHEN o > 0 THEN o / b END) * 1000) AS BIGINT) AS q FROM (SELECT motif_id, pos, unnest([a, c, g, t]) AS o, unnest([(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2]) AS b FROM mn, (SELECT g AS gc FROM bg)) WHERE o > 0), "
    "ws AS (SELECT motif_id, w0.q + w1.q + w2.q + w3.q AS q, sum(w0.b * w1.b * w2.b * w3.b) AS p FROM lo w0 JOIN lo w1 USING (motif_id) JOIN lo w2 USING (motif_id) JOIN lo w3 USING (motif_id) WHERE w0.pos = 0 AND w1.pos = 1 AND w2.pos = 2 AND w3.pos = 3 GROUP BY ALL), "
    f"th AS (SELECT motif_id, min(q) / 1000.0 AS threshold, max(above) AS share FROM (SELECT motif_id, q, round(coalesce(sum(p) OVER (PARTITION BY motif_id ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12) AS above FROM ws) WHERE above <= {RATE} GROUP BY motif_id)"
)
_OVER = f"{_SC}, {_TH}, ov AS (SELECT motif_id, grp, doc_id, s FROM sc JOIN th USING (motif_id) WHERE s > threshold), cn AS (SELECT motif_id, round(s, 9) AS v, count(*) FILTER (grp = 'lost')::DOUBLE AS lost, count(*) FILTER (grp = 'gained')::DOUBLE AS gained, count(*) FILTER (grp = 'background')::DOUBLE AS background FROM ov GROUP BY ALL)"


def _one_sided_counts(x: str, y: str) -> str:
    """The same test from cn, the counts of each value."""
    z = "((t2 / 2 - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))))"
    below = f"SELECT *, coalesce(sum({y}) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y_below FROM cn WHERE motif_id = m.motif_id"
    return f"(SELECT CASE WHEN n1 * n2 = 0 THEN 1.0 ELSE round(0.5 * {SQ.erfc_sql(z + ' / sqrt(2)')}, 6) END FROM (SELECT sum({x}) AS n1, sum({y}) AS n2, sum({x} * (2 * y_below + {y})) AS t2, sum(power({x} + {y}, 3) - ({x} + {y})) AS ties FROM ({below})))"


_EXS = "es AS (SELECT gene_id, transcript_id, list(DISTINCT exon) AS x FROM ann GROUP BY ALL), ej AS (SELECT a.gene_id, a.transcript_id AS ma, b.transcript_id AS mi, list_filter(a.x, lambda v: NOT list_contains(b.x, v)) AS loss, list_filter(b.x, lambda v: NOT list_contains(a.x, v)) AS gain, list_filter(a.x, lambda v: list_contains(b.x, v)) AS constant FROM es a JOIN es b ON a.gene_id = b.gene_id AND a.transcript_id < b.transcript_id), el AS (SELECT * FROM ej QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY right(mi, 1) DESC, ma DESC, mi DESC) = 1)"
_CONF = "cf AS (SELECT event_id, gene_id, CASE WHEN abs(d[1]) >= abs(d[2]) THEN d[1] ELSE d[2] END AS c FROM (SELECT *, list_transform(string_split(delta, ';'), lambda x: CAST(x AS DOUBLE)) AS d, list_transform(string_split(prob, ';'), lambda x: CAST(x AS DOUBLE)) AS q FROM sev WHERE es) WHERE greatest(abs(d[1]), abs(d[2])) >= 0.05 AND greatest(q[1], q[2]) >= 0.95)"
_CHOSEN = "(SELECT source FROM (SELECT DISTINCT source FROM pw ORDER BY source LIMIT 6))"
ORACLE_SQL = {
    "motif_thresholds": V("seqs", f"{_MOT}, {_TH} SELECT motif_id, round(threshold, 6) AS threshold, round(share, 6) AS share FROM th"),
    "motif_threshold_groups": V("seqs", f"{_SC}, {_TH} SELECT motif_id, grp, CASE grp WHEN 'lost' THEN 'LE' WHEN 'gained' THEN 'GE' ELSE 'UE' END || ' (' || count(DISTINCT doc_id) || ')' AS label, count(DISTINCT doc_id) AS n_sequences, count(*) FILTER (s > threshold) AS n_hits, round(avg(s) FILTER (s > threshold), 6) AS mean_hit FROM sc JOIN th USING (motif_id) GROUP BY motif_id, grp"),
    "motif_tests": V("seqs", f"{_OVER} SELECT motif_id, {_one_sided_counts('lost', 'background')} AS lost_vs_background, {_one_sided_counts('gained', 'background')} AS gained_vs_background, {_one_sided_counts('lost', 'gained')} AS lost_vs_gained FROM (SELECT DISTINCT motif_id FROM cn) m"),
    "motif_best_tests": V("seqs", f"{_BEST} SELECT motif_id, {_one_sided('lost', 'background')} AS lost_vs_background, {_one_sided('gained', 'background')} AS gained_vs_background, {_one_sided('lost', 'gained')} AS lost_vs_gained FROM (SELECT DISTINCT motif_id FROM bt) m"),
    "factor_coexpression": V("expr", f"{_GCL}, {_FC} SELECT sf, gene_id, transcript_id, round(r, 6) AS corr, round(p, 6) AS p_value, round(adj, 6) AS adj_p, direction FROM fc"),
    "factor_sets": V("expr", f"{_GCL}, {_FC} SELECT cluster, direction, array_to_string(sfs, ',') AS sfs FROM fs"),
    "unique_factors": V("expr", f"{_GCL}, {_FC}, pn AS (SELECT cluster, coalesce(any_value(sfs) FILTER (direction = '+'), []) AS p, coalesce(any_value(sfs) FILTER (direction = '-'), []) AS n FROM fs GROUP BY cluster) SELECT cluster, array_to_string(list_filter(p, lambda v: list_contains(n, v)), ',') AS both, array_to_string(list_filter(p, lambda v: NOT list_contains(n, v)), ',') AS positive, array_to_string(list_filter(n, lambda v: NOT list_contains(p, v)), ',') AS negative FROM pn"),
    "balanced_factors": V("expr", f"{_GCL}, {_FC} SELECT gene_id, sf, CAST(0 AS BIGINT) AS net FROM fc GROUP BY gene_id, sf HAVING count(*) FILTER (direction = '+') = count(*) FILTER (direction = '-')"),
    "sequence_windows": V("exon seqs", "SELECT exon_id, '5p' AS site, substr(seq, greatest(1, s - 20), s + 20 - greatest(1, s - 20) + 1) AS seq FROM exon JOIN seqs ON exon.gene_id = 'G' || doc_id UNION ALL SELECT exon_id, '3p', substr(seq, greatest(1, e - 15), e + 15 - greatest(1, e - 15) + 1) FROM exon JOIN seqs ON exon.gene_id = 'G' || doc_id"),
    "exon_sets": V("ann", f"{_EXS} " + " UNION ALL ".join(f"SELECT DISTINCT gene_id, unnest({w}) AS exon, '{w}' AS which, '{m}' AS mode FROM {t}" for w in ("loss", "gain", "constant") for m, t in (("all", "ej"), ("last", "el")))),
    "composite_events": V("exon dom net", f"{_OV}, {_JO} SELECT gene_id, domain_id FROM af WHERE gene_id || '/' || domain_id IN (SELECT src FROM jo)"),
    "junction_exons": "SELECT a.event_id, 'G' || a.user_id AS gene_id, CAST(b.event_id + 10 AS VARCHAR) AS target, 'X' || b.event_id AS exon_id FROM events a, (VALUES (10), (25)) v(k), events b WHERE b.event_type = 'click' AND a.user_id = b.user_id AND a.event_id + k = b.event_id + 10",
    "standard_events": V("exon", "SELECT 'ENS' || gene_id AS gene_id, exon_id, s AS start, e AS \"end\", round((s % 11 - 5) / 50.0::DOUBLE, 6) AS delta FROM exon WHERE s % 7 <> 0 AND abs((s % 11 - 5) / 50.0::DOUBLE) >= 0.05"),
    "largest_changes": V("sev", f"{_CONF} SELECT event_id, round(c, 6) AS max_change FROM cf ORDER BY abs(round(c, 6)) DESC, event_id LIMIT 25"),
    "domain_links": V("exon dom net", f"{_OV}, {_JO} SELECT gene_id, exon_id, domain_id, gene_id || '/' || domain_id IN (SELECT x FROM jb) AS interacting, CASE WHEN gene_id || '/' || domain_id IN (SELECT x FROM jb) THEN 'https://example.org/exon/' || exon_id ELSE '' END AS link FROM ov"),
    "over_representation_cutoff": V("pw", _OR.replace("s_nationkey AS grp", "CAST(s_nationkey % 4 AS INT) AS grp") + " SELECT grp, pathway, hits, round(p, 6) AS p_value, round(q, 6) AS adj_p FROM orr WHERE q < 0.9"),
    "pathway_sources": V("exon dom net pw", f"{_PE}, pc AS (SELECT * FROM pe WHERE source IN {_CHOSEN}), rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM pc) SELECT pathway, source, round(p, 6) AS p_value, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS adj_p FROM rk"),
    "first_events": V("sev", f"{_CONF} SELECT gene_id, event_id FROM cf QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY abs(c) DESC, event_id) = 1"),
    "gene_expression": V("expr", "SELECT gene_id, transcript_id, rep, tp, round(value, 6) AS value FROM expr WHERE gene_id IN ('G1', 'G3', 'G5')"),
    "mean_interval": V("expr", "g AS (SELECT gene_id, rep, tp, sum(value) AS v FROM expr GROUP BY ALL), m AS (SELECT gene_id, tp, avg(v) AS m, 4.302652729749464 * stddev_samp(v) / sqrt(3) AS h FROM g GROUP BY ALL) SELECT gene_id, tp, round(m, 6) AS mean, round(m - h, 6) AS low, round(m + h, 6) AS high FROM m"),
    "switch_plot": "WITH RECURSIVE " + V("expr", f"{SQ._CAND}, ev AS (SELECT DISTINCT major_transcript AS transcript_id, 'major' AS role FROM cd WHERE p_value < 0.02 UNION SELECT DISTINCT minor_transcript, 'minor' FROM cd WHERE p_value < 0.02) SELECT gene_id, role, transcript_id, rep, tp, round(ab, 6) AS value FROM sh JOIN ev USING (transcript_id)")[5:],
    "cluster_matrix": V("net", f"{GQ._D}, {GQ._CL.replace('CAST(s_nationkey AS INT)', 'CAST(s_nationkey % 4 AS INT)')}, {GQ._connect('cl')} SELECT c1, " + ", ".join(f"round(max(CASE WHEN c2 = {k} THEN CASE WHEN o > 0 AND e > 0 THEN log2(o / e) ELSE 0.0 END END), 6) AS c{k}_odds" for k in range(4)) + " FROM al GROUP BY c1"),
    "exon_domain_overlap": V("exon dom", f"{_OV} SELECT * FROM ov"),
    "interacting_domains": V("exon dom net", f"{_OV}, {_JO} SELECT gene_id, domain_id, gene_id || '/' || domain_id IN (SELECT x FROM jb) AS interacting FROM af"),
    "affected_edges": V("exon dom net", f"{_AE} SELECT * FROM ae"),
    "gene_edges": V("exon dom net", f"{_AE} SELECT gene_id, count(*) AS n, string_agg(neighbour, ',' ORDER BY neighbour) AS neighbours FROM ae GROUP BY gene_id"),
    "pathway_degree": V("pw net", f"{_PD} SELECT pathway, CAST(degree AS BIGINT) AS degree FROM pd"),
    "pathway_enrichment": V("exon dom net pw", f"{_PE} SELECT pathway, source, CAST(degree AS BIGINT) AS degree, CAST(inside AS BIGINT) AS inside, CAST(outside AS BIGINT) AS outside, round(p, 6) AS p_value, gene_count FROM pe"),
    "pathway_adjusted": V("exon dom net pw", f"{_PE}, rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM pe) SELECT pathway, round(p, 6) AS p_value, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS adj_p, round(CASE WHEN p < 0.05 THEN -(sqrt(gene_count) * log10(greatest(p, 1e-300))) ELSE 0.0 END, 6) AS score FROM rk"),
    "pathway_drilldown": V("exon dom net pw", f"{_GC} SELECT gt.gene_id, gt.gene_id IN (SELECT gene_id FROM pw WHERE pathway = 'Brand#11') AS member, inside || '/' || (inside + outside) AS share, round(gp, 6) AS p_value, (SELECT string_agg(DISTINCT neighbour, ',' ORDER BY neighbour) FROM ae WHERE ae.gene_id = gt.gene_id AND neighbour IN (SELECT gene_id FROM pw WHERE pathway = 'Brand#11')) AS neighbours FROM gt WHERE pathway = 'Brand#11'"),
    "affected_stats": V("exon dom net", f"{_OV}, {_JO} SELECT count(DISTINCT gene_id) AS genes, (SELECT count(DISTINCT gene_id) FROM exon) AS spliced, round(count(DISTINCT gene_id) / (SELECT count(DISTINCT gene_id) FROM exon), 2) AS gene_share, round(count(*) FILTER (gene_id || '/' || domain_id IN (SELECT x FROM jb)) / count(*), 2) AS domain_share FROM af"),
    "over_representation": V("pw", f"{_OR} SELECT grp, pathway, hits, size, drawn, round(p, 6) AS p_value, round(q, 6) AS adj_p FROM orr"),
    "top_by_group": V("pw", f"{_OR}, r6 AS (SELECT grp, pathway, round(p, 6) AS p_value, row_number() OVER (PARTITION BY grp ORDER BY round(p, 6), pathway) AS k FROM orr) SELECT grp, pathway, p_value FROM r6 WHERE k <= 3"),
    "majiq_filter": V("sev", "l AS (SELECT *, list_transform(string_split(delta, ';'), lambda x: CAST(x AS DOUBLE)) AS d, list_transform(string_split(prob, ';'), lambda x: CAST(x AS DOUBLE)) AS q FROM sev WHERE es) SELECT event_id, gene_id, round(CASE WHEN abs(d[1]) >= abs(d[2]) THEN d[1] ELSE d[2] END, 6) AS max_change FROM l WHERE greatest(abs(d[1]), abs(d[2])) >= 0.05 AND greatest(q[1], q[2]) >= 0.95"),
    "majiq_explode": "SELECT event_id, CAST(event_id AS VARCHAR) AS source, CAST(event_id + k AS VARCHAR) AS target FROM events, (VALUES (10), (25)) v(k)",
    "gc_fraction": V("seqs", "SELECT doc_id, round(len(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / len(seq), 2) AS gc FROM seqs"),
    "pssm_scan": V("seqs", f"{_SC} SELECT doc_id, motif_id, CAST(count(*) FILTER (s > {THRESHOLD}) AS INT) AS n_hits, round(max(s), 6) AS best FROM sc GROUP BY ALL"),
    "motif_groups": V("seqs", f"{_SC} SELECT motif_id, grp, CASE grp WHEN 'lost' THEN 'LE' WHEN 'gained' THEN 'GE' ELSE 'UE' END || ' (' || count(DISTINCT doc_id) || ')' AS label, count(DISTINCT doc_id) AS n_sequences, count(*) FILTER (s > {THRESHOLD}) AS n_hits, round(avg(s) FILTER (s > {THRESHOLD}), 6) AS mean_hit FROM sc GROUP BY motif_id, grp"),
    "cluster_lines": V("lser", "SELECT cluster, 'object' AS kind, object_idx, tp, round(value, 6) AS value FROM lser UNION ALL SELECT cluster, 'prototype', NULL, tp, round(median(value), 6) FROM lser GROUP BY cluster, tp"),
    "heat_map": V("lser", "SELECT object_idx, cluster, tp, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS value FROM lser WINDOW w AS (PARTITION BY object_idx)"),
    "one_cluster": V("expr", "SELECT gene_id, tp, round(avg(value), 6) AS value FROM expr JOIN supplier ON gene_id = 'G' || s_suppkey AND s_nationkey = 3 GROUP BY ALL"),
    "top_terms": V("exon dom net pw", f"{_PE} SELECT pathway, round(p, 6) AS p_value FROM pe ORDER BY 2, 1 LIMIT 10"),
    "affected_marks": V("exon dom net", f"{_AE}, mk AS (SELECT DISTINCT least(gene_id, neighbour) AS src, greatest(gene_id, neighbour) AS dst FROM ae) SELECT net.src, net.dst, mk.src IS NOT NULL AS affected FROM net LEFT JOIN mk USING (src, dst)"),
    "pathway_subgraph": V("exon pw net", "k AS (SELECT n, bool_or(p) AS p, bool_or(NOT p) AS s FROM (SELECT DISTINCT gene_id AS n, true AS p FROM pw WHERE pathway = 'Brand#11' UNION ALL SELECT DISTINCT gene_id, false FROM exon) GROUP BY n), c AS (SELECT n, CASE WHEN p AND s THEN 'both' WHEN p THEN 'pathway' ELSE 'spliced' END AS c FROM k) SELECT src, dst, a.c AS src_class, b.c AS dst_class FROM net JOIN c a ON src = a.n JOIN c b ON dst = b.n WHERE a.c <> 'spliced' OR b.c <> 'spliced'"),
    "node_classes": V("ann net expr", "n AS (SELECT DISTINCT unnest([src, dst]) AS node FROM net) SELECT node, CASE WHEN node IN (SELECT gene_id FROM ann WHERE gene_id IN (SELECT gene_id FROM expr)) THEN 'domain switch' ELSE 'interactor' END AS class FROM n"),
    "cluster_merge_lines": V("lser", "m AS (SELECT CASE WHEN cluster = 2 THEN 1 ELSE cluster END AS cluster, tp, median(value) AS v FROM lser GROUP BY ALL) SELECT cluster, round(var_pop(v), 9) AS variance FROM m GROUP BY cluster"),
}
