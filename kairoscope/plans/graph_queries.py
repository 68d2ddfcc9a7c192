"""Queries on networks, connectivity and modules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.operators import graph as G
from kairoscope.operators import modules as M
from kairoscope.sources import tables as T
from kairoscope.sources.tables import with_views as V

R6 = lambda c: F.round(c, 6)


def _clusters(spark, d, column="s_nationkey"):
    return T.table(spark, d, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("node"), F.col(column).cast("int").alias("cluster"))


def _second(spark, d):
    return T.table(spark, d, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("node"), F.floor(F.col("s_acctbal") / 1000).cast("int").alias("cluster"))


def _active(spark, d):
    return T.table(spark, d, "supplier").where("s_acctbal > 7000").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("node"))


def degree(spark, d):
    return G.degrees(T.network(spark, d))


def degree_hist(spark, d):
    return G.degree_histogram(T.network(spark, d))


def max_degree(spark, d):
    return G.max_degree(T.network(spark, d))


def edges_by_degree_pair(spark, d):
    return G.edges_by_degree(T.network(spark, d))


def edge_prob(spark, d):
    return G.edge_probability(T.network(spark, d)).select("d1", "d2", R6("prob").alias("prob"))


def observed_cluster_edges(spark, d):
    return G.observed_edges(T.network(spark, d), _clusters(spark, d))


def expected_cluster_edges(spark, d):
    return G.expected_edges(T.network(spark, d), _clusters(spark, d)).select("c1", "c2", R6("expected").alias("expected"))


def connectivity_enrichment(spark, d):
    c = G.connectivity(T.network(spark, d), _clusters(spark, d))
    return c.select("c1", "c2", "observed", R6("expected").alias("expected"), R6("log_odds").alias("log_odds"), R6("normalised").alias("normalised"))


def connectivity_two(spark, d):
    c = G.connectivity(T.network(spark, d), _clusters(spark, d), _second(spark, d))
    return c.select("c1", "c2", "observed", R6("expected").alias("expected"), R6("log_odds").alias("log_odds"))


def induced_slice_edges(spark, d):
    return G.induced(T.network(spark, d), _clusters(spark, d), "cluster")


def modularity(spark, d):
    return G.modularity(T.network(spark, d), _clusters(spark, d)).select(R6("modularity").alias("modularity"))


def connected_components(spark, d):
    inner = G.induced(T.network(spark, d), _clusters(spark, d), "cluster")
    return G.connected_components(inner.select("src", "dst"))


def diffusion_layers(spark, d):
    return G.diffusion(T.network(spark, d), _active(spark, d), 20)


def shortest_paths(spark, d):
    return G.distances(T.network(spark, d), _active(spark, d).withColumnRenamed("node", "source"))


def top_degree(spark, d):
    return G.top_degree(T.network(spark, d), 15)


def rank_degree(spark, d):
    return G.rank_degree(T.network(spark, d))


def slice_enrichment(spark, d):
    parts = _clusters(spark, d).withColumnRenamed("cluster", "slice_id")
    out = M.slice_enrichment(T.network(spark, d), parts, _active(spark, d))
    return out.select("slice_id", "nodes", "hits", R6("p").alias("p"), R6("q").alias("q"), "kept")


def network_slices(spark, d):
    return M.slices(T.network(spark, d), 1.0)


def active_modules(spark, d):
    net = T.network(spark, d)  # drawn at random, so thresholds that let its modules through
    return M.find_modules(net, _active(spark, d), 1.0, 10.0, parts=M.slices(net, 1.0))


def module_summary(spark, d):
    return M.module_summary(_clusters(spark, d).withColumnRenamed("cluster", "module_id")).select("modules", R6("mean_size").alias("mean_size"), R6("sd_size").alias("sd_size"))


def module_quality(spark, d):
    q = M.module_quality(_clusters(spark, d).withColumnRenamed("cluster", "module_id"), _active(spark, d))
    return q.select("module_id", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"))


def modules_of_nodes(spark, d):
    return M.modules_of_nodes(_clusters(spark, d).select("node", F.col("cluster").cast("string").alias("module_id")).union(_second(spark, d).select("node", F.concat(F.lit("b"), F.col("cluster").cast("string")))))


QUERIES = {f.__name__: f for f in (degree, degree_hist, max_degree, edges_by_degree_pair, edge_prob, observed_cluster_edges, expected_cluster_edges, connectivity_enrichment, connectivity_two, induced_slice_edges, modularity, connected_components, diffusion_layers, shortest_paths, top_degree, rank_degree, slice_enrichment, network_slices, active_modules, module_summary, module_quality, modules_of_nodes)}

_D = "bw AS (SELECT src AS n, dst AS o FROM net UNION ALL SELECT dst, src FROM net), dg AS (SELECT n, count(*) AS d FROM bw GROUP BY n), hi AS (SELECT d, count(*) AS k FROM dg GROUP BY d), ed AS (SELECT least(a.d, b.d) AS d1, greatest(a.d, b.d) AS d2, count(*) AS e FROM net JOIN dg a ON src = a.n JOIN dg b ON dst = b.n GROUP BY ALL), ep AS (SELECT d1, d2, e / CASE WHEN d1 = d2 THEN x.k * (x.k - 1) / 2.0 + x.k ELSE x.k * y.k END AS p FROM ed JOIN hi x ON d1 = x.d JOIN hi y ON d2 = y.d)"
_CL = "cl AS (SELECT 'G' || s_suppkey AS n, CAST(s_nationkey AS INT) AS c FROM supplier)"
_C2 = "c2l AS (SELECT 'G' || s_suppkey AS n, CAST(floor(s_acctbal / 1000) AS INT) AS c FROM supplier)"
_ACT = "act AS (SELECT 'G' || s_suppkey AS n FROM supplier WHERE s_acctbal > 7000)"


def _connect(right: str) -> str:
    """Node by node, unlike the operator's histograms."""
    pairs = "SELECT a.c AS c1, b.c AS c2, a.n AS x, b.n AS y, 1.0 AS w FROM cl a JOIN cl b ON a.c <> b.c OR a.n < b.n" if right == "cl" else "SELECT a.c AS c1, b.c AS c2, a.n AS x, b.n AS y, CASE WHEN a.c = b.c THEN 0.5 ELSE 1.0 END AS w FROM cl a, c2l b"
    return f"nn AS ({pairs}), ob AS (SELECT a.c AS c1, b.c AS c2, CASE WHEN a.c = b.c THEN count(*) / 2.0 ELSE count(*) END::DOUBLE AS o FROM bw JOIN cl a ON bw.n = a.n JOIN {right} b ON bw.o = b.n GROUP BY a.c, b.c), ex AS (SELECT c1, c2, sum(p * w) AS e FROM nn JOIN dg a ON x = a.n JOIN dg b ON y = b.n JOIN ep ON d1 = least(a.d, b.d) AND d2 = greatest(a.d, b.d) GROUP BY ALL), gr AS (SELECT a.c AS c1, b.c AS c2, a.s + b.s AS s FROM (SELECT c, count(*) AS s FROM cl GROUP BY c) a, (SELECT c, count(*) AS s FROM {right} GROUP BY c) b), al AS (SELECT c1, c2, s, coalesce(o, 0.0) AS o, coalesce(e, 0.0) AS e FROM gr LEFT JOIN ob USING (c1, c2) LEFT JOIN ex USING (c1, c2))"


from kairoscope.plans.switch_queries import tail_sql  # noqa: E402

_IN = "ie AS (SELECT a.c AS cluster, src, dst FROM net JOIN cl a ON src = a.n JOIN cl b ON dst = b.n AND a.c = b.c)"
_REACH = f"{_IN}, ib AS (SELECT src AS x, dst AS y FROM ie UNION ALL SELECT dst, src FROM ie), re AS (SELECT DISTINCT x AS n, x AS m FROM ib UNION SELECT re.n, ib.y FROM re JOIN ib ON re.m = ib.x), co AS (SELECT n AS node, min(m) AS component FROM re GROUP BY n)"
ORACLE_SQL = {
    "degree": V("net", f"{_D} SELECT n AS node, d AS degree FROM dg"),
    "degree_hist": V("net", f"{_D} SELECT d AS degree, k AS nodes FROM hi"),
    "max_degree": V("net", f"{_D} SELECT max(d) AS max_degree FROM dg"),
    "edges_by_degree_pair": V("net", f"{_D} SELECT d1, d2, e AS edges FROM ed"),
    "edge_prob": V("net", f"{_D} SELECT d1, d2, round(p::DOUBLE, 6) AS prob FROM ep"),
    "observed_cluster_edges": V("net", f"{_D}, {_CL}, {_connect('cl')} SELECT c1, c2, o AS observed FROM ob"),
    "expected_cluster_edges": V("net", f"{_D}, {_CL}, {_connect('cl')} SELECT c1, c2, round(e::DOUBLE, 6) AS expected FROM ex WHERE e > 0 UNION SELECT a.c, a.c, 0.0 FROM cl a JOIN dg ON a.n = dg.n JOIN ep ON d1 = d AND d2 = d GROUP BY a.c HAVING NOT EXISTS (SELECT 1 FROM ex x WHERE x.c1 = a.c AND x.c2 = a.c)"),
    "connectivity_enrichment": V("net", f"{_D}, {_CL}, {_connect('cl')} SELECT c1, c2, o AS observed, round(e::DOUBLE, 6) AS expected, round(CASE WHEN o > 0 AND e > 0 THEN log2(o / e) ELSE 0.0 END, 6) AS log_odds, round(CASE WHEN o > 0 AND e > 0 THEN log2(o / e) ELSE 0.0 END / s, 6) AS normalised FROM al"),
    "connectivity_two": V("net", f"{_D}, {_CL}, {_C2}, {_connect('c2l')} SELECT c1, c2, o AS observed, round(e::DOUBLE, 6) AS expected, round(CASE WHEN o > 0 AND e > 0 THEN log2(o / e) ELSE 0.0 END, 6) AS log_odds FROM al"),
    "induced_slice_edges": V("net", f"{_CL}, {_IN} SELECT cluster, src, dst FROM ie"),
    "modularity": V("net", f"{_D}, {_CL}, {_IN}, m AS (SELECT count(*)::DOUBLE AS m FROM net), vo AS (SELECT c, sum(d) AS v FROM cl JOIN dg USING (n) GROUP BY c), is_ AS (SELECT cluster AS c, count(*) AS i FROM ie GROUP BY ALL) SELECT round(sum(coalesce(i, 0) / m - (v / (2 * m)) * (v / (2 * m))), 6) AS modularity FROM vo LEFT JOIN is_ USING (c), m"),
    "connected_components": "WITH RECURSIVE " + V("net", f"{_CL}, {_REACH} SELECT node, component FROM co")[5:],
    "shortest_paths": "WITH RECURSIVE " + V("net", f"{_D}, {_ACT}, sp AS (SELECT n AS source, n AS node, 0 AS distance FROM act UNION SELECT source, o, distance + 1 FROM sp JOIN bw ON node = n WHERE distance < 12) SELECT source, node, CAST(min(distance) AS INT) AS distance FROM sp GROUP BY ALL")[5:],
    "top_degree": V("net", f"{_D} SELECT n AS node, d AS degree FROM dg ORDER BY d DESC, n LIMIT 15"),
    "rank_degree": V("net", f"{_D} SELECT d AS degree, k AS nodes, CAST(sum(k) OVER (ORDER BY d DESC) AS BIGINT) AS at_least FROM hi"),
    "diffusion_layers": "WITH RECURSIVE " + V("net", f"{_D}, {_ACT}, df AS (SELECT 0 AS it, n AS node, 0 AS layer FROM act UNION ALL (SELECT it + 1, node, layer FROM df WHERE it < 20 UNION ALL SELECT min(it) + 1, dg.n, CAST(min(it) + 1 AS INT) FROM df JOIN bw ON node = bw.n JOIN dg ON dg.n = bw.o WHERE it < 20 AND bw.o NOT IN (SELECT node FROM df) GROUP BY dg.n, dg.d HAVING count(*) / dg.d >= 0.5)) SELECT node, layer FROM df WHERE it = 20")[5:],
    "slice_enrichment": "WITH RECURSIVE " + V("net", f"{_D}, {_CL}, {_ACT}, {_REACH}, tt AS (SELECT count(*) AS n FROM dg), kk AS (SELECT count(*) AS k FROM act SEMI JOIN cl USING (n)), sm AS (SELECT component AS slice_id, count(*) AS nodes, count(act.n) AS hits FROM co LEFT JOIN act ON node = act.n GROUP BY component), ft AS (SELECT sm.*, n, k FROM sm, tt, kk WHERE nodes >= 4 AND hits > 0 AND (hits / nodes >= least(0.7, k / n * (1 + 100 / sqrt(n))) OR hits / k >= 0.1)), ts AS (SELECT *, {tail_sql('n', 'k', 'nodes', 'hits')} AS p FROM ft), rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS c FROM ts), qq AS (SELECT *, least(1.0, min(p * c / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM rk) SELECT slice_id, nodes, hits, round(p, 6) AS p, round(q, 6) AS q, q <= 0.3 AS kept FROM qq")[5:],
    "module_summary": f"WITH {_CL}, s AS (SELECT c, count(*) AS n FROM cl GROUP BY c) SELECT count(*) AS modules, round(avg(n), 6) AS mean_size, round(stddev_samp(n), 6) AS sd_size FROM s",
    "module_quality": f"WITH {_CL}, {_ACT}, t AS (SELECT count(*) AS t FROM act), h AS (SELECT c, count(*) AS n, count(act.n) AS h FROM cl LEFT JOIN act USING (n) GROUP BY c) SELECT c AS module_id, round(h / n, 6) AS precision, round(CASE WHEN t = 0 THEN 0.0 ELSE h / t END, 6) AS recall, round(CASE WHEN h = 0 THEN 0.0 ELSE 2 * (h / n) * (h / t) / (h / n + h / t) END, 6) AS f1 FROM h, t",
    "modules_of_nodes": f"WITH {_CL}, {_C2}, u AS (SELECT n, CAST(c AS VARCHAR) AS m FROM cl UNION SELECT n, 'b' || c FROM c2l) SELECT n AS node, string_agg(m, ',' ORDER BY m) AS modules FROM u GROUP BY n",
}
