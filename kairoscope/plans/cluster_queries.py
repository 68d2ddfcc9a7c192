"""Queries on clusters and their indices, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.operators import cluster as C
from kairoscope.sources import tables as T
from kairoscope.sources.tables import with_views as V

R6 = lambda c: F.round(c, 6)


def _genes(spark, d):
    """Genes as series of their time points (median of replicates), clustered by the nation of the supplier."""
    e = T.gene_expression(spark, d).groupBy("gene_id", "tp").agg(F.median("value").alias("v"))
    packed = e.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("tp", "v"))).alias("c"))
    supplier = T.table(spark, d, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene_id"), F.col("s_suppkey").alias("object_idx"), (F.col("s_nationkey") + 1).cast("int").alias("cluster"))
    return packed.join(supplier, "gene_id").select("object_idx", "gene_id", "cluster", F.col("c.v").alias("vals"))


def prototype_median(spark, d):
    return C.prototypes(T.series(spark, d)).select("cluster", "tp", R6("value").alias("value"))


def prototype_mean(spark, d):
    return C.prototypes(T.series(spark, d), "mean").select("cluster", "tp", R6("value").alias("value"))


def prototype_variance(spark, d):
    return C.prototype_variance(T.series(spark, d)).select("cluster", F.round("variance", 9).alias("variance"))


def cluster_sizes(spark, d):
    return C.sizes(T.series(spark, d))


def cluster_similarity(spark, d):
    return C.similarity(T.series(spark, d)).select("cluster", R6("similarity").alias("similarity"))


def euclidean_pairs(spark, d):
    return C.pair_distances(_genes(spark, d)).select("i", "j", R6("distance").alias("distance"))


def correlation_pairs(spark, d):
    return C.pair_distances(_genes(spark, d), "correlation").select("i", "j", R6("distance").alias("distance"))


def softdtw_pairs(spark, d):
    return C.pair_distances(_genes(spark, d), "softdtw").select("i", "j", R6("distance").alias("distance"))


def prototype_corr(spark, d):
    return C.prototype_pairs(T.series(spark, d)).select("c1", "c2", R6("corr").alias("corr"), R6("distance").alias("distance"))


def merge_candidates(spark, d):
    return C.merge_candidates(_genes(spark, d), 0.5).select("c1", "c2", R6("corr").alias("corr"))


def silhouette(spark, d):
    return C.silhouette(T.series(spark, d)).select(R6("silhouette").alias("silhouette"))


def silhouette_objects(spark, d):
    return C.silhouettes(_genes(spark, d), "correlation").select("object_idx", "cluster", R6("silhouette").alias("silhouette"))


def davies_bouldin(spark, d):
    return C.davies_bouldin(T.series(spark, d)).select(R6("davies_bouldin").alias("davies_bouldin"))


def dunn(spark, d):
    return C.dunn(T.series(spark, d)).select(R6("dunn").alias("dunn"))


def _labels(spark, d):
    return T.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus")


def rand_index(spark, d):
    return C.adjusted_rand(_labels(spark, d), "o_orderpriority", "o_orderstatus").select(F.round("adjusted_rand", 9).alias("adjusted_rand"))


def mutual_information(spark, d):
    return C.adjusted_mutual_information(T.table(spark, d, "supplier").withColumn("sign", F.col("s_acctbal") > 5000), "s_nationkey", "sign").select(*(F.round(c, 6).alias(c) for c in ("mi", "ha", "hb", "emi", "adjusted_mi")))


def jaccard(spark, d):
    sets = T.annotations(spark, d).groupBy("gene_id", "transcript_id").agg(F.collect_set("exon").alias("x"))
    a, b = sets.select("gene_id", F.col("transcript_id").alias("tx1"), F.col("x").alias("p")), sets.select("gene_id", F.col("transcript_id").alias("tx2"), F.col("x").alias("q"))
    return a.join(b, "gene_id").where("tx1 < tx2").select("gene_id", "tx1", "tx2", R6(C.jaccard(F.col("p"), F.col("q"))).alias("jaccard"))


def combine_clusters(spark, d):
    return C.sizes(C.combine(T.series(spark, d), [1, 2, 3]))


def _algorithm(name, k=4, **options):
    def query(spark, d):
        return C.find_clusters(_genes(spark, d).drop("gene_id", "cluster"), name, k, **options)

    return query


def split_cluster(spark, d):
    return C.split(T.series(spark, d), 1, 3).select("object_idx", "cluster")


def composite_distance(spark, d):
    return C.composite_distance(_genes(spark, d), T.network(spark, d)).select("i", "j", R6("distance").alias("distance"))


def _dataset(spark, d):
    return T.gene_expression(spark, d).withColumn("object_idx", F.substring("gene_id", 2, 20).cast("long"))


def clustering_facade(spark, d):
    found = C.cluster_dataset(_dataset(spark, d), "hierarchical", 3, linkage="ward")
    sizes = C.sizes(found.series).join(C.prototype_variance(found.series), "cluster")
    return sizes.crossJoin(found.silhouette).crossJoin(found.davies_bouldin).select("cluster", "size", R6("variance").alias("variance"), R6("silhouette").alias("silhouette"), R6("davies_bouldin").alias("davies_bouldin"))  # one row each


def cluster_significance(spark, d):
    return C.significance(_genes(spark, d)).select("cluster", "n", R6("p").alias("p"), R6("q").alias("q"))


QUERIES = {f.__name__: f for f in (clustering_facade, cluster_significance, prototype_median, prototype_mean, prototype_variance, cluster_sizes, cluster_similarity, euclidean_pairs, correlation_pairs, softdtw_pairs, prototype_corr, merge_candidates, silhouette, silhouette_objects, davies_bouldin, dunn, rand_index, mutual_information, jaccard, combine_clusters, split_cluster, composite_distance)} | {
    "cluster_hierarchical": _algorithm("hierarchical", linkage="ward"),
    "cluster_kmeans": _algorithm("kmeans"),
    "cluster_kmedoids": _algorithm("kmedoids"),
    "cluster_clara": _algorithm("clara"),
    "cluster_dbscan": _algorithm("dbscan", eps=400.0, least=3),
    "cluster_optics": _algorithm("optics", eps=400.0, least=3),
}

_G = "gs AS (SELECT gene_id, rep, tp, sum(value) AS v FROM expr GROUP BY ALL), gm AS (SELECT gene_id, tp, median(v) AS v FROM gs GROUP BY ALL), gp AS (SELECT s_suppkey AS object_idx, CAST(s_nationkey + 1 AS INT) AS cluster, list(v ORDER BY tp) AS vals FROM gm JOIN supplier ON gene_id = 'G' || s_suppkey GROUP BY ALL)"
_EUC = "sqrt(list_sum(list_transform(range(1, len(a.vals) + 1), lambda k: (a.vals[k] - b.vals[k]) * (a.vals[k] - b.vals[k]))))"
_COR = "(SELECT CASE WHEN var_pop(x) = 0 OR var_pop(y) = 0 THEN 0.0 ELSE 1 - corr(x, y) END FROM (SELECT unnest(a.vals) AS x, unnest(b.vals) AS y))"
_PM = "pm AS (SELECT cluster, tp, avg(value) AS v FROM lser GROUP BY ALL), pl AS (SELECT cluster, list(v ORDER BY tp) AS vals FROM pm GROUP BY ALL), sd AS (SELECT a.cluster, avg(" + _EUC + ") AS s, 2 * max(" + _EUC + ") AS w FROM ser a JOIN pl b ON a.cluster = b.cluster GROUP BY a.cluster)"
_MED = "md AS (SELECT cluster, tp, median(value) AS v FROM lser GROUP BY ALL)"
_SIL = "dd AS (SELECT a.object_idx AS i, a.cluster AS ci, b.object_idx AS j, b.cluster AS cj, {dist} AS x FROM {t} a JOIN {t} b ON a.object_idx <> b.object_idx), mm AS (SELECT i, ci, cj, avg(x) AS m FROM dd GROUP BY ALL), ab AS (SELECT i, ci, min(m) FILTER (ci = cj) AS a, min(m) FILTER (ci <> cj) AS b FROM mm GROUP BY ALL), ss AS (SELECT i, ci, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"
_SOFT = "least(prev[j], prev[j + 1], acc[j])"
_SOFTDTW = f"list_reduce(range(1, {T.TIMEPOINTS + 1}), lambda prev, i: list_reduce(range(1, {T.TIMEPOINTS + 1}), lambda acc, j: list_append(acc, (a.vals[i] - b.vals[j]) * (a.vals[i] - b.vals[j]) + {_SOFT} - ln(exp({_SOFT} - prev[j]) + exp({_SOFT} - prev[j + 1]) + exp({_SOFT} - acc[j]))), ['Infinity'::DOUBLE]), list_concat([0.0::DOUBLE], list_transform(range({T.TIMEPOINTS}), lambda x: 'Infinity'::DOUBLE)))[{T.TIMEPOINTS + 1}]"
#: Ward's agglomeration by centroids: each round joins the two groups whose union costs least, until {k} are left.
_WARD = "wd AS (SELECT 0 AS it, object_idx AS cid, 1.0::DOUBLE AS n, vals AS total, [object_idx] AS members, count(*) OVER () AS c FROM gp UNION ALL SELECT it + 1, CASE WHEN cid = m.y THEN m.x ELSE cid END, sum(n), list_transform(range(1, " + str(T.TIMEPOINTS + 1) + "), lambda k: list_sum(list_transform(list(total), lambda t: t[k]))), flatten(list(members)), min(c) - 1 FROM wd, (SELECT p.cid AS x, q.cid AS y FROM wd p JOIN wd q ON p.cid < q.cid ORDER BY p.n * q.n / (p.n + q.n) * list_sum(list_transform(range(1, " + str(T.TIMEPOINTS + 1) + "), lambda k: (p.total[k] / p.n - q.total[k] / q.n) * (p.total[k] / p.n - q.total[k] / q.n))), x, y LIMIT 1) m WHERE c > {k} GROUP BY it, CASE WHEN cid = m.y THEN m.x ELSE cid END), wl AS (SELECT unnest(members) AS object_idx, dense_rank() OVER (ORDER BY cid) AS cluster FROM wd WHERE it = (SELECT max(it) FROM wd))"
_CLOSE = "bw AS (SELECT src AS n, dst AS o FROM net UNION ALL SELECT dst, src FROM net), sp AS (SELECT DISTINCT gene_id AS s, gene_id AS n, 0 AS x FROM gg UNION SELECT s, o, x + 1 FROM sp JOIN bw USING (n) WHERE x < 12), sd AS (SELECT s, n, min(x) AS x FROM sp GROUP BY ALL), cn AS (SELECT s, n, CASE WHEN (SELECT max(x) FROM sd) = 0 THEN 0.0 ELSE ((SELECT max(x) FROM sd) - x) / (SELECT max(x) FROM sd)::DOUBLE END AS close FROM sd)"
_NEAR = f"nr AS (SELECT a.object_idx AS x, b.object_idx AS y FROM gp a JOIN gp b ON a.object_idx <> b.object_idx AND {_EUC} <= 400), kr AS (SELECT x FROM nr GROUP BY x HAVING count(*) + 1 >= 3), kl AS (SELECT x, y FROM nr WHERE x IN (FROM kr) AND y IN (FROM kr)), re AS (SELECT x AS n, x AS m FROM kr UNION SELECT n, y FROM re JOIN kl ON m = x), cr AS (SELECT n, min(m) AS component FROM re GROUP BY n), pl AS (SELECT n, component FROM cr UNION ALL SELECT x, min(component) FROM nr JOIN cr ON y = cr.n WHERE x NOT IN (SELECT n FROM cr) GROUP BY x), nb AS (SELECT component, row_number() OVER (ORDER BY component) AS cluster FROM (SELECT DISTINCT component FROM cr))"
#: Core objects in components of mutual reachability up to 400; others go to the core object that reaches them from least.
_REACH = f"nr AS (SELECT a.object_idx AS x, b.object_idx AS y, {_EUC} AS d FROM gp a JOIN gp b ON a.object_idx <> b.object_idx AND {_EUC} <= 400), kr AS (SELECT x, list_sort(list(d))[2] AS core FROM nr GROUP BY x HAVING count(*) + 1 >= 3), kl AS (SELECT nr.x, nr.y FROM nr JOIN kr p ON nr.x = p.x JOIN kr q ON nr.y = q.x WHERE greatest(d, p.core, q.core) <= 400), re AS (SELECT x AS n, x AS m FROM kr UNION SELECT n, y FROM re JOIN kl ON m = x), cr AS (SELECT n, min(m) AS component FROM re GROUP BY n), bo AS (SELECT nr.x, arg_min(y, (greatest(d, core), y)) AS y FROM nr JOIN kr ON y = kr.x WHERE nr.x NOT IN (SELECT x FROM kr) GROUP BY nr.x), pl AS (SELECT n, component FROM cr UNION ALL SELECT bo.x, component FROM bo JOIN cr ON bo.y = cr.n), nb AS (SELECT component, row_number() OVER (ORDER BY component) AS cluster FROM (SELECT DISTINCT component FROM cr))"
ORACLE_SQL = {
    "cluster_optics": "WITH RECURSIVE " + V("expr", f"{_G}, {_REACH} SELECT object_idx, CAST(coalesce(nb.cluster, 0) AS INT) AS cluster FROM gp LEFT JOIN pl ON n = object_idx LEFT JOIN nb USING (component)")[5:],
    "softdtw_pairs": V("expr", f"{_G} SELECT a.object_idx AS i, b.object_idx AS j, round({_SOFTDTW}, 6) AS distance FROM gp a JOIN gp b ON a.object_idx < b.object_idx"),
    "cluster_hierarchical": "WITH RECURSIVE " + V("expr", f"{_G}, {_WARD.format(k=4)} SELECT object_idx, CAST(cluster AS INT) AS cluster FROM wl")[5:],
    "clustering_facade": "WITH RECURSIVE " + V("expr", f"{_G.replace('JOIN supplier ON', 'JOIN supplier ON')}, {_WARD.format(k=3)}, lb AS (SELECT object_idx, CAST(wl.cluster AS INT) AS cluster, vals FROM gp JOIN wl USING (object_idx)), {_SIL.format(dist=_EUC, t='lb')}, un AS (SELECT cluster, unnest(range({T.TIMEPOINTS})) AS tp, unnest(vals) AS value FROM lb), pm AS (SELECT cluster, tp, avg(value) AS v FROM un GROUP BY ALL), pl AS (SELECT cluster, list(v ORDER BY tp) AS vals FROM pm GROUP BY ALL), sd AS (SELECT a.cluster, avg({_EUC}) AS s FROM lb a JOIN pl b ON a.cluster = b.cluster GROUP BY a.cluster), w AS (SELECT p.cluster, max((x.s + y.s) / {_EUC.replace('a.', 'p.').replace('b.', 'q.')}) AS r FROM pl p JOIN pl q ON p.cluster <> q.cluster JOIN sd x ON x.cluster = p.cluster JOIN sd y ON y.cluster = q.cluster GROUP BY p.cluster), md AS (SELECT cluster, tp, median(value) AS v FROM un GROUP BY ALL) SELECT cluster, (SELECT count(*) FROM lb WHERE lb.cluster = md.cluster) AS size, round(var_pop(v), 6) AS variance, (SELECT round(avg(s), 6) FROM ss) AS silhouette, (SELECT round(avg(r), 6) FROM w) AS davies_bouldin FROM md GROUP BY cluster")[5:],
    "cluster_significance": V("expr", f"{_G}, mm AS (SELECT cluster, list_avg(vals) AS m FROM gp), wh AS (SELECT avg(m) AS w FROM mm), gr AS (SELECT cluster, count(*) AS n, count(*) FILTER (m > w) + 0.5 * count(*) FILTER (m = w) AS u FROM mm, wh GROUP BY cluster HAVING count(*) >= 2), pp AS (SELECT cluster, n, least(1.0, 2.0 * (n + 1 - ceil(greatest(u, n - u))) / (n + 1))::DOUBLE AS p FROM gr), rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS c FROM pp) SELECT cluster, n, round(p, 6) AS p, round(least(1.0, min(p * c / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM rk"),
    "composite_distance": "WITH RECURSIVE " + V("expr net", f"{_G}, gg AS (SELECT 'G' || object_idx AS gene_id FROM gp), {_CLOSE} SELECT a.object_idx AS i, b.object_idx AS j, round(({_EUC} + 1 - coalesce(close, 0.0)) / 2, 6) AS distance FROM gp a JOIN gp b ON a.object_idx < b.object_idx LEFT JOIN cn ON s = 'G' || a.object_idx AND n = 'G' || b.object_idx")[5:],
    "cluster_dbscan": "WITH RECURSIVE " + V("expr", f"{_G}, {_NEAR} SELECT object_idx, CAST(coalesce(nb.cluster, 0) AS INT) AS cluster FROM gp LEFT JOIN pl ON n = object_idx LEFT JOIN nb USING (component)")[5:],
    "prototype_median": V("lser", f"{_MED} SELECT cluster, tp, round(v, 6) AS value FROM md"),
    "prototype_mean": V("lser", "SELECT cluster, tp, round(avg(value), 6) AS value FROM lser GROUP BY ALL"),
    "prototype_variance": V("lser", f"{_MED} SELECT cluster, round(var_pop(v), 9) AS variance FROM md GROUP BY ALL"),
    "cluster_sizes": V("ser", "SELECT cluster, count(*) AS size FROM ser GROUP BY ALL"),
    "cluster_similarity": V("lser", f"{_MED}, ml AS (SELECT cluster, list(v ORDER BY tp) AS vals FROM md GROUP BY ALL) SELECT a.cluster, round(avg({_EUC}), 6) AS similarity FROM ser a JOIN ml b ON a.cluster = b.cluster GROUP BY a.cluster"),
    "euclidean_pairs": V("expr", f"{_G} SELECT a.object_idx AS i, b.object_idx AS j, round({_EUC}, 6) AS distance FROM gp a JOIN gp b ON a.object_idx < b.object_idx"),
    "correlation_pairs": V("expr", f"{_G}, un AS (SELECT a.object_idx AS i, b.object_idx AS j, unnest(a.vals) AS x, unnest(b.vals) AS y FROM gp a JOIN gp b ON a.object_idx < b.object_idx) SELECT i, j, round(CASE WHEN var_pop(x) = 0 OR var_pop(y) = 0 THEN 0.0 ELSE 1 - corr(x, y) END, 6) AS distance FROM un GROUP BY ALL"),
    "prototype_corr": V("lser", f"{_MED} SELECT a.cluster AS c1, b.cluster AS c2, round(corr(a.v, b.v), 6) AS corr, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS distance FROM md a JOIN md b ON a.tp = b.tp AND a.cluster < b.cluster GROUP BY ALL"),
    "merge_candidates": V("expr", f"{_G}, un AS (SELECT cluster, unnest(range(0, 7)) AS tp, unnest(vals) AS value FROM gp), md AS (SELECT cluster, tp, median(value) AS v FROM un GROUP BY ALL) SELECT a.cluster AS c1, b.cluster AS c2, round(corr(a.v, b.v), 6) AS corr FROM md a JOIN md b ON a.tp = b.tp AND a.cluster < b.cluster GROUP BY ALL HAVING corr(a.v, b.v) >= 0.5"),
    "silhouette": V("ser", _SIL.format(dist=_EUC, t="ser") + " SELECT round(avg(s), 6) AS silhouette FROM ss"),
    "silhouette_objects": V("expr", _G + ", un AS (SELECT a.object_idx AS i, a.cluster AS ci, b.object_idx AS j, b.cluster AS cj, unnest(a.vals) AS x, unnest(b.vals) AS y FROM gp a JOIN gp b ON a.object_idx <> b.object_idx), dd AS (SELECT i, ci, j, cj, CASE WHEN var_pop(x) = 0 OR var_pop(y) = 0 THEN 0.0 ELSE 1 - corr(x, y) END AS x FROM un GROUP BY ALL), " + _SIL.split("), mm AS", 1)[1].join(("mm AS", "")) + " SELECT i AS object_idx, ci AS cluster, round(s, 6) AS silhouette FROM ss"),
    "davies_bouldin": V("lser", f"{_PM}, w AS (SELECT p.cluster, max((x.s + y.s) / {_EUC.replace('a.', 'p.').replace('b.', 'q.')}) AS r FROM pl p JOIN pl q ON p.cluster <> q.cluster JOIN sd x ON x.cluster = p.cluster JOIN sd y ON y.cluster = q.cluster GROUP BY p.cluster) SELECT round(avg(r), 6) AS davies_bouldin FROM w"),
    "dunn": V("lser", f"{_PM} SELECT round((SELECT min({_EUC}) FROM pl a JOIN pl b ON a.cluster < b.cluster) / (SELECT max(w) FROM sd), 6) AS dunn"),
    "rand_index": "WITH t AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT a, sum(n) AS n FROM t GROUP BY a), c AS (SELECT b, sum(n) AS n FROM t GROUP BY b), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t)::DOUBLE AS x, (SELECT sum(n * (n - 1) / 2.0) FROM r)::DOUBLE AS y, (SELECT sum(n * (n - 1) / 2.0) FROM c)::DOUBLE AS z, (SELECT sum(n) FROM t)::DOUBLE AS m) SELECT round((x - y * z / (m * (m - 1) / 2)) / ((y + z) / 2 - y * z / (m * (m - 1) / 2)), 9) AS adjusted_rand FROM s",
    "mutual_information": "WITH t AS (SELECT s_nationkey AS a, s_acctbal > 5000 AS b, count(*)::DOUBLE AS n FROM supplier GROUP BY ALL), r AS (SELECT a, sum(n) AS x FROM t GROUP BY a), c AS (SELECT b, sum(n) AS y FROM t GROUP BY b), m AS (SELECT sum(n) AS m FROM t), i AS (SELECT sum(n / m * ln(n * m / (x * y))) AS mi FROM t JOIN r USING (a) JOIN c USING (b), m), ea AS (SELECT -sum(x / m * ln(x / m)) AS ha FROM r, m), eb AS (SELECT -sum(y / m * ln(y / m)) AS hb FROM c, m), g AS (SELECT x, y, m, unnest(range(CAST(greatest(1, x + y - m) AS BIGINT), CAST(least(x, y) AS BIGINT) + 1)) AS n FROM r, c, m), e AS (SELECT sum(n / m * ln(n * m / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(m - x + 1) + lgamma(m - y + 1) - lgamma(m + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(m - x - y + n + 1))) AS emi FROM g) SELECT round(mi, 6) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(emi, 6) AS emi, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS adjusted_mi FROM i, ea, eb, e",
    "jaccard": V("ann", "l AS (SELECT gene_id, transcript_id, list(DISTINCT exon) AS x FROM ann GROUP BY ALL) SELECT a.gene_id, a.transcript_id AS tx1, b.transcript_id AS tx2, round(len(list_intersect(a.x, b.x))::DOUBLE / len(list_distinct(list_concat(a.x, b.x))), 6) AS jaccard FROM l a JOIN l b ON a.gene_id = b.gene_id AND a.transcript_id < b.transcript_id"),
    "combine_clusters": V("ser", "SELECT CASE WHEN cluster IN (1, 2, 3) THEN 1 ELSE cluster END AS cluster, count(*) AS size FROM ser GROUP BY ALL"),
}
