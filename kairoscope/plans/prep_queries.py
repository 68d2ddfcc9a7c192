"""Queries on ingestion, filters, abundances and scalings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kairoscope.operators import prep
from kairoscope.sources import readers
from kairoscope.sources import tables as T
from kairoscope.sources.tables import with_views as V

R6 = lambda c: F.round(c, 6)


def wide_to_long(spark, d):
    e = T.expression(spark, d)
    packed = readers.long_to_wide(e, ("gene_id", "transcript_id"), T.REPS, T.TIMEPOINTS)
    names = [f"v{i}" for i in range(T.REPS * T.TIMEPOINTS)]
    wide = packed.select("gene_id", "transcript_id", *(F.get("vals", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return readers.wide_to_long(wide, names, T.REPS, T.TIMEPOINTS, ("gene_id", "transcript_id")).select("gene_id", "transcript_id", "rep", "tp", R6("value").alias("value"))


def gene_level_sum(spark, d):
    return prep.gene_level(T.expression(spark, d)).select("gene_id", "rep", "tp", R6("value").alias("value"))


def filter_mean_cutoff(spark, d):
    return prep.low_mean(T.expression(spark, d), 90.0).select("gene_id", "transcript_id", R6("mean_value").alias("mean_value"))


def filter_low_variance(spark, d):
    return prep.low_variance(T.expression(spark, d), 2500.0).select("gene_id", "transcript_id", R6("variance").alias("variance"))


def semi_objects_in_network(spark, d):
    return prep.in_network(T.expression(spark, d), T.network(spark, d)).select("gene_id", "transcript_id").distinct()


def semi_nodes_in_dataset(spark, d):
    return prep.in_dataset(T.network(spark, d), T.expression(spark, d))


def preprocess(spark, d):
    out, _ = prep.preprocess(T.expression(spark, d), T.network(spark, d), True, 40.0)
    return out.groupBy("gene_id").agg(F.count_distinct("transcript_id").alias("transcripts"), R6(F.sum("value")).alias("value"))


def relative_abundance(spark, d):
    return prep.relative_abundance(T.expression(spark, d)).select("gene_id", "transcript_id", "rep", "tp", R6("abundance").alias("abundance"))


def low_abundance(spark, d):
    return prep.low_abundance(T.expression(spark, d), 0.5).select("gene_id", "transcript_id", R6("mean_peak").alias("mean_peak"))


def low_expressed_genes(spark, d):
    return prep.low_expressed_genes(T.expression(spark, d), 700.0).select("gene_id", R6("mean_value").alias("mean_value"))


def replicate_median(spark, d):
    return prep.replicate_combine(T.expression(spark, d)).select("gene_id", "transcript_id", "tp", R6("value").alias("value"))


def replicate_mean(spark, d):
    return prep.replicate_combine(T.expression(spark, d), "mean").select("gene_id", "transcript_id", "tp", R6("value").alias("value"))


def log_transform(spark, d):
    return T.expression(spark, d).select("gene_id", "transcript_id", "rep", "tp", R6(prep.log_transform(F.col("value"))).alias("value"))


def zscore_rows(spark, d):
    return prep.z_scores(T.expression(spark, d), prep.OBJECT).select("gene_id", "transcript_id", "rep", "tp", R6("scaled").alias("scaled"))


def minmax_rows(spark, d):
    return prep.min_max(T.expression(spark, d), prep.OBJECT).select("gene_id", "transcript_id", "rep", "tp", R6("scaled").alias("scaled"))


def tanh_scale(spark, d):
    return prep.tanh_scale(T.expression(spark, d), prep.OBJECT).select("gene_id", "transcript_id", "rep", "tp", R6("scaled").alias("scaled"))


def discretise(spark, d):
    return prep.discretise(T.expression(spark, d), prep.OBJECT, 0, 4).select("gene_id", "transcript_id", "rep", "tp", R6("level").alias("level"))


def shuffled_series(spark, d):
    return prep.shuffled_in_time(T.expression(spark, d), 7)


def shuffled_globally(spark, d):
    e = T.expression(spark, d)
    names = e.select("transcript_id").distinct().withColumn("object_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("transcript_id")) - 1)  # a row a transcript
    return prep.shuffled_globally(e.join(names, "transcript_id"), names.count(), T.REPS, T.TIMEPOINTS, 11).select("object_idx", "rep", "tp", R6("value").alias("value"))


def dataset_errors(spark, d):
    return prep.dataset_errors(T.observed(spark, d), T.REPS, T.TIMEPOINTS)


def version_strip(spark, d):
    e = T.observed(spark, d).select("transcript_id").distinct()
    return e.select("transcript_id", readers.strip_version(F.col("transcript_id")).alias("base_id"))


def name_lookup(spark, d):
    names = T.table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    genes = T.observed(spark, d).select("gene_id").distinct()
    return readers.translate(genes, names, "gene_id", "symb")


SHARE = "SELECT *, CASE WHEN sum(value) OVER w = 0 THEN 1.0 ELSE value / sum(value) OVER w END AS abundance FROM expr WINDOW w AS (PARTITION BY gene_id, rep, tp)"
QUERIES = {
    f.__name__: f
    for f in (wide_to_long, gene_level_sum, filter_mean_cutoff, filter_low_variance, semi_objects_in_network, semi_nodes_in_dataset, preprocess, relative_abundance, low_abundance, low_expressed_genes, replicate_median, replicate_mean, log_transform, zscore_rows, minmax_rows, tanh_scale, discretise, shuffled_series, shuffled_globally, dataset_errors, version_strip, name_lookup)
}
ORACLE_SQL = {
    "wide_to_long": V("expr", "SELECT gene_id, transcript_id, rep, tp, round(value, 6) AS value FROM expr"),
    "gene_level_sum": V("expr", "SELECT gene_id, rep, tp, round(sum(value), 6) AS value FROM expr GROUP BY ALL"),
    "filter_mean_cutoff": V("expr", "SELECT gene_id, transcript_id, round(avg(value), 6) AS mean_value FROM expr GROUP BY ALL HAVING avg(value) < 90"),
    "filter_low_variance": V("expr", "SELECT gene_id, transcript_id, round(var_pop(value), 6) AS variance FROM expr GROUP BY ALL HAVING var_pop(value) < 2500"),
    "semi_objects_in_network": V("expr net", "SELECT DISTINCT gene_id, transcript_id FROM expr WHERE gene_id IN (SELECT src FROM net UNION SELECT dst FROM net)"),
    "semi_nodes_in_dataset": V("expr net", "SELECT src, dst FROM net WHERE src IN (SELECT gene_id FROM expr) AND dst IN (SELECT gene_id FROM expr)"),
    "preprocess": V("expr net", "k AS (SELECT gene_id, transcript_id FROM expr GROUP BY ALL HAVING avg(value) >= 40 AND var_pop(value) >= 1), e AS (SELECT * FROM expr SEMI JOIN k USING (gene_id, transcript_id)), n AS (SELECT * FROM net WHERE src IN (SELECT gene_id FROM e) AND dst IN (SELECT gene_id FROM e)) SELECT gene_id, count(DISTINCT transcript_id) AS transcripts, round(sum(value), 6) AS value FROM e WHERE gene_id IN (SELECT src FROM n UNION SELECT dst FROM n) GROUP BY gene_id"),
    "relative_abundance": V("expr", f"s AS ({SHARE}) SELECT gene_id, transcript_id, rep, tp, round(abundance, 6) AS abundance FROM s"),
    "low_abundance": V("expr", f"s AS ({SHARE}), p AS (SELECT gene_id, transcript_id, rep, max(abundance) AS peak FROM s GROUP BY ALL) SELECT gene_id, transcript_id, round(avg(peak), 6) AS mean_peak FROM p GROUP BY ALL HAVING avg(peak) <= 0.5"),
    "low_expressed_genes": V("expr", "g AS (SELECT gene_id, rep, tp, sum(value) AS v FROM expr GROUP BY ALL) SELECT gene_id, round(avg(v), 6) AS mean_value FROM g GROUP BY ALL HAVING avg(v) < 700"),
    "replicate_median": V("expr", "SELECT gene_id, transcript_id, tp, round(median(value), 6) AS value FROM expr GROUP BY ALL"),
    "replicate_mean": V("expr", "SELECT gene_id, transcript_id, tp, round(avg(value), 6) AS value FROM expr GROUP BY ALL"),
    "log_transform": V("expr", "SELECT gene_id, transcript_id, rep, tp, CASE WHEN value > 0 THEN round(log10(value), 6) ELSE 0.0 END AS value FROM expr"),
    "zscore_rows": V("expr", "SELECT gene_id, transcript_id, rep, tp, CASE WHEN stddev_pop(value) OVER w = 0 THEN 0.0 ELSE round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) END AS scaled FROM expr WINDOW w AS (PARTITION BY gene_id, transcript_id)"),
    "minmax_rows": V("expr", "SELECT gene_id, transcript_id, rep, tp, CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.0 ELSE round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) END AS scaled FROM expr WINDOW w AS (PARTITION BY gene_id, transcript_id)"),
    "tanh_scale": V("expr", "SELECT gene_id, transcript_id, rep, tp, CASE WHEN var_pop(value) OVER w = 0 THEN NULL ELSE round(0.5 * (tanh(0.01 * value - avg(value) OVER w) / var_pop(value) OVER w) + 1, 6) END AS scaled FROM expr WINDOW w AS (PARTITION BY gene_id, transcript_id)"),
    "discretise": V("expr", "m AS (SELECT *, max(value) OVER (PARTITION BY gene_id, transcript_id) AS hi FROM expr), l AS (SELECT *, [0.0::DOUBLE, hi / 4 * 0 + 1, hi / 4 * 1 + 1, hi / 4 * 2 + 1, hi / 4 * 3 + 1] AS lv FROM m), u AS (SELECT *, unnest(range(1, 6)) AS i FROM l) SELECT gene_id, transcript_id, rep, tp, round(arg_min(lv[i], abs(value - lv[i]) * 1e6 + i * 1e-9), 6) AS level FROM u GROUP BY gene_id, transcript_id, rep, tp"),
    "shuffled_series": V("expr", "SELECT gene_id, transcript_id, rep, value, CAST(row_number() OVER (PARTITION BY gene_id, transcript_id, rep ORDER BY md5('7 ' || gene_id || ' ' || transcript_id || ' ' || rep || ' ' || tp)) - 1 AS INT) AS tp FROM expr"),
    "shuffled_globally": V("expr", "nm AS (SELECT transcript_id, row_number() OVER (ORDER BY transcript_id) - 1 AS object_idx FROM (SELECT DISTINCT transcript_id FROM expr)), c AS (SELECT object_idx, rep, tp, value, object_idx * 21 + rep * 7 + tp AS pos FROM expr JOIN nm USING (transcript_id)), w AS (SELECT object_idx, rep, tp, CAST('0x' || substr(md5('11 ' || object_idx || ' ' || rep || ' ' || tp), 1, 15) AS BIGINT) % (SELECT count(*) FROM c) AS pos FROM c) SELECT CAST(w.object_idx AS INT) AS object_idx, w.rep, w.tp, round(c.value, 6) AS value FROM w JOIN c USING (pos)"),
    "dataset_errors": V("obs", "SELECT gene_id, transcript_id, 'missing cell' AS reason FROM obs GROUP BY ALL HAVING count(*) < 21"),
    "version_strip": V("obs", "SELECT DISTINCT transcript_id, split_part(transcript_id, '.', 1) AS base_id FROM obs"),
    "name_lookup": V("obs", "SELECT DISTINCT gene_id, coalesce(s_name, 'n') AS symb FROM obs LEFT JOIN supplier ON gene_id = 'G' || s_suppkey AND s_acctbal > 0"),
}
