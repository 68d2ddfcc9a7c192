"""Filters, roll-ups and scalings of expression tables (gene_id, transcript_id, rep, tp, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBJECT = ("gene_id", "transcript_id")


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, null (or the default) where b is zero: a NaN never gets into a column."""
    value = F.try_divide(a, b)
    return value if default is None else F.coalesce(value, F.lit(default))


def low_mean(expr: DataFrame, cutoff: float = 0.0, keys: tuple[str, ...] = OBJECT) -> DataFrame:
    """Objects whose mean over all cells is under the cutoff; at cutoff 0 those whose mean is 0."""
    mean = expr.groupBy(*keys).agg(F.avg("value").alias("mean_value"))
    return mean.where(F.col("mean_value") == 0 if cutoff == 0 else F.col("mean_value") < cutoff)


def low_variance(expr: DataFrame, threshold: float = 1.0, keys: tuple[str, ...] = OBJECT) -> DataFrame:
    """Objects whose population variance over all cells is under the threshold."""
    return expr.groupBy(*keys).agg(F.var_pop("value").alias("variance")).where(F.col("variance") < threshold)


def without(expr: DataFrame, objects: DataFrame, keys: tuple[str, ...] = OBJECT) -> DataFrame:
    return expr.join(objects.select(*keys), list(keys), "left_anti")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("gene_id")).distinct()


def in_network(expr: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects whose gene is a node."""
    return expr.join(nodes_of(edges), "gene_id", "left_semi")


def in_dataset(edges: DataFrame, expr: DataFrame) -> DataFrame:
    """Edges both of whose nodes are genes of the data."""
    genes = expr.select("gene_id").distinct()
    return edges.join(genes, F.col("src") == F.col("gene_id"), "left_semi").join(genes, F.col("dst") == F.col("gene_id"), "left_semi")


def preprocess(expr: DataFrame, edges: DataFrame | None = None, remove_low_var: bool = False, cutoff: float = 0.0) -> tuple[DataFrame, DataFrame | None]:
    """Low means go, then low variances if asked for, then nodes that aren't in the data, then objects that aren't in the network."""
    out = without(expr, low_mean(expr, cutoff))
    if remove_low_var:
        out = without(out, low_variance(out))
    if edges is None:
        return out, None
    kept = in_dataset(edges, out)
    return in_network(out, kept), kept


def gene_level(expr: DataFrame) -> DataFrame:
    return expr.groupBy("gene_id", "rep", "tp").agg(F.sum("value").alias("value"))


def low_expressed_genes(expr: DataFrame, cutoff: float = 2.0) -> DataFrame:
    """Genes whose summed expression is under the cutoff on average over the columns."""
    return gene_level(expr).groupBy("gene_id").agg(F.avg("value").alias("mean_value")).where(F.col("mean_value") < cutoff)


def relative_abundance(expr: DataFrame, empty: float = 1.0) -> DataFrame:
    """expr with ``abundance``: the share of a transcript in its gene, ``empty`` where the gene has nothing."""
    total = F.sum("value").over(Window.partitionBy("gene_id", "rep", "tp"))
    return expr.withColumn("abundance", ratio(F.col("value"), total, empty))


def low_abundance(expr: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """Transcripts whose largest abundance in time, averaged over the replicates, is at most the cutoff."""
    peak = relative_abundance(expr).groupBy(*OBJECT, "rep").agg(F.max("abundance").alias("peak"))
    return peak.groupBy(*OBJECT).agg(F.avg("peak").alias("mean_peak")).where(F.col("mean_peak") <= cutoff)


def replicate_combine(expr: DataFrame, how: str = "median", keys: tuple[str, ...] = OBJECT) -> DataFrame:
    aggregate = {"median": F.median, "mean": F.avg}[how]
    return expr.groupBy(*keys, "tp").agg(aggregate("value").alias("value"))


def log_transform(value: Column) -> Column:
    """log10, 0 where it isn't finite."""
    return F.when(value > 0, F.log10(value)).otherwise(F.lit(0.0))


def z_scores(expr: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(value - mean) / population deviation within ``keys``; 0 where the deviation is 0."""
    w = Window.partitionBy(*keys)
    return expr.withColumn("scaled", ratio(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w), 0.0))


def min_max(expr: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys)
    low, high = F.min("value").over(w), F.max("value").over(w)
    return expr.withColumn("scaled", ratio(F.col("value") - low, high - low, 0.0))


def tanh_scale(expr: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """0.5 * (tanh(0.01 x - mean) / variance) + 1 within ``keys``; null where the variance is 0."""
    w = Window.partitionBy(*keys)
    return expr.withColumn("scaled", 0.5 * ratio(F.tanh(0.01 * F.col("value") - F.avg("value").over(w)), F.var_pop("value").over(w)) + 1)


def levels(low: Column, high: Column, negative: int, positive: int) -> Column:
    """Discretisation levels: from the minimum towards 0, then 0, then steps of the maximum with 1 added to each."""
    parts = []
    if negative > 0:
        parts.append(F.transform(F.sequence(F.lit(0), F.lit(negative - 1)), lambda i: low + F.abs(low) / negative * i))
    parts.append(F.array(F.lit(0.0)))
    if positive > 0:
        parts.append(F.transform(F.sequence(F.lit(0), F.lit(positive - 1)), lambda i: high / positive * i + 1))
    return F.concat(*parts)


def snap(value: Column, steps: Column) -> Column:
    """The nearest level, the first one of equally near ones."""
    near = F.array_min(F.transform(steps, lambda l, i: F.struct(F.abs(value - l).alias("gap"), i.alias("at"), l.alias("level"))))
    return near["level"]


def discretise(expr: DataFrame, keys: tuple[str, ...], negative: int = 0, positive: int = 4) -> DataFrame:
    w = Window.partitionBy(*keys)
    ends = expr.withColumn("__low", F.min("value").over(w)).withColumn("__high", F.max("value").over(w))
    return ends.withColumn("level", snap(F.col("value"), levels(F.col("__low"), F.col("__high"), negative, positive))).drop("__low", "__high")


def shuffled_in_time(expr: DataFrame, seed: int, keys: tuple[str, ...] = (*OBJECT, "rep")) -> DataFrame:
    """Each series with its values in another order of time, by the MD5 of seed, keys and time: the same on every run."""
    w = Window.partitionBy(*keys)
    digest = F.md5(F.concat_ws(" ", F.lit(str(seed)), *(F.col(c).cast("string") for c in (*keys, "tp"))))
    moved = expr.withColumn("__to", F.row_number().over(w.orderBy(digest)) - 1)
    return moved.select(*(c for c in expr.columns if c != "tp"), F.col("__to").alias("tp"))


def shuffled_globally(expr: DataFrame, objects: int, reps: int, timepoints: int, seed: int) -> DataFrame:
    """expr (object_idx from 0 to objects - 1, rep, tp, value) with each cell's value drawn from all cells with replacement, by the MD5 of seed and cell."""
    digest = F.md5(F.concat_ws(" ", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("object_idx", "rep", "tp"))))
    drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % (objects * reps * timepoints)
    wanted = expr.select("object_idx", "rep", "tp", drawn.alias("__at"))
    held = expr.select((F.col("object_idx") * (reps * timepoints) + F.col("rep") * timepoints + F.col("tp")).cast("long").alias("__at"), "value")
    return wanted.join(held, "__at").select("object_idx", "rep", "tp", "value")


def dataset_errors(expr: DataFrame, reps: int, timepoints: int) -> DataFrame:
    """object and reason: cells that are missing, repeated or not finite."""
    cells = expr.groupBy(*OBJECT).agg(F.count("*").alias("n"), F.count_distinct("rep", "tp").alias("d"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("bad"))
    reason = F.when(F.col("bad") > 0, "not a number").when(F.col("n") > F.col("d"), "repeated cell").when(F.col("d") < reps * timepoints, "missing cell")
    return cells.select(*OBJECT, reason.alias("reason")).where("reason IS NOT NULL")
