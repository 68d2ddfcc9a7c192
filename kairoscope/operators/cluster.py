"""Clusters of series: prototypes, distances, indices of quality, and algorithms.

Series are packed (object_idx, cluster, vals).  The pairwise distance matrix is a feature of the methods here; ``pair_distances`` makes
each pair once, from pairs of blocks.  All algorithms are distributed; a matrix on the driver holds CLARA's samples alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions.tests_udf import soft_dtw_column
from kairoscope.operators import blocks, density, graph, medoids, paths, prep, stats
from kairoscope.operators import linkage as L
from kairoscope.operators.prep import ratio
from kairoscope.session import cut

BOUND = 5000
#: The least and the most objects of a block of the distance sums, coordinates of the grid of near pairs, and the share of two squared lengths under which a squared distance is taken value by value.
BLOCK, GRID, NEAR = (256, 4096, 32768), 3, 1e-4
#: Values of all clusters' sums that go to every task.
CLUSTER_VALUES = 1 << 20
#: Rows of a strip of the distance sums.
STRIP = 128


def whole(values: str) -> Column:
    """Whether an array is there and misses no value."""
    return F.col(values).isNotNull() & ~F.exists(values, lambda v: v.isNull() | F.isnan(v))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def correlation_distance(a: Column, b: Column) -> Column:
    """1 - r; 0 where a series is constant."""
    return F.coalesce(1 - stats.pearson(a, b), F.lit(0.0))


def metric(name: str):
    """The distance of two arrays by name: euclidean, correlation or softdtw."""
    return {"euclidean": lambda a, b: euclidean(a, b), "correlation": lambda a, b: correlation_distance(a, b), "softdtw": lambda a, b: soft_dtw_column()(a, b)}[name]


def pair_distances(series: DataFrame, name: str = "euclidean") -> DataFrame:
    """i < j, distance, a pair of blocks at a time; a correlation that can't be told counts as equal."""
    return blocks.pair_rows(series, partial(block_distances, name=name), 0.0 if name == "correlation" else None)


def long_of(series: DataFrame) -> DataFrame:
    return series.select("object_idx", "cluster", F.posexplode("vals").alias("tp", "value"))


def prototypes(series: DataFrame, how: str = "median") -> DataFrame:
    """cluster, tp, value."""
    aggregate = {"median": F.median, "mean": F.avg}[how]
    return long_of(series).groupBy("cluster", "tp").agg(aggregate("value").alias("value"))


def packed_prototypes(series: DataFrame, how: str = "median") -> DataFrame:
    """cluster, prototype (array)."""
    p = prototypes(series, how).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("tp", "value"))).alias("p"))
    return p.select("cluster", F.col("p.value").alias("prototype"))


def prototype_variance(series: DataFrame, how: str = "median") -> DataFrame:
    return prototypes(series, how).groupBy("cluster").agg(F.var_pop("value").alias("variance"))


def similarity(series: DataFrame, name: str = "euclidean", how: str = "median") -> DataFrame:
    """cluster, similarity: the mean distance of its members to its prototype."""
    both = series.join(packed_prototypes(series, how), "cluster")
    return both.groupBy("cluster").agg(F.avg(metric(name)(F.col("vals"), F.col("prototype"))).alias("similarity"))


def sizes(series: DataFrame) -> DataFrame:
    return series.groupBy("cluster").agg(F.count("*").alias("size"))


def prototype_pairs(series: DataFrame, how: str = "median") -> DataFrame:
    """c1 < c2, corr and distance of the prototypes."""
    p = packed_prototypes(series, how)
    a, b = p.select(F.col("cluster").alias("c1"), F.col("prototype").alias("pa")), p.select(F.col("cluster").alias("c2"), F.col("prototype").alias("pb"))
    return a.join(b, F.col("c1") < F.col("c2")).select("c1", "c2", stats.pearson(F.col("pa"), F.col("pb")).alias("corr"), euclidean(F.col("pa"), F.col("pb")).alias("distance"))


def merge_candidates(series: DataFrame, threshold: float, how: str = "median") -> DataFrame:
    """Pairs of clusters whose prototypes correlate at the threshold or more."""
    return prototype_pairs(series, how).where(F.col("corr") >= threshold)


def soft_dtw_block(a: np.ndarray, b: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Soft dynamic time warping of the rows of two blocks, cell by cell for all pairs at once.

    The soft minimum of three ways differs from the least one only where another comes within 40 gamma of it (further ones add less than a double holds), so exponentials are taken there alone.
    """
    shape = len(a), len(b)
    row = [np.zeros(shape), *(np.full(shape, np.inf) for _ in range(b.shape[1]))]
    for v in a.T:
        now = [np.full(shape, np.inf)]
        for j, w in enumerate(b.T):
            ways = row[j], row[j + 1], now[j]
            less, more = np.minimum(ways[0], ways[1]), np.maximum(ways[0], ways[1])
            low, second = np.minimum(less, ways[2]), np.maximum(less, np.minimum(more, ways[2], out=more))
            near = np.flatnonzero(second - low < 40 * gamma)
            cell = v[:, None] - w
            cell *= cell
            cell += low
            if len(near):
                least = low.ravel()[near]
                cell.ravel()[near] -= gamma * np.log(sum(np.exp((least - x.ravel()[near]) / gamma) for x in ways))
            now.append(cell)
        row = now
    return row[-1]


def block_distances(a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """The distances of the rows of two blocks."""
    if name == "softdtw":
        return np.concatenate([soft_dtw_block(a[i : i + 32], b) for i in range(0, len(a), 32)])
    if name == "correlation":
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        size = np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b))
        return np.where(size > 0, 1 - a @ b.T / np.where(size > 0, size, 1.0), 0.0)
    out = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    for i in range(0, len(a), 32):  # value by value, in the order in which a row's sum is taken
        total = out[i : i + 32]
        for v, w in zip(a[i : i + 32].T, columns, strict=True):
            gap = v[:, None] - w
            gap *= gap
            total += gap
        np.sqrt(total, out=total)
    return out


def far_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two blocks by one product; those that cancel (``NEAR``) value by value, so that copies have 0."""
    centre = b.mean(0)
    a, b = a - centre, b - centre
    p, q = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    out = np.column_stack((-2.0 * a, p, np.ones(len(a)))) @ np.column_stack((b, np.ones(len(b)), q)).T
    i, j = np.divmod(np.flatnonzero(~(out > NEAR * (p.max(initial=0.0) + q.max(initial=0.0)))), max(len(b), 1))
    for at in range(0, len(i), 4096):
        part = slice(at, at + 4096)
        out[i[part], j[part]] = ((a[i[part]] - b[j[part]]) ** 2).sum(1)
    return np.sqrt(out, out=out)


def distance_sums(series: DataFrame, name: str = "euclidean") -> DataFrame:
    """object_idx, c, total, n: each object's summed distance to the other members of each cluster.

    Objects are packed in blocks (an eighth of them, between the first ``BLOCK`` limits; of very many a twenty-fourth, up to the last one, so that what moves grows little faster than they do);
    each block goes to every other one, which stays, and gives a row an object and cluster, so the pairs themselves are never rows.  What moves is a block for each pair of blocks.
    """
    n = series.count()
    count = -(-n // min(max(BLOCK[0], n // 8), max(BLOCK[1], min(n // 24, BLOCK[2])))) or 1
    between = far_distances if name == "euclidean" else partial(block_distances, name=name)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster")
        return pd.DataFrame({"blk": [rows["blk"].iloc[0]], "ids": [rows["object_idx"].to_numpy(np.int64).tobytes()], "labels": [rows["cluster"].to_numpy(np.int64).tobytes()], "vals": [np.stack(rows["vals"].to_numpy()).astype(float).tobytes()]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vals, ids_b, labels_b, vals_b in batch.itertuples(index=False):
                x, y, g = np.frombuffer(ids, np.int64), np.frombuffer(ids_b, np.int64), np.frombuffer(labels_b, np.int64)
                left, right = np.frombuffer(vals).reshape(len(x), -1), np.frombuffer(vals_b).reshape(len(y), -1)
                labels, first, size = np.unique(g, return_index=True, return_counts=True)
                for at in range(0, len(x), STRIP):  # a strip of the distances at a time
                    part = slice(at, at + STRIP)
                    d, counts = between(left[part], right), np.tile(size, (len(x[part]), 1))
                    if ids == ids_b:  # none is its own neighbour
                        k = np.arange(len(x))[part]
                        d[k - at, k] = 0.0
                        counts[k - at, np.searchsorted(labels, g[part])] -= 1
                    sums = np.add.reduceat(d, first, axis=1)
                    i, c = np.nonzero(counts)
                    yield pd.DataFrame({"object_idx": x[part][i], "c": labels[c], "total": sums[i, c], "n": counts[i, c]})

    packs = series.withColumn("blk", F.pmod(F.xxhash64("object_idx"), F.lit(count))).select("blk", "object_idx", "cluster", "vals").groupBy("blk").applyInPandas(pack, "blk long, ids binary, labels binary, vals binary")
    packs = cut(packs)
    sent = packs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("to"), "ids", "vals")
    stays = packs.select("blk", F.col("ids").alias("ids_b"), F.col("labels").alias("labels_b"), F.col("vals").alias("vals_b"))
    both = blocks.spread(sent.join(stays, F.col("to") == F.col("blk")).select("ids", "vals", "ids_b", "labels_b", "vals_b"), count * count)
    sums = both.mapInPandas(compare, "object_idx long, c int, total double, n long")
    return sums.groupBy("object_idx", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def correlation_sums(series: DataFrame) -> DataFrame:
    """object_idx, c, total, n, as ``distance_sums`` by correlation, without a pair of objects.

    1 - r is linear in the standardised series: an object's distances to the m members of a cluster that aren't constant add up to m - x . sum of theirs.  So
    clusters' sums are enough, which must have ``CLUSTER_VALUES`` values in all at most to go to every task.
    """
    mean = F.aggregate("vals", F.lit(0.0), lambda s, v: s + v) / F.size("vals")
    centred = series.withColumn("mean", mean).withColumn("z", F.transform("vals", lambda v: v - F.col("mean")))
    size = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v))
    level = centred.withColumn("size", size).select("object_idx", "cluster", F.when(F.col("size") > 0, F.transform("z", lambda v: v / F.col("size"))).alias("z"))
    level = cut(level)
    n = level.groupBy("cluster").agg(F.count("*").alias("n"), F.count("z").alias("m"))
    sums = level.select("cluster", F.posexplode("z").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("v").alias("v"))
    packed = sums.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s"))
    clusters = cut(n.join(packed, "cluster", "left").select(F.col("cluster").alias("c"), "n", "m", F.col("s.v").alias("sum")))
    values = clusters.agg(F.coalesce(F.sum(F.size("sum")), F.lit(0))).first()[0]
    if values > CLUSTER_VALUES:
        return distance_sums(series, "correlation")
    dot = F.aggregate(F.zip_with("z", "sum", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    own = (F.col("c") == F.col("cluster")).cast("long")
    met = level.crossJoin(F.broadcast(clusters))  # bounded above
    total = F.when(F.col("z").isNull() | F.col("sum").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("m") - own - (dot - own)))
    return met.select("object_idx", "c", total.alias("total"), (F.col("n") - own).alias("n")).where("n > 0")


def silhouettes(series: DataFrame, name: str = "euclidean") -> DataFrame:
    """object_idx, cluster, silhouette: (b - a) / max(a, b), 0 for a cluster of one."""
    if name == "correlation":
        mean = correlation_sums(series).select("object_idx", "c", (F.col("total") / F.col("n")).alias("m"))
    elif name == "euclidean":
        mean = distance_sums(series, name).select("object_idx", "c", (F.col("total") / F.col("n")).alias("m"))
    else:
        d = pair_distances(series, name)
        two = d.select(F.explode(F.array(F.struct(F.col("i").alias("object_idx"), F.col("j").alias("other"), "distance"), F.struct(F.col("j").alias("object_idx"), F.col("i").alias("other"), "distance"))).alias("x")).select("x.*")
        label = series.select(F.col("object_idx").alias("other"), F.col("cluster").alias("c"))
        mean = two.join(label, "other").groupBy("object_idx", "c").agg(F.avg("distance").alias("m"))
    own = mean.join(series.select("object_idx", "cluster"), "object_idx")
    ab = own.groupBy("object_idx", "cluster").agg(F.min(F.when(F.col("c") == F.col("cluster"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("cluster"), F.col("m"))).alias("b"))
    return ab.select("object_idx", "cluster", F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b"), 0.0)).alias("silhouette"))


def silhouette(series: DataFrame, name: str = "euclidean") -> DataFrame:
    return silhouettes(series, name).agg(F.avg("silhouette").alias("silhouette"))


def spread(series: DataFrame, how: str = "mean") -> DataFrame:
    """cluster, prototype, spread (mean distance of members) and diameter (twice the largest)."""
    both = series.join(packed_prototypes(series, how), "cluster").withColumn("d", euclidean(F.col("vals"), F.col("prototype")))
    return both.groupBy("cluster").agg(F.first("prototype").alias("prototype"), F.avg("d").alias("spread"), (2 * F.max("d")).alias("diameter"))


def davies_bouldin(series: DataFrame, how: str = "mean") -> DataFrame:
    """One row: the mean over clusters of the worst (spread + spread) / distance of prototypes."""
    s = spread(series, how)
    a = s.select(F.col("cluster").alias("c1"), F.col("prototype").alias("pa"), F.col("spread").alias("sa"))
    b = s.select(F.col("cluster").alias("c2"), F.col("prototype").alias("pb"), F.col("spread").alias("sb"))
    worst = a.join(b, F.col("c1") != F.col("c2")).groupBy("c1").agg(F.max(ratio(F.col("sa") + F.col("sb"), euclidean(F.col("pa"), F.col("pb")))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def dunn(series: DataFrame, how: str = "mean") -> DataFrame:
    """One row: the smallest distance of prototypes over the largest diameter."""
    near = prototype_pairs(series, how).agg(F.min("distance").alias("near"))
    wide = spread(series, how).agg(F.max("diameter").alias("wide"))
    return near.crossJoin(wide).select(ratio(F.col("near"), F.col("wide")).alias("dunn"))  # one row each


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings of the same rows."""
    two = lambda n: F.sum(n * (n - 1) / 2.0)
    t = contingency(labels, a, b)
    cells = t.agg(two(F.col("n")).alias("cells"), F.sum("n").alias("all"))
    rows = t.groupBy("a").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("rows"))
    columns = t.groupBy("b").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("columns"))
    every = cells.crossJoin(rows).crossJoin(columns)  # one row each
    hoped = F.try_divide(F.col("rows") * F.col("columns"), F.col("all") * (F.col("all") - 1) / 2.0)
    return every.select(ratio(F.col("cells") - hoped, (F.col("rows") + F.col("columns")) / 2 - hoped, 1.0).alias("adjusted_rand"))


def adjusted_mutual_information(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information, entropies and the adjusted index (mean of the entropies as the ceiling).

    The expected information runs over pairs of cluster sizes; its hypergeometric shares come from ``log_choose``.
    """
    t = contingency(labels, a, b)
    rows, columns = t.groupBy("a").agg(F.sum("n").alias("x")), t.groupBy("b").agg(F.sum("n").alias("y"))
    total = t.agg(F.sum("n").alias("all"))
    info = t.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(total))  # one row
    mi = info.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("x") * F.col("y")))).alias("mi"))
    entropy = lambda f, c, out: f.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("all") * F.log(F.col(c) / F.col("all")))).alias(out))
    shapes = rows.groupBy("x").agg(F.count("*").alias("nx")).crossJoin(columns.groupBy("y").agg(F.count("*").alias("ny"))).crossJoin(F.broadcast(total))  # distinct sizes
    low = F.greatest(F.lit(1), F.col("x") + F.col("y") - F.col("all"))
    cells = shapes.withColumn("n", F.explode(F.sequence(low.cast("long"), F.least("x", "y").cast("long"))))
    share = F.exp(stats.log_choose(F.col("x"), F.col("n")) + stats.log_choose(F.col("all") - F.col("x"), F.col("y") - F.col("n")) - stats.log_choose(F.col("all"), F.col("y")))
    emi = cells.agg(F.sum(F.col("nx") * F.col("ny") * F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("x") * F.col("y"))) * share).alias("emi"))
    every = mi.crossJoin(entropy(rows, "x", "ha")).crossJoin(entropy(columns, "y", "hb")).crossJoin(emi)  # one row each
    return every.select("mi", "ha", "hb", "emi", ratio(F.col("mi") - F.col("emi"), (F.col("ha") + F.col("hb")) / 2 - F.col("emi"), 1.0).alias("adjusted_mi"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where they share nothing."""
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)), 0.0)


def combine(series: DataFrame, clusters: list[int]) -> DataFrame:
    """The listed clusters as one, under the first label."""
    return series.withColumn("cluster", F.when(F.col("cluster").isin(clusters), F.lit(clusters[0])).otherwise(F.col("cluster")))


def split(series: DataFrame, cluster: int, parts: int, seed: int = 1234321) -> DataFrame:
    """One cluster in ``parts`` new ones, numbered behind the largest label."""
    top = series.agg(F.max("cluster")).first()[0]
    inner = kmeans(series.where(F.col("cluster") == cluster).drop("cluster"), parts, seed)
    return series.where(F.col("cluster") != cluster).select("object_idx", "cluster", "vals").unionByName(inner.select("object_idx", (F.col("cluster") + top).cast("int").alias("cluster"), "vals"))


def kmeans(series: DataFrame, k: int, seed: int = 1234321) -> DataFrame:
    """series with cluster 1..k."""
    points = series.withColumn("features", array_to_vector("vals"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="p").fit(points)
    return model.transform(points).select(*(c for c in series.columns if c != "cluster"), (F.col("p") + 1).cast("int").alias("cluster"))


def grid(series: DataFrame, eps: float) -> list[Column]:
    """The cells of width ``eps`` on the ``GRID`` coordinates of largest variance."""
    spread = series.select(F.posexplode("vals").alias("at", "v")).groupBy("at").agg(F.var_pop("v").alias("s")).orderBy(F.desc("s"), "at").limit(GRID).collect()
    return [F.floor(F.get("vals", F.lit(r["at"])) / eps).cast("long") for r in spread]


def near_pairs(series: DataFrame, eps: float) -> DataFrame:
    """i < j, distance of the pairs within a Euclidean distance of ``eps``.

    Objects lie in a grid of that width on the ``GRID`` coordinates of largest variance; a pair's cells are the same or neighbours, so each object meets
    those of its own cell and of the neighbouring ones (an equi-join), not all.
    """
    places = grid(series, eps)
    cells = F.array(*places)
    a = series.select(F.col("object_idx").alias("i"), F.col("vals").alias("va"), cells.alias("cell"))

    def spread_out(found: Column, place: Column) -> Column:
        return F.flatten(F.transform(found, lambda c: F.transform(F.sequence(place - 1, place + 1), lambda x: F.concat(c, F.array(x)))))

    around = F.array(F.array().cast("array<bigint>"))
    for place in places:  # the cells next to an object's own, in every dimension
        around = spread_out(around, place)
    b = series.select(F.col("object_idx").alias("j"), F.col("vals").alias("vb"), F.explode(around).alias("cell"))
    both = a.join(b, "cell").where("i < j").select("i", "j", euclidean(F.col("va"), F.col("vb")).alias("distance"))
    return both.where(F.col("distance") <= eps)


def dbscan(series: DataFrame, eps: float = 0.5, least: int = 5, name: str = "euclidean") -> DataFrame:
    """object_idx, cluster: 0 is noise; the others are numbered by their smallest core object."""
    if name == "euclidean" and eps > 0:
        series = cut(series)
        placed, held = density.clusters(density.near_blocks(series.where(whole("vals")), grid(series, eps)), eps, least)
        border = held.join(placed.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("component"))
        return numbered(series, placed.union(border))
    near = pair_distances(series, name).where(F.col("distance") <= eps)
    two = near.select(F.explode(F.array(F.struct(F.col("i").alias("x"), F.col("j").alias("y")), F.struct(F.col("j").alias("x"), F.col("i").alias("y")))).alias("e")).select("e.*")
    core = two.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select(F.col("x").alias("node"))
    links = near.join(core.withColumnRenamed("node", "i"), "i").join(core.withColumnRenamed("node", "j"), "j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    placed = graph.connected_components(links, core)
    border = two.join(placed.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("component")).join(core, "node", "left_anti")
    return numbered(series, placed.union(border.select("node", "component")))


def matrix(series: DataFrame, name: str = "euclidean", pairs: DataFrame | None = None) -> tuple[list[int], np.ndarray]:
    """The ids and the distance matrix (of ``pairs``, if given) on the driver, for at most BOUND objects."""
    n = series.count()
    if n > BOUND:
        raise ValueError(f"{n} objects; a distance matrix on the driver holds at most {BOUND}. Use kmeans, clara or dbscan")
    ids = sorted(r[0] for r in series.select("object_idx").collect())
    place = {x: k for k, x in enumerate(ids)}
    out = np.zeros((n, n))
    if pairs is None and name in ("euclidean", "correlation"):  # from the series, which are few
        held = {r[0]: r[1] for r in series.select("object_idx", "vals").collect()}
        return ids, block_distances(*(np.array([held[x] for x in ids], float),) * 2, name) if n else out
    found = (pair_distances(series, name) if pairs is None else pairs).toPandas()
    i, j = found["i"].map(place).to_numpy(int), found["j"].map(place).to_numpy(int)
    out[i, j] = out[j, i] = found["distance"].fillna(0.0).to_numpy()
    return ids, out


def hierarchical(series: DataFrame, k: int, linkage: str = "average", name: str = "euclidean", pairs: DataFrame | None = None) -> DataFrame:
    """By the distances of ``pairs`` (i < j, distance), or else of the series; Ward's linkage of Euclidean series makes no pairs."""
    if pairs is None and not (linkage == "ward" and name == "euclidean"):
        pairs = pair_distances(series, name)
    merges = L.dendrogram(series, linkage, pairs, name)
    return series.drop("cluster").join(L.cut_tree(series, merges, k), "object_idx")


def swap_medoids(distance: np.ndarray, k: int, seed: int = 1234321, most: int = 300) -> np.ndarray:
    """Indices of k medoids: a seeded start without repeats, then the best exchange while one helps."""
    rng = np.random.default_rng(seed)
    chosen = np.sort(rng.choice(len(distance), min(k, len(distance)), replace=False))
    for _ in range(most):
        to = distance[chosen]
        nearest = to.argmin(0)
        first = to.min(0)
        second = np.partition(to, 1, 0)[1] if len(chosen) > 1 else np.full(len(distance), np.inf)
        best, swap = first.sum() - 1e-12, None
        for m in range(len(chosen)):
            base = np.where(nearest == m, second, first)
            cost = np.minimum(distance, base[None, :]).sum(1)
            cost[chosen] = np.inf
            h = int(cost.argmin())
            if cost[h] < best:
                best, swap = cost[h], (m, h)
        if swap is None:
            break
        chosen[swap[0]] = swap[1]
    return np.sort(chosen)


def kmedoids(series: DataFrame, k: int, name: str = "euclidean", seed: int = 1234321) -> DataFrame:
    """series with cluster 1..k, by the best exchanges of ``medoids.find``."""
    series = cut(series)  # every round reads it
    distances = partial(block_distances, name=name)
    ids, values = medoids.find(series, k, distances, seed)
    return medoids.assign(series, values, distances) if ids else series.drop("cluster").withColumn("cluster", F.lit(1))


def clara(series: DataFrame, k: int, name: str = "euclidean", samples: int = 5, seed: int = 1234321) -> DataFrame:
    """Medoids of hashed samples of 40 + 2k objects (of all where there are at most 250); all objects go to the nearest, and the run of least inertia stays."""
    series = cut(series)
    n, distances, found = series.count(), partial(block_distances, name=name), []
    size = n if n <= 250 else 40 + 2 * k
    for s in range(samples):
        part = series.orderBy(F.xxhash64(F.lit(seed + s), "object_idx"), "object_idx").limit(size).select("object_idx", "vals").toPandas().sort_values("object_idx")
        x = np.stack(part["vals"].to_numpy()).astype(float)
        found.append(x[np.sort(swap_medoids(distances(x, x), k, seed + s))])

    def inertia(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vals"].to_numpy()).astype(float)
                yield pd.DataFrame({"s": range(samples), "total": [distances(x, centres).min(1).sum() for centres in found]})

    # All samples' medoids meet an object at once; totals that differ by rounding alone are equal, then the first sample stays.
    totals = series.select("vals").mapInPandas(inertia, "s int, total double").groupBy("s").agg(F.round(F.sum("total"), 6).alias("total"))
    best = totals.orderBy("total", "s").first()["s"]
    return medoids.assign(series, found[best], distances)


def numbered(series: DataFrame, named: DataFrame) -> DataFrame:
    """object_idx, cluster of ``named`` (node, component), by the component's name; 0 where an object has none."""
    order = named.select("component").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("component")))  # a row a cluster
    found = named.join(order, "component").select(F.col("node").alias("object_idx"), "cluster")
    return series.select("object_idx").join(found, "object_idx", "left").select("object_idx", F.coalesce("cluster", F.lit(0)).alias("cluster"))


def optics(series: DataFrame, eps: float, least: int = 5, name: str = "euclidean") -> DataFrame:
    """Clusters are the components of mutual reachability up to ``eps``, with the others that they reach; 0 is noise."""
    if name == "euclidean" and eps > 0:
        series = cut(series)
        packs = density.near_blocks(series.where(whole("vals")), grid(series, eps))
        placed, held = density.clusters(packs, eps, least)
        held = held.join(placed.withColumnRenamed("node", "y"), "y")
        core = density.core_of(packs, held.select(F.col("y").alias("object_idx")).distinct(), eps, least).withColumnRenamed("node", "y")
        border = held.join(core, "y").groupBy(F.col("x").alias("node")).agg(F.min_by("component", F.struct(F.greatest("d", "core"), "y")).alias("component"))
    else:
        _, placed, border = density.reachable(pair_distances(series, name).where(F.col("distance") <= eps), least)
    return series.drop("cluster").join(numbered(series, placed.union(border.select("node", "component"))), "object_idx")


def composite_distance(series: DataFrame, edges: DataFrame, name: str = "euclidean") -> DataFrame:
    """i, j, distance: the mean of the series' distance and 1 - closeness in the network (series also has gene_id)."""
    series = cut(series.select("object_idx", "gene_id", "vals"))
    found = paths.levels(graph.both_ways(edges), series.select(F.col("gene_id").alias("node")))
    return paths.mixed(series, found, partial(block_distances, name=name))


ALGORITHMS = {
    "hierarchical": lambda s, k, **o: hierarchical(s, k, **o),
    "kmeans": lambda s, k, name="euclidean", **o: kmeans(s, k, **o) if name == "euclidean" else kmedoids(s, k, name, **o),  # soft-DTW has no mean: medoids
    "kmedoids": lambda s, k, **o: kmedoids(s, k, **o),
    "clara": lambda s, k, **o: clara(s, k, **o),
    "dbscan": lambda s, k, **o: dbscan(s, **o),
    "optics": lambda s, k, **o: optics(s, **o),
}


@dataclass(frozen=True)
class Clustering:
    """What ``cluster_dataset`` finds: series (object_idx, gene columns, vals, cluster), prototypes (cluster, tp, value), and the two indices as one-row tables."""

    series: DataFrame
    prototypes: DataFrame
    silhouette: DataFrame
    davies_bouldin: DataFrame


def cluster_dataset(expr: DataFrame, algorithm: str, k: int = 10, keys: tuple[str, ...] = ("gene_id",), how: str = "median", transform: str | None = None, name: str = "euclidean", edges: DataFrame | None = None, **options) -> Clustering:
    """Clusters of an expression table (object_idx, keys, rep, tp, value) in one call.

    Replicates are combined (``how``: median or mean), values transformed (``transform``: log or None), objects clustered by one of ALGORITHMS (the hierarchical
    one on the composite distance, if ``edges`` are given), and prototypes, silhouette and Davies-Bouldin index taken on what was clustered.
    """
    combined = prep.replicate_combine(expr, how, ("object_idx", *keys))
    if transform is not None:
        combined = combined.withColumn("value", {"log": prep.log_transform}[transform](F.col("value")))
    packed = combined.groupBy("object_idx", *keys).agg(F.array_sort(F.collect_list(F.struct("tp", "value"))).alias("c"))
    series = cut(packed.select("object_idx", *keys, F.col("c.value").alias("vals")))
    if edges is not None:
        found = hierarchical(series, k, pairs=composite_distance(series, edges, name), **options).select("object_idx", "cluster")
    else:
        found = find_clusters(series, algorithm, k, **({"name": name} | options))
    labelled = cut(series.join(found, "object_idx"))
    return Clustering(labelled, prototypes(labelled, how), silhouette(labelled, name), davies_bouldin(labelled))


def significance(series: DataFrame, least: int = 2) -> DataFrame:
    """cluster, n, p, q: for clusters of ``least`` members, the two-sided rank test of the members' mean values against the mean of all values, with the standard correction."""
    means = series.select("cluster", (F.aggregate("vals", F.lit(0.0), lambda s, v: s + v) / F.size("vals")).alias("m"), F.size("vals").alias("w"))
    whole = means.agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("whole"))
    both = means.crossJoin(F.broadcast(whole))  # one row
    groups = both.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("m") > F.col("whole")).alias("above"), F.count_if(F.col("m") == F.col("whole")).alias("equal")).where(F.col("n") >= least)
    # Against a single value, its place among the n + 1 is uniform: the tail counts the places as far out or further.
    u = F.greatest(F.col("above") + F.col("equal") / 2, F.col("n") - F.col("above") - F.col("equal") / 2)
    p = F.least(F.lit(1.0), 2.0 * (F.col("n") + 1 - F.ceil(u)) / (F.col("n") + 1))
    return stats.adjust(groups.select("cluster", "n", p.alias("p")), "p", "q", "fdr_bh_standard")


def find_clusters(series: DataFrame, algorithm: str, k: int = 10, **options) -> DataFrame:
    """object_idx, cluster by one of ALGORITHMS."""
    return ALGORITHMS[algorithm](series, k, **options).select("object_idx", "cluster")
