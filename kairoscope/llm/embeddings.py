"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label and length are compared by cosine, in double precision, and link at ``COSINE`` or more.  On unit vectors that is a
distance of at most epsilon = sqrt(2 - 2 * COSINE), and projections on principal dimensions never make distances
larger.  So vectors are sorted by their cells in a grid of width epsilon on the ``DIMS`` leading principal dimensions
(from the covariance of all vectors), range-dealt in that order and cut into blocks of ``BLOCK`` rows with
their boxes.  Pairs of blocks are found from the top: first the boxes of whole ranges, then those of the blocks in
pairs of ranges that are within epsilon.  A pair of blocks is joined by halving both sequences again and
again, skipping halves whose boxes are more than epsilon apart, down to ``LEAF`` rows, which are compared.

Equal vectors of a label become one row with a count first, so a vector that very many rows hold is compared once; a pair of blocks
yields the number of links of each row and a spanning forest of them, never the pairs.

Results.  One row per input row.  A vector that is null, zero or holds a null or non-finite component, or whose label or
vec_id is null, links with nothing: n_links 0, itself its component.  Vectors of unequal length don't link.  n_links counts the rows that a row's own
vector links with, equal rows each; rows that repeat a vec_id with other vectors are one vertex, so they have one component.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm._forest import forest
from kairoscope.llm.components import components
from kairoscope.session import cut

COSINE = 0.93
DIMS, BLOCK, LEAF = 8, 1024, 128
#: Tasks that the pairs of ranges of one label are dealt to.
SALTS = 16
#: Distance on top of epsilon for what rounding may add, and how near the threshold a cosine is taken again from the raw vectors.
SLACK, CLOSE = 1e-6, 1e-9


def tamed(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square over- or underflows; cosines stay as they are."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def unit(raw: np.ndarray) -> np.ndarray:
    raw = tamed(raw)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the leading principal dimensions (length x DIMS at most), over all rows."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in batch.groupby(batch["v"].map(len)):
                x = unit(np.stack(rows["v"].to_numpy()).astype(np.float64))
                x = np.hstack((x, np.ones((len(x), 1))))
                sums[size] = sums.get(size, 0.0) + x.T @ x
        for size, total in sums.items():
            yield pd.DataFrame({"size": size, "at": np.arange(total.size), "x": total.ravel()})

    total = vectors.select("v").mapInPandas(moments, "size int, at long, x double").groupBy("size", "at").agg(F.sum("x").alias("x")).collect()  # squares of lengths
    found: dict[int, np.ndarray] = {}
    for size in {r["size"] for r in total}:
        m = np.zeros((size + 1) ** 2)
        for r in total:
            if r["size"] == size:
                m[r["at"]] = r["x"]
        m = m.reshape(size + 1, size + 1)
        mean = m[-1, :-1] / m[-1, -1]
        _, axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        found[size] = axes[:, ::-1][:, :DIMS]
    return found


def apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """The distance between two boxes."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float(np.sqrt(gap @ gap))


class Sequence:
    """Rows in grid order: raw, unit and projected vectors, with the boxes of the intervals that were asked for."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray):
        self.raw, self.unit = tamed(raw), unit(raw)
        self.projected = self.unit @ axes
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            part = self.projected[a:b]
            self.boxes[a, b] = part.min(0), part.max(0)
        return self.boxes[a, b]


def interval_join(a: Sequence, b: Sequence, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a and b that link; ``same``: a is b, each pair once."""
    epsilon = np.sqrt(2.0 - 2.0 * cosine) + SLACK
    stack = [((0, len(a.raw)), (0, len(b.raw)))]
    while stack:
        (i, j), (k, m) = stack.pop()
        if apart(*a.box(i, j), *b.box(k, m)) > epsilon:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            c = a.unit[i:j] @ b.unit[k:m].T
            hit = c >= cosine
            for x, y in zip(*np.nonzero(np.abs(c - cosine) < CLOSE), strict=True):
                p, q = a.raw[i + x], b.raw[k + y]
                hit[x, y] = float(p @ q) / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= cosine
            x, y = np.nonzero(hit)
            x, y = x + i, y + k
            if same:
                keep = x < y
                x, y = x[keep], y[keep]
            if len(x):
                yield x, y
            continue
        halves = lambda s, t: [(s, t)] if t - s <= LEAF else [(s, (s + t) // 2), ((s + t) // 2, t)]
        for left in halves(i, j):
            for right in halves(k, m):
                if not same or left[0] <= right[0]:
                    stack.append((left, right))


def block_links(a: Sequence, na: np.ndarray, ma: np.ndarray, b: Sequence | None, nb: np.ndarray | None, mb: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links, the number of vectors that each links with, and the smallest node that it reaches here."""
    same = b is None
    nodes, many = (na, ma) if same else (np.concatenate((na, nb)), np.concatenate((ma, mb)))
    root, n_links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for x, y in interval_join(a, a if same else b, same, cosine):
        y = y if same else y + len(na)
        np.add.at(n_links, x, many[y])
        np.add.at(n_links, y, many[x])
        root = forest(np.concatenate((root, x)), np.concatenate((np.arange(len(root)), y)), len(nodes))
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, root, nodes)
    held = n_links > 0
    return nodes[held], n_links[held], low[root][held]


def links(vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK) -> DataFrame:
    """(node, n_links, low) for pairs of blocks; ``vectors`` has lab, v (valid), node (distinct) and many."""
    spark = vectors.sparkSession
    epsilon = float(np.sqrt(2.0 - 2.0 * cosine)) + SLACK
    axes = spark.sparkContext.broadcast(principal(vectors))  # lengths x DIMS, whatever the corpus
    cells = [f"c{k}" for k in range(DIMS)]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby(batch["v"].map(len)):
                at = np.zeros((len(rows), DIMS), np.int32)
                p = unit(np.stack(rows["v"].to_numpy()).astype(np.float64)) @ axes.value[size]
                at[:, : p.shape[1]] = np.floor(p / epsilon)
                yield rows.assign(size=np.int32(size), **{c: at[:, k] for k, c in enumerate(cells)})

    grid = vectors.mapInPandas(placed, f"{vectors._jdf.schema().toDDL()}, size int, {', '.join(f'{c} int' for c in cells)}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["lab", "size", *cells, "node"]
    dealt = grid.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    boxes = [f"{side}{k}" for side in ("low", "high") for k in range(DIMS)]

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(rows["v"].to_numpy())
        size = raw.shape[1]
        p = np.zeros((len(raw), DIMS))
        q = unit(raw.astype(np.float64)) @ axes.value[size]
        p[:, : q.shape[1]] = q
        ends = dict(zip(boxes, [*p.min(0), *p.max(0)], strict=True))
        return pd.DataFrame({"lab": [rows["lab"].iloc[0]], "size": [size], "double": [raw.dtype == np.float64], "raw": [raw.tobytes()], "nodes": [rows["node"].to_numpy().tobytes()], "many": [rows["many"].to_numpy().tobytes()], **{k: [x] for k, x in ends.items()}})

    def cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat((held, batch), ignore_index=True)
            for _, rows in held.groupby(["lab", "size"], sort=True):  # whole blocks go, the rest of the last group waits
                last = rows.index[-1] == held.index[-1]
                full = len(rows) // block_rows * block_rows if last else len(rows)
                for at in range(0, full, block_rows):
                    yield block(rows.iloc[at : min(at + block_rows, full)])
            held = rows.iloc[full:].reset_index(drop=True) if full < len(rows) else None
        if held is not None:
            yield block(held)

    made = dealt.select("lab", "size", "v", "node", "many").mapInPandas(cut_blocks, f"lab {dict(vectors.dtypes)['lab']}, size int, double boolean, raw binary, nodes binary, many binary, {', '.join(f'{c} double' for c in boxes)}")
    blocks = cut(made.withColumn("block", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("block", 33)))
    uppers = blocks.groupBy("lab", "size", "part").agg(*(F.min(f"low{k}").alias(f"low{k}") for k in range(DIMS)), *(F.max(f"high{k}").alias(f"high{k}") for k in range(DIMS)))
    as_b = lambda t, *keys: t.select(*keys, *(F.col(c).alias(f"{c}_b") for c in t.columns if c not in keys))
    gaps = (F.greatest(F.lit(0.0), F.col(f"low{k}") - F.col(f"high{k}_b"), F.col(f"low{k}_b") - F.col(f"high{k}")) for k in range(DIMS))
    within = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon
    # A label that very many vectors have lies in all ranges: its pairs of ranges are dealt to several tasks.
    salted = as_b(uppers, "lab", "size").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    upper_pairs = uppers.withColumn("salt", (F.col("part") % SALTS).cast("int")).join(salted, ["lab", "size", "salt"]).where((F.col("part") <= F.col("part_b")) & within).select("lab", "size", "part", "part_b")
    ends = blocks.select("block", "part", "lab", "size", *boxes)
    pairs = upper_pairs.join(ends, ["lab", "size", "part"]).join(as_b(ends, "lab", "size", "part").withColumnRenamed("part", "part_b"), ["lab", "size", "part_b"])
    pairs = pairs.where((F.col("block") < F.col("block_b")) & within).select("block", "block_b")
    body = ["raw", "nodes", "many"]
    a = blocks.select("block", "size", "double", *body)
    b = blocks.select(F.col("block").alias("block_b"), *(F.col(c).alias(f"{c}_b") for c in body))
    crossed = pairs.join(a, "block").join(b, "block_b").select("size", "double", *body, *(f"{c}_b" for c in body))
    alone = a.select("size", "double", *body, *(F.lit(None).cast("binary").alias(f"{c}_b") for c in body))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, double, raw, nodes, many, raw_b, nodes_b, many_b in batch.itertuples(index=False):
                read = lambda x: Sequence(np.frombuffer(x, np.float64 if double else np.float32).reshape(-1, size).astype(np.float64), axes.value[size])  # noqa: B023, E731
                two = raw_b is not None
                node, n, low = block_links(read(raw), np.frombuffer(nodes, np.int64), np.frombuffer(many, np.int64), read(raw_b) if two else None, np.frombuffer(nodes_b, np.int64) if two else None, np.frombuffer(many_b, np.int64) if two else None, cosine)
                yield pd.DataFrame({"node": node, "n_links": n, "low": low})

    return alone.unionByName(crossed).repartition(parts).mapInPandas(joined, "node long, n_links long, low long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block_rows: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("lab"), F.col(vector_col).alias("v"))
    number = "cast(x AS double)"
    finite = f"forall(v, x -> x IS NOT NULL AND NOT isnan({number}) AND abs({number}) < double('Infinity'))"
    valid = F.expr(f"coalesce(id IS NOT NULL AND lab IS NOT NULL AND {finite} AND exists(v, x -> x <> 0), false)")
    whole = rows.where(valid)
    grouped = whole.groupBy("lab", "v").agg(F.min("id").cast("long").alias("least"), F.count("*").alias("many"))
    groups = cut(grouped.withColumn("node", F.monotonically_increasing_id()))  # an id may hold several vectors, so groups have numbers of their own
    found = cut(links(groups.drop("least"), cosine, block_rows))
    counted = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    of = groups.select(F.col("lab").alias("of_lab"), F.col("v").alias("of_v"), "node")
    owned = cut(whole.join(of, (F.col("lab") == F.col("of_lab")) & (F.col("v") == F.col("of_v"))).select("id", "node"))
    first = owned.groupBy("id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select(F.col("id").alias("of_id"), "first")
    same_id = owned.join(first, F.col("id") == F.col("of_id")).where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    reached = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).union(same_id))
    placed = groups.select("node", "least", "many").join(reached, "node", "left").join(counted, "node", "left")
    placed = cut(placed.select("node", "least", (F.coalesce("n_links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "of")
    named = placed.join(names, F.col("component") == F.col("of")).select(F.col("node").alias("of_node"), "n_links", "component_id")
    out = owned.join(named, F.col("node") == F.col("of_node")).select("id", "n_links", "component_id")
    rest = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
