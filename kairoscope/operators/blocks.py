"""Series packed in blocks, so that pairs of objects are compared a pair of blocks at a time and only results become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.session import cut

#: The least and the most objects of a block, the blocks that are wanted, the most tasks that pairs of blocks are dealt to, the rows of a strip of distances, and the distances of one.
SIZE, PARTS, TASKS, STRIP, PAIRS = (64, 32768), 16, 2048, 32, 1 << 15


def packs(series: DataFrame, blocks: int) -> DataFrame:
    """blk (from 0), ids, vals: objects dealt by hash; missing values are NaN."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blk": [rows["blk"].iloc[0]], "ids": [rows["object_idx"].to_numpy(np.int64).tobytes()], "vals": [np.stack(rows["vals"].to_numpy()).astype(float).tobytes()]})

    whole = F.transform("vals", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    dealt = series.select(F.pmod(F.xxhash64("object_idx"), F.lit(blocks)).alias("blk"), F.col("object_idx").cast("long").alias("object_idx"), whole.alias("vals"))
    return dealt.groupBy("blk").applyInPandas(pack, "blk long, ids binary, vals binary")


def unpack(ids: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(ids, np.int64)
    return x, np.frombuffer(vals).reshape(len(x), -1)


def spread(frame: DataFrame, rows: int) -> DataFrame:
    """Rows that are few and dear, dealt evenly; their bytes are few, so they would be drawn together."""
    return frame.repartition(max(1, min(rows, TASKS)))


def pair_rows(series: DataFrame, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], empty: float | None = None) -> DataFrame:
    """i < j, distance of all pairs; ``empty`` where it isn't a number.

    Each two blocks meet once, and a pair of objects is a row only where it leaves.  Blocks are as few however many objects there are (``PARTS``, up to the most objects of one), and each
    moves once to each of its pairs, so what moves grows as the objects do.
    """
    kind = dict(series.dtypes)["object_idx"]
    series = cut(series.select("object_idx", "vals"))
    n = series.count()
    size = min(max(SIZE[0], -(-n // PARTS)), SIZE[1])
    blocks = -(-n // size) or 1
    packed = cut(packs(series, blocks))
    tasks = max(1, min(blocks * (blocks + 1) // 2, TASKS))
    place = lambda first, last: F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
    a = packed.select(F.col("blk").alias("a"), place(F.col("blk"), blocks - 1).alias("b"), "ids", "vals").repartition(tasks, "a", "b")
    b = packed.select(place(0, F.col("blk")).alias("a"), F.col("blk").alias("b"), F.col("ids").alias("ids_b"), F.col("vals").alias("vals_b")).repartition(tasks, "a", "b")
    both = a.join(b, ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (x, p), (y, q) = unpack(row["ids"], row["vals"]), unpack(row["ids_b"], row["vals_b"])
                strip = max(1, PAIRS // len(y))
                for at in range(0, len(x), strip):
                    part = slice(at, at + strip)
                    d = distances(p[part], q).ravel()
                    i, j = np.repeat(x[part], len(y)), np.tile(y, len(x[part]))
                    if row["a"] == row["b"]:
                        kept = i < j
                        i, j, d = i[kept], j[kept], d[kept]
                    d = pa.array(d, mask=np.isnan(d)) if empty is None else pa.array(np.where(np.isnan(d), empty, d))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), d], ["i", "j", "distance"])

    found = both.mapInArrow(compare, "i long, j long, distance double")
    return found.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "distance")
