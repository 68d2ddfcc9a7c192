"""Corrected p-values of pairs that are too many to be rows before they leave.

A corrected value grows with the p-value, so to so many digits it is a table of steps: for each rounded value the statistic at which it begins.  The table comes from passes that count statistics
in cells (each pass works them out again, and only counts move).  Of a cell's values ranks are known but for its count, so a step may begin in a part of a cell alone; those parts are the cells of the next pass.
Once they hold ``LIMIT`` values at most, these are listed with how often they come, and the steps are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.session import cut

#: Cells of a pass, values that are listed, passes at most, and cells of a row of counts.
CELLS, LIMIT, PASSES, CHUNK = 1 << 20, 1 << 21, 8, 1 << 16
#: Above every correlation.
TOP = 1.0 + 1e-9


@dataclass(frozen=True)
class Steps:
    """ends: statistics, ascending; rounded and passed: the corrected value, and whether it is under its cutoff, of each number of ends that a statistic doesn't exceed."""

    ends: np.ndarray
    rounded: np.ndarray
    passed: np.ndarray

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = len(self.ends) - np.searchsorted(self.ends, x)
        return self.rounded[level], self.passed[level]


def measured(values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], blocks: DataFrame, edges: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, pd.DataFrame | None]:
    """How many of the values (of ``blocks``, none below the first edge) lie between each edge and the next one; and those of the cells ``inside`` as x, n, or None where they are over twice ``LIMIT``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(len(edges), np.int64), [], 0

        def flush() -> Iterator[pd.DataFrame]:
            v = np.sort(np.concatenate(held))  # noqa: B023
            k = np.searchsorted(edges, v, "right") - 1
            starts = np.flatnonzero(np.diff(k, prepend=-1))
            total[k[starts]] += np.diff(starts, append=len(k))
            if inside is not None and (listed := v[inside[k]]).size:
                x, n = np.unique(listed, return_counts=True)
                yield pd.DataFrame({"chunk": -1, "counts": None, "x": x, "n": n})

        for v in values(batches):
            held.append(v)
            size += len(v)
            if size >= CELLS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
        for at in range(0, len(edges), CHUNK):
            if (part := total[at : at + CHUNK]).any():
                yield pd.DataFrame({"chunk": [at], "counts": [zlib.compress(part.tobytes(), 1)], "x": [0.0], "n": [0]})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        out = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in rows["counts"])
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "counts": [zlib.compress(out.tobytes(), 1)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in count(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("chunk", pa.int64()), ("counts", pa.binary()), ("x", pa.float64()), ("n", pa.int64())]), preserve_index=False)

    found = cut(blocks.mapInArrow(run, "chunk long, counts binary, x double, n long"))
    counts = np.zeros(len(edges), np.int64)
    for row in found.where("chunk >= 0").select("chunk", "counts").groupBy("chunk").applyInPandas(summed, "chunk long, counts binary").collect():  # CELLS counts or a few times as many
        part = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        counts[row["chunk"] : row["chunk"] + len(part)] = part
    if inside is None:
        return counts, None
    listed = cut(found.where("chunk < 0").groupBy("x").agg(F.sum("n").alias("n")))
    return counts, None if listed.count() > 2 * LIMIT else listed.toPandas()


def narrowed(edges: np.ndarray, counts: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, tail: Callable[[np.ndarray], np.ndarray], tests: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """For each step ``t`` (ascending) smaller bounds of where it begins: statistics from ``hi`` up are before it and those under ``lo`` behind it for certain.

    A value's rank lies between those of its cell's ends; p grows as the statistic falls, so cells are taken from the top.
    """
    kept = counts > 0
    c, low, high = (v[kept][::-1] for v in (counts, edges, np.append(edges[1:], TOP)))
    before = np.cumsum(c) - c
    small, large = tail(high), tail(low)
    most, least = large * (tests - before) / scale, small * (tests - before - c + 1) / scale
    # What is known from the passes before: a cell ahead of a step's bounds is below it, one behind them is not.
    most = np.minimum(most, np.nextafter(np.append(t, np.inf), 0)[len(t) - np.searchsorted(hi[::-1], low, "right")])
    least = np.maximum(least, np.append(0.0, t)[len(t) - np.searchsorted(lo[::-1], high, "left")])
    first = np.searchsorted(np.maximum.accumulate(most), t, "left")
    sure = np.maximum(np.searchsorted(np.maximum.accumulate(least), t, "left"), first)
    if not len(c):
        return np.full(len(t), edges[0]), np.full(len(t), edges[0])
    k = np.minimum(first, len(c) - 1)
    p_first, p_sure = np.clip(t * scale / (tests - before[k]), small[k], large[k]), np.clip(t * scale / (tests - before[k] - c[k] + 1), small[k], large[k])
    wide, width = large[k] - small[k], high[k] - low[k]
    share = lambda p: np.divide(p - small[k], wide, out=np.zeros(len(t)), where=wide > 0)
    x = np.minimum(high[k] - share(p_first) * width + 1e-3 * width, high[k])
    x = np.where((tail(x) <= p_first) & (wide > 0), x, high[k])
    y = np.maximum(high[k] - share(p_sure) * width - 1e-3 * width, low[k])
    y = np.where((tail(y) >= p_sure) & (wide > 0), y, low[k])
    y = np.where(sure == first, high[k], np.where(sure == first + 1, y, np.append(high, edges[0])[sure]))
    never = first == len(c)
    x, y = np.where(never, edges[0], np.where(sure == first, high[k], x)), np.where(never, edges[0], y)
    x, y = np.minimum(x, hi), np.maximum(y, lo)
    x = np.maximum.accumulate(x[::-1])[::-1]
    y = np.minimum.accumulate(np.minimum(y, x))
    return y, x


def joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of the stretches from lo to hi (both descending)."""
    kept = lo < hi
    a, b = lo[kept][::-1], hi[kept][::-1]
    begins = np.append(True, a[1:] > b[:-1])[: len(a)]
    return a[begins], np.append(b[:-1][begins[1:]], b[-1:])


def steps(measure: Callable, tail: Callable[[np.ndarray], np.ndarray], low: float, tests: int, method: str, digits: int, cutoff: float) -> Steps | None:
    """The steps of ``method`` (fdr_bh or holm, as in ``stats.adjust``) over statistics from ``low`` up; None where too many values lie too close.

    measure: ``measured`` but for edges and inside; tail: p-values of statistics, falling; tests: how many p-values there are, with those below ``low``.
    """
    scale = float(tests if method == "fdr_bh" else 1)
    every = np.unique(np.append((np.arange(1, 10**digits + 1) - 0.5) / 10**digits, cutoff))
    t = every[every <= min(1.0, tail(np.array([low]))[0] * tests / scale * (1 + 1e-9))]
    lo, hi, edges, about = np.full(len(t), low), np.full(len(t), TOP), np.linspace(low, TOP, max(2, min(CELLS, tests // 16)), endpoint=False), tests
    for _ in range(PASSES if len(t) else 0):
        if about <= LIMIT:
            break
        counts, _ = measure(edges)
        lo, hi = narrowed(edges, counts, t, lo, hi, tail, tests, scale)
        ends, behind = np.append(edges, TOP), np.append(0, np.cumsum(counts))
        a, b = joined(lo, hi)
        held, about = about, float((np.interp(b, ends, behind) - np.interp(a, ends, behind)).sum())
        spans = np.unique(np.stack((lo, hi), 1)[lo < hi], axis=0)
        parts = max(2, CELLS // max(len(spans), 1))
        edges = np.unique(np.concatenate(([low], spans[:, 1], (spans[:, :1] + (spans[:, 1:] - spans[:, :1]) * np.arange(parts) / parts).ravel())))
        if about > held / 2:  # what is left are equal values, which are listed once
            break
    a, b = joined(lo, hi)
    bounds = np.unique(np.concatenate(([low], a, b)))
    inside = np.isin(bounds, a)
    counts, listed = measure(bounds, inside)
    if listed is None:
        return None
    x, n = listed["x"].to_numpy(float), listed["n"].to_numpy(np.int64)
    order = np.argsort(x)[::-1]
    x, n = x[order], n[order]
    cell = np.searchsorted(bounds, x, "right") - 1
    outer = np.where(inside, 0, counts)
    above = outer.sum() - np.cumsum(outer)  # counted in the cells over one
    rank = above[cell] + np.cumsum(n) - n + 1
    value = np.maximum.accumulate(tail(x) * (tests - rank + 1) / scale)
    k = np.searchsorted(value, t, "left")
    held = np.append(x, -np.inf)[np.minimum(k, len(x))]
    ends = np.where(held >= lo, held, np.nextafter(lo, -np.inf))
    levels = np.append(0.0, t)
    return Steps(ends[::-1].copy(), np.floor(levels * 10**digits + 0.5 + 1e-6) / 10**digits, levels < cutoff)
