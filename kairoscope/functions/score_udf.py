"""Exact score distributions of motifs, as an Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def score_distribution(odds: np.ndarray, gc: float, step: float) -> tuple[int, np.ndarray]:
    """(lowest, p): p[k] is the probability that a random word scores (lowest + k) * step.

    odds: the shares of a, c, g, t at each position.  Letters are drawn with a GC share of ``gc``; the log2 odds of each position are rounded to ``step``.
    Words with a letter that never occurs have no finite score, so p may sum to less than 1; it is empty where no word has one.
    """
    back = np.array([1 - gc, gc, gc, 1 - gc]) / 2
    lowest, p = 0, np.ones(1)
    for line in np.asarray(odds, float):
        use = np.flatnonzero((line > 0) & (back > 0))
        if not len(use):
            return 0, np.zeros(0)
        at = np.rint(np.log2(line[use] / back[use]) / step).astype(np.int64)
        out = np.zeros(len(p) + int(at.max() - at.min()))
        for shift, share in zip(at - at.min(), back[use], strict=True):
            out[shift : shift + len(p)] += share * p
        lowest, p = lowest + int(at.min()), out
    return lowest, p


def score_limit(odds: np.ndarray, gc: float, rate: float, step: float) -> tuple[float, float] | None:
    """(t, P(score > t)) for the lowest score t that random words exceed with a probability of ``rate`` at most; None where no word has a score."""
    lowest, p = score_distribution(odds, gc, step)
    if not len(p):
        return None
    seen = np.flatnonzero(p)
    above = np.round(np.append(np.cumsum(p[seen][::-1])[::-1], 0.0), 12)  # above[k]: as good as seen[k] or better
    k = int(np.argmax(above <= rate))
    t = lowest + int(seen[k - 1]) if k else lowest - 1
    return float(t * step), float(above[k])


def score_limit_column(rate: float, step: float):
    """A column function (odds, gc) to struct<threshold, share>; null where no word has a score or gc is null."""

    @F.pandas_udf("threshold double, share double")
    def limit(odds: pd.Series, gc: pd.Series) -> pd.DataFrame:
        found = [None if g is None or g != g else score_limit(np.array([list(x) for x in o], float), float(g), rate, step) for o, g in zip(odds, gc, strict=True)]
        return pd.DataFrame([x or (None, None) for x in found], columns=["threshold", "share"], dtype="float64")

    return limit
