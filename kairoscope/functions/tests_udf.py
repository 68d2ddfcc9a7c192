"""Rank and correlation tests whose tails have no SQL form, as Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F


@lru_cache(512)
def u_counts(n1: int, n2: int) -> np.ndarray:
    """How many orders of n1 and n2 distinct values have each U, as shares."""
    # By the largest value: of the first sample, it is above all j of the second; of the second, above none.
    rows = {(0, 0): np.ones(1)}
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if i == j == 0:
                continue
            out = np.zeros(i * j + 1)
            if i:
                prior = rows[i - 1, j]
                out[j : j + len(prior)] += prior
            if j:
                prior = rows[i, j - 1]
                out[: len(prior)] += prior
            rows[i, j] = out
    counts = rows[n1, n2]
    return counts / counts.sum()


@lru_cache(100_000)
def u_pvalue(n1: int, n2: int, twice_u: int, ties: int, alternative: str) -> float:
    """The p-value of 2U of the first sample; ties: sum of t^3 - t over groups of equal values.

    Exact if one sample has at most 8 values and none are equal, else normal with corrections for ties and continuity.
    """
    u1 = twice_u / 2.0
    u = max(u1, n1 * n2 - u1) if alternative == "two-sided" else u1
    sides = 2.0 if alternative == "two-sided" else 1.0
    if min(n1, n2) <= 8 and not ties:
        share = u_counts(n1, n2)
        return min(1.0, sides * float(share[int(math.ceil(u)) :].sum()))
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
    if variance <= 0:
        return 1.0
    z = (u - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, sides * 0.5 * math.erfc(z / math.sqrt(2.0)))


def mann_whitney(a: np.ndarray, b: np.ndarray, alternative: str = "two-sided") -> float:
    """The p-value of two samples; 1 where one is empty."""
    if not len(a) or not len(b):
        return 1.0
    order = np.sort(b)
    twice = int(np.searchsorted(order, a, "left").sum() + np.searchsorted(order, a, "right").sum())
    count = np.unique(np.concatenate((a, b)), return_counts=True)[1].astype(np.int64)
    return u_pvalue(len(a), len(b), twice, int((count**3 - count).sum()), alternative)


def rank_pvalue_column(alternative: str = "two-sided"):
    """A column function of the two sizes, 2U of the first sample and the sum of t^3 - t over groups of equal values; 1 where a sample is empty."""

    @F.pandas_udf("double")
    def p(n1: pd.Series, n2: pd.Series, twice_u: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([u_pvalue(int(a), int(b), int(u), int(t), alternative) if a and b else 1.0 for a, b, u, t in zip(n1, n2, twice_u, ties, strict=True)], dtype="float64")

    return p


def shared_points(reps: int, timepoints: int, pairs: list[tuple[int, int]]):
    """A column function of two replicate-major arrays to the time points at which the sign of a - b differs from the one before in all replicates; where there are none, in both replicates of one of ``pairs``."""

    @F.arrow_udf("array<int>")
    def points(a: pa.Array, b: pa.Array) -> pa.Array:
        signs = np.sign(rows_of(a, reps * timepoints) - rows_of(b, reps * timepoints)).reshape(-1, reps, timepoints)
        turns = np.zeros(signs.shape, bool)
        turns[..., 1:] = (signs[..., 1:] != signs[..., :-1]) & ~np.isnan(signs[..., 1:]) & ~np.isnan(signs[..., :-1])
        found, some = turns.all(1), np.zeros((len(signs), timepoints), bool)
        for i, j in pairs:
            some |= turns[:, i] & turns[:, j]
        found |= some & ~found.any(1)[:, None]
        ends = np.concatenate(([0], np.cumsum(found.sum(1)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(found)[1].astype(np.int32)))

    return points.asNondeterministic()


def rows_of(arrays: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers as rows; missing ones are NaN."""
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(arrays), width)


def two_sided(z: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The tests of ``mann_whitney`` of many pairs of samples at once, rounded to 12 digits: values, and which of them are of the first and of the second sample (a column a pair of samples)."""
    inside, count = before | behind, z.shape[1]
    twice, equals = np.zeros(count, np.int64), np.ones(z.shape, np.int64)
    for i in range(len(z)):
        for j in range(i + 1, len(z)):
            same = (z[i] == z[j]) & inside[i] & inside[j]
            equals[i] += same
            equals[j] += same
            for one, other in ((i, j), (j, i)):
                apart = before[one] & behind[other]
                if apart.any():
                    twice += 2 * ((z[one] > z[other]) & apart)
                    twice += same & apart
    ties = ((equals * equals - 1) * inside).sum(0)
    keys, place = np.unique(np.stack((before.sum(0), behind.sum(0), twice, ties)), axis=1, return_inverse=True)
    p = np.array([round(u_pvalue(*k, "two-sided"), 12) if k[0] and k[1] else 1.0 for k in keys.T.tolist()])[place.ravel()] if count else np.zeros(0)
    for k in np.flatnonzero((np.isnan(z) & inside).any(0)):  # missing values rank as they sort
        p[k] = round(mann_whitney(z[before[:, k], k], z[behind[:, k], k]), 12)
    return p


def segment_features(reps: int, timepoints: int, tested: bool = True):
    """A column function of replicate-major arrays (a, b, top) and points to an array of structs, one a point, over the stretches up to the neighbouring points.

    sp; importance: the mean share of the gene's largest abundance that both have at the point and before it, null where the gene has nothing; diff; prob of a above b, and of b above a; and with
    ``tested`` the tests p1 and p2 of a and b before against behind the point.  All points of a batch are taken together, cell by cell.
    """
    names = ["sp", "importance", "diff", "prob_ab", "prob_ba", *(("p1", "p2") if tested else ())]
    time = np.arange(reps * timepoints)[:, None] % timepoints

    kinds = ", ".join(f"{n}:{'int' if n == 'sp' else 'double'}" for n in names)

    @F.arrow_udf(f"array<struct<{kinds}>>")
    def features(a: pa.Array, b: pa.Array, top: pa.Array, points: pa.Array) -> pa.Array:
        n = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sp, row = points.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)
        new = np.diff(row, prepend=-1, append=-1) != 0
        low, high = np.where(new[:-1], 0, np.roll(sp, 1)), np.where(new[1:], timepoints, np.roll(sp, -1))
        x, y, most = (np.ascontiguousarray(rows_of(v, len(time))[row].T) for v in (a, b, top))
        before, behind = (low <= time) & (time < sp), (sp <= time) & (time < high)
        sizes = reps * (sp - low), reps * (high - sp)

        def mean(v: np.ndarray, cells: np.ndarray, size: np.ndarray) -> np.ndarray:
            total = np.zeros(len(sp))
            for value, cell in zip(v, cells, strict=True):  # in the order of the cells
                total += np.where(cell, value, 0.0)
            return total / size

        share = lambda higher, cells, size: (higher & cells).sum(0) / size
        part, at = np.zeros(len(sp)), np.arange(len(sp))
        for r in range(reps):
            each = [np.divide(v[k, at], most[k, at], out=np.full(len(sp), np.nan), where=most[k, at] != 0) for v in (x, y) for k in (r * timepoints + sp - 1, r * timepoints + sp)]
            part += each[0] + each[1] + each[2] + each[3]
        out = [part / (4 * reps), (np.abs(mean(x, before, sizes[0]) - mean(x, behind, sizes[1])) + np.abs(mean(y, before, sizes[0]) - mean(y, behind, sizes[1]))) / 2]
        out += [share(x > y, before, sizes[0]) + share(x < y, behind, sizes[1]), share(y > x, before, sizes[0]) + share(y < x, behind, sizes[1])]
        out += [two_sided(v, before, behind) for v in (x, y)] if tested else []
        columns = [pa.array(sp.astype(np.int32)), *(pa.array(v, mask=np.isnan(v)) for v in out)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.StructArray.from_arrays(columns, names))

    return features.asNondeterministic()  # else filters behind it are pushed into joins before it, and take it again and again


def stretch_counts(orders: list[list[int]]):
    """A column function of two arrays of one replicate to a struct: ``seen``, the longest stretch of times without a change of the sign of a - b, and ``reached``, how many of ``orders`` (the old time at each new
    one) have one as long.  All pairs of a batch are taken together."""
    def longest(signs: np.ndarray) -> np.ndarray:
        last, most = np.zeros(signs.shape[:-1], np.int64), np.zeros(signs.shape[:-1], np.int64)
        for t in range(1, signs.shape[-1]):
            turn = (signs[..., t] != signs[..., t - 1]) & ~np.isnan(signs[..., t]) & ~np.isnan(signs[..., t - 1])
            most = np.where(turn, np.maximum(most, t - last), most)
            last = np.where(turn, t, last)
        return np.maximum(most, signs.shape[-1] - last)

    @F.arrow_udf("struct<seen:int,reached:int>")
    def counts(a: pa.Array, b: pa.Array) -> pa.Array:
        width = len(a[0]) if len(a) else 0
        signs = np.sign(rows_of(a, width) - rows_of(b, width))
        seen = longest(signs)
        reached = np.zeros(len(seen), np.int32)
        for order in orders:
            reached += longest(signs[:, order]) >= seen
        return pa.StructArray.from_arrays([pa.array(seen.astype(np.int32)), pa.array(reached)], ["seen", "reached"])

    return counts.asNondeterministic()


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + step * d) or tiny)
            c = (1.0 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1.0) / (a + b + 2.0) else 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def t_tail(t: float, dof: float) -> float:
    """P(|T| > t)."""
    return beta_share(dof / 2.0, 0.5, dof / (dof + t * t))


def beta_fractions(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """``beta_fraction`` of many arguments; each stops where it would alone, so equal ones stay equal."""
    tiny = 1e-300
    sound = lambda v: np.where(v == 0.0, tiny, v)
    out, at = np.empty_like(x), np.arange(len(x))
    c, d = np.ones_like(x), 1.0 / sound(1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / sound(1.0 + step * d)
            c = sound(1.0 + step / c)
            value = value * (c * d)
        open_ = ~(np.abs(c * d - 1.0) < 1e-15)
        if not open_.all():
            out[at[~open_]] = value[~open_]
            at, x, c, d, value = at[open_], x[open_], c[open_], d[open_], value[open_]
            if not len(at):
                break
    out[at] = value
    return out


def pearson_pvalues(r: np.ndarray, n: int) -> np.ndarray:
    """Two-sided p-values of correlations of n values, NaN for NaN or less than three values."""
    out = np.full(r.shape, np.nan)
    if n < 3:
        return out
    out[np.abs(r) >= 1.0] = 0.0
    inner = np.abs(r) < 1.0
    t, a = np.abs(r[inner]) * np.sqrt((n - 2) / (1.0 - r[inner] ** 2)), (n - 2) / 2.0
    x = (n - 2) / (n - 2 + t * t)
    share = np.ones_like(x)
    low, high = (x < (a + 1.0) / (a + 2.5)) & (x > 0.0), (x >= (a + 1.0) / (a + 2.5)) & (x < 1.0)
    front = lambda y: np.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5) + a * np.log(y) + 0.5 * np.log1p(-y))
    share[low] = front(x[low]) * beta_fractions(a, 0.5, x[low]) / a
    share[high] = 1.0 - front(x[high]) * beta_fractions(0.5, a, 1.0 - x[high]) / 0.5
    share[x <= 0.0] = 0.0
    out[inner] = share
    return out


def pearson_table(n: int, low: float, high: float = 0.9, cells: int = 1 << 16) -> Callable[[np.ndarray], np.ndarray]:
    """``pearson_pvalues`` of n > 3 values for many correlations of size ``low`` or more: between nodes by cubics with their exact slopes (off by less than 1e-13 of p), beyond ``high`` one by one."""
    if n < 4 or low >= high:
        return lambda r: pearson_pvalues(r, n)
    nodes, width = np.linspace(low, high, cells + 1), (high - low) / cells
    p = pearson_pvalues(nodes, n)
    slope = -2.0 * width * np.exp(math.lgamma((n - 1) / 2.0) - math.lgamma(0.5) - math.lgamma((n - 2) / 2.0) + (n - 4) / 2.0 * np.log1p(-nodes * nodes))
    step = np.diff(p)
    table = np.stack((p[:-1], slope[:-1], 3 * step - 2 * slope[:-1] - slope[1:], slope[:-1] + slope[1:] - 2 * step), 1)

    def pvalues(r: np.ndarray) -> np.ndarray:
        at = (np.abs(r) - low) / width
        far = ~((at >= 0) & (at < cells))
        k = np.where(far, 0, at).astype(np.int64)
        at -= k
        c = table[k]
        out = ((c[:, 3] * at + c[:, 2]) * at + c[:, 1]) * at + c[:, 0]
        if far.any():
            out[far] = pearson_pvalues(r[far], n)
        return out

    return pvalues


@lru_cache(4096)
def t_quantile(p: float, dof: float) -> float:
    """The t with P(|T| > t) = 2 (1 - p), by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_tail(mid, dof) > 2.0 * (1.0 - p) else (low, mid)
    return (low + high) / 2.0


def pearson_pvalue_column():
    """A column function (r, n) to the two-sided p-value."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        out, held = pd.Series(np.nan, index=r.index, dtype="float64"), r.to_numpy(float)
        for m in n.dropna().unique():
            same = (n == m).to_numpy()
            out[same] = pearson_pvalues(held[same], int(m))
        return out

    return p


def t_quantile_column(p: float):
    """A column function of the degrees of freedom."""

    @F.pandas_udf("double")
    def quantile(dof: pd.Series) -> pd.Series:
        return pd.Series([t_quantile(p, float(d)) if d > 0 else None for d in dof], dtype="float64")

    return quantile


def soft_dtw_column(gamma: float = 1.0):
    """A column function of two arrays: the soft dynamic time warping of squared differences."""

    def soft_min(*x: float) -> float:
        low = min(x)
        return low - gamma * math.log(sum(math.exp(-(v - low) / gamma) for v in x)) if low < math.inf else low

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            row = [0.0] + [math.inf] * len(y)
            for v in x:
                now = [math.inf]
                for j, w in enumerate(y):
                    now.append((v - w) ** 2 + soft_min(row[j], row[j + 1], now[j]))
                row = now
            out.append(row[-1])
        return pd.Series(out, dtype="float64")

    return distance
