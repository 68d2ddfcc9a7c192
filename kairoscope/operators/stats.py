"""Multiple-testing correction, combination of p-values and exact tails, as columns and windows.

Corrections need ranks over all p-values.  Equal values are counted first, the distinct ones are dealt into buckets by their logarithm
(a bucket spans a sixty-fourth of a power of two, whatever the data), and ranks and running extremes go over the buckets'
totals and then inside each bucket, so no task sorts all values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.operators.prep import ratio
from kairoscope.session import cut

METHODS = ("fdr_bh", "fdr_bh_standard", "holm", "bonferroni")
_NONE = -(1 << 30)


def adjust(frame: DataFrame, p: str = "p", out: str = "adj_p", method: str = "fdr_bh", tests: int | None = None) -> DataFrame:
    """``frame`` with corrected p-values; null ones stay null and don't count.

    fdr_bh multiplies the i-th smallest of n by (n - i + 1) / n and takes running maxima; fdr_bh_standard is the
    procedure of Benjamini and Hochberg; holm and bonferroni are the usual ones.  ``tests`` is their number where ``frame`` holds the smallest p-values only, as a value's
    correction asks for no larger ones (but by fdr_bh_standard).
    """
    if tests is not None and method == "fdr_bh_standard":
        raise ValueError("fdr_bh_standard asks for all p-values")
    if method not in METHODS:
        raise ValueError(f"{method} is none of {METHODS}")
    frame = cut(frame)  # the p-values are read several times and may have cost much
    values = frame.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__c"))
    values = values.withColumn("__b", F.when(F.col("__p") > 0, F.floor(F.log2("__p") * 64)).otherwise(_NONE).cast("int"))
    every = Window.partitionBy(F.lit(0))  # a row a bucket: 70,000 at most
    before = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = values.groupBy("__b").agg(F.sum("__c").alias("__t")).select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"), F.sum("__t").over(every).alias("__n") if tests is None else F.lit(tests).alias("__n"))
    inside = Window.partitionBy("__b").orderBy("__p")
    ranked = values.join(totals, "__b").withColumn("__last", F.col("__before") + F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    first, n = F.col("__last") - F.col("__c") + 1, F.col("__n")
    if method == "bonferroni":
        done = ranked.withColumn("__a", F.least(F.lit(1.0), F.col("__p") * n))
    else:
        back = method == "fdr_bh_standard"
        raw = F.col("__p") * n / F.col("__last") if back else F.col("__p") * (n - first + 1) / (n if method == "fdr_bh" else F.lit(1))
        best = F.min if back else F.max
        ranked = ranked.withColumn("__v", raw)
        outer = every.orderBy(F.desc("__b") if back else "__b").rowsBetween(Window.unboundedPreceding, -1)
        ends = ranked.groupBy("__b").agg(best("__v").alias("__e")).select("__b", best("__e").over(outer).alias("__outer"))
        running = best("__v").over(Window.partitionBy("__b").orderBy(F.desc("__p") if back else "__p").rowsBetween(Window.unboundedPreceding, 0))
        joined = ranked.withColumn("__v", running).join(ends, "__b")
        combine = F.least if back else F.greatest
        done = joined.withColumn("__a", F.least(F.lit(1.0), combine("__v", "__outer")))
    return frame.join(done.select("__p", F.col("__a").alias(out)), F.col(p) == F.col("__p"), "left").drop("__p")


def fisher_pair(p: Column, q: Column) -> Column:
    """Fisher's combination of two p-values."""
    x = p * q
    return F.when(x <= 0, F.lit(0.0)).otherwise(x * (1 - F.log(x)))


def fisher_tail(minus_log_sum: Column, k: Column) -> Column:
    """The chi-squared tail of 2k degrees of freedom at twice the sum of -ln p."""
    s = minus_log_sum
    start = F.struct(F.exp(-s).alias("term"), F.exp(-s).alias("sum"))
    step = lambda acc, j: F.struct((acc["term"] * s / j).alias("term"), (acc["sum"] + acc["term"] * s / j).alias("sum"))
    steps = F.when(k > 1, F.sequence(F.lit(1).cast("long"), (k - 1).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.least(F.lit(1.0), F.aggregate(steps, start, step)["sum"])


def fisher_combine(frame: DataFrame, keys: tuple[str, ...], p: str = "p") -> DataFrame:
    """keys, k and the combined p; 0 where one p is 0."""
    sums = frame.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("k"), F.sum(-F.log(F.when(F.col(p) > 0, F.col(p)))).alias("s"), F.min(p).alias("low"))
    return sums.select(*keys, "k", F.when(F.col("low") <= 0, F.lit(0.0)).otherwise(fisher_tail(F.col("s"), F.col("k"))).alias("combined_p"))


def log_factorial(n: Column) -> Column:
    """ln n!: exact sums under 16, else Stirling's series (off by less than 1e-13)."""
    exact = F.array(*(F.lit(math.lgamma(i + 1.0)) for i in range(16)))

    def value(x: Column) -> Column:
        inverse = 1 / F.greatest(x, F.lit(1.0))
        square = inverse * inverse
        series = (x + 0.5) * F.log(F.greatest(x, F.lit(1.0))) - x + 0.5 * math.log(2 * math.pi) + inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
        return F.when(x < 16, F.get(exact, x.cast("int"))).otherwise(series)

    # The array binds the argument once, so that large arguments are not written out again and again.
    return F.get(F.transform(F.array(n.cast("double")), value), F.lit(0))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k, 0 <= k <= n."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(total: Column, marked: Column, drawn: Column, hits: Column) -> Column:
    """P(X >= hits) for ``drawn`` of ``total`` of which ``marked`` count; null where the numbers don't fit.

    Terms are taken relative to the one at ``hits``, by their ratios, upwards and downwards: the tail is up / (up + down), without factorials and without
    differences.  The sums go to 40 standard deviations and 40 terms behind the mean at most; hits further out have 0 or 1.
    """
    low, high = F.greatest(F.lit(0), drawn + marked - total), F.least(marked, drawn)
    share = marked / total.cast("double")
    mean, reach = drawn * share, F.ceil(40 * F.sqrt(drawn * share * (1 - share))) + 40
    near = F.abs(hits - mean) <= reach
    more = lambda x: (marked - x) * (drawn - x) / ((x + 1.0) * (total - marked - drawn + x + 1))
    less = lambda x: x * (total - marked - drawn + x) / ((marked - x + 1.0) * (drawn - x + 1))

    def summed(begin: float, first: Column, last: Column, step: int, ratio_at) -> Column:
        """The sum of ``begin`` and of the products of the ratios from ``first`` to ``last``."""
        steps = F.when(near & ((last - first) * step >= 0), F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))

        def grow(acc: Column, x: Column) -> Column:
            term = acc["t"] * ratio_at(x)
            return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(begin).alias("s")), grow)["s"]

    up = summed(1.0, hits, F.least(high, F.greatest(hits, F.ceil(mean)) + reach) - 1, 1, more)
    down = summed(0.0, hits, F.greatest(low, F.least(hits, F.floor(mean)) - reach) + 1, -1, less)
    fits = (marked <= total) & (drawn <= total) & (low <= high)
    far = F.when(hits > mean, 0.0).otherwise(1.0)
    return F.when(fits & (hits <= low), F.lit(1.0)).when(fits & (hits > high), F.lit(0.0)).when(fits & ~near, far).when(fits, 1 / (1 + down / up))


def fisher_exact_greater(a: Column, b: Column, degree: Column, edges: Column) -> Column:
    """One-sided exact test of [[a, b], [degree - a, 2 edges - degree - b]]."""
    return hypergeometric_tail(2 * edges, degree, a + b, a)


def empirical_p(better: Column, total: Column) -> Column:
    return (1 + better) / (1 + total)


def pearson(x: Column, y: Column) -> Column:
    """The correlation of two arrays of one length; null where one is constant."""
    n = F.size(x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mx, my = total(x) / n, total(y) / n
    sxy = total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    sxx = total(F.transform(x, lambda a: (a - mx) * (a - mx)))
    syy = total(F.transform(y, lambda b: (b - my) * (b - my)))
    return ratio(sxy, F.sqrt(sxx * syy))


def permutation_p(observed: DataFrame, permuted: DataFrame, keys: tuple[str, ...], two_sided: bool = False) -> DataFrame:
    """keys, better, total, p: how often a permuted value (keys, value) is at least the observed one (keys, value)."""
    both = permuted.join(observed.select(*keys, F.col("value").alias("__seen")), list(keys))
    counts = both.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("value") > F.col("__seen")).alias("larger"), F.count_if(F.col("value") < F.col("__seen")).alias("smaller"), F.count_if(F.col("value") == F.col("__seen")).alias("equal"))
    better = 2 * F.least("larger", "smaller") + F.col("equal") if two_sided else F.col("larger") + F.col("equal")
    return counts.select(*keys, better.alias("better"), "total", F.least(F.lit(1.0), empirical_p(better, F.col("total"))).alias("p"))
