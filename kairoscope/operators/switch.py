"""Switches between sibling series: points, magnitudes, the best point and the full detection.

Series are packed: one row a transcript with its abundances, raw values and the gene's largest abundances, replicate-major.  One join by
gene makes the pairs; everything about a pair is then computed in its row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions.tests_udf import segment_features, shared_points, stretch_counts
from kairoscope.operators import prep, stats


def packed(expr: DataFrame, timepoints: int, empty: float = 1.0) -> DataFrame:
    """gene_id, transcript_id, abundance, raw, top (arrays)."""
    share = prep.relative_abundance(expr, empty)
    top = share.withColumn("top", F.max("abundance").over(Window.partitionBy("gene_id", "rep", "tp")))
    cell = F.struct((F.col("rep") * timepoints + F.col("tp")).alias("at"), "abundance", F.col("value").alias("raw"), "top")
    rows = top.groupBy("gene_id", "transcript_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return rows.select("gene_id", "transcript_id", F.col("c.abundance").alias("abundance"), F.col("c.raw").alias("raw"), F.col("c.top").alias("top"))


def pairs(series: DataFrame) -> DataFrame:
    """Each two transcripts of a gene once: gene_id, tx1 < tx2, a, b (abundance), ra, rb (raw), top."""
    a = series.select("gene_id", F.col("transcript_id").alias("tx1"), F.col("abundance").alias("a"), F.col("raw").alias("ra"), "top")
    b = series.select("gene_id", F.col("transcript_id").alias("tx2"), F.col("abundance").alias("b"), F.col("raw").alias("rb"))
    return a.join(b, "gene_id").where("tx1 < tx2")


def agreement(reps: int) -> int:
    """Replicates that must agree where not all do: 60 %, rounded half to even."""
    return round(reps * 0.6)


def points_by_replicate(reps: int, timepoints: int) -> Column:
    """For each replicate the time points at which the sign of a - b differs from the one before."""
    return F.expr(f"transform(sequence(0, {reps - 1}), r -> filter(sequence(1, {timepoints - 1}), x -> signum(a[r * {timepoints} + x] - b[r * {timepoints} + x]) <> signum(a[r * {timepoints} + x - 1] - b[r * {timepoints} + x - 1])))")


def with_points(pair: DataFrame, reps: int, timepoints: int) -> DataFrame:
    """``pair`` with ``points``: those that all replicates share; else those of pairs (i, j), j <= reps - k + 1, k the agreement."""
    k = agreement(reps)
    two = [(i, j) for j in range(1, reps - k + 2) for i in range(j)] if reps > 1 and k > 1 else []
    return pair.withColumn("points", shared_points(reps, timepoints, two)("a", "b"))


def magnitudes(reps: int, timepoints: int) -> Column:
    """For each point the mean over replicates of the larger difference at it and before it (with one replicate: of both)."""
    gap = lambda x: f"abs(a[r * {timepoints} + {x}] - b[r * {timepoints} + {x}])"
    one = f"greatest({gap('x - 1')}, {gap('x')})" if reps > 1 else f"({gap('x - 1')} + {gap('x')}) / 2"
    return F.expr(f"transform(points, x -> round(aggregate(sequence(0, {reps - 1}), 0D, (s, r) -> s + {one}) / {reps}, 12))")


def switch_ratio(reps: int, timepoints: int) -> Column:
    return F.size("points") / F.lit(timepoints if reps > 1 else 1)


def dissimilarity(reps: int, timepoints: int) -> Column:
    """The mean over replicates of (1 - r) / 2 of the raw series; null where a replicate has none."""
    part = lambda c, r: F.slice(c, r * timepoints + 1, timepoints)
    each = [(1 - stats.pearson(part("ra", r), part("rb", r))) / 2 for r in range(reps)]
    return sum(each[1:], each[0]) / reps


def importance(reps: int, timepoints: int, at: str) -> Column:
    """The mean share of the gene's largest abundance that both have at a point and before it; null where the gene has nothing."""
    share = lambda s, x: f"try_divide({s}[r * {timepoints} + {x}], top[r * {timepoints} + {x}])"
    inner = " + ".join(share(s, x) for s in ("a", "b") for x in (f"{at} - 1", at))
    return F.expr(f"aggregate(sequence(0, {reps - 1}), 0D, (s, r) -> s + ({inner})) / {4 * reps}")


def with_segments(pair: DataFrame, reps: int, timepoints: int, tested: bool = False) -> DataFrame:
    """``pair`` (with points) with ``segs``: a struct of ``segment_features`` a point."""
    found = pair.withColumn("segs", segment_features(reps, timepoints, tested)("a", "b", "top", "points"))
    return found.withColumn("segs", F.transform("segs", lambda s: s.withField("importance", F.round(s["importance"], 12))))


#: The fold over points in order: a point wins if its first series' p-value, else its second's, is under the best so far and its importance above.
_FOLD = """aggregate({items}, named_struct('diff', 0D, 'p1', 0D, 'p2', 0D, 'sp', 0, 'importance', 0D, 'prob', 0D, 'best', 1D),
  (acc, s) -> CASE
    WHEN coalesce(s.p1 < acc.best AND s.importance > acc.importance, false) THEN named_struct('diff', s.diff, 'p1', s.p1, 'p2', s.p2, 'sp', s.sp, 'importance', s.importance, 'prob', s.prob / 2, 'best', s.p1)
    WHEN coalesce(s.p2 < acc.best AND s.importance > acc.importance, false) THEN named_struct('diff', s.diff, 'p1', s.p1, 'p2', s.p2, 'sp', s.sp, 'importance', s.importance, 'prob', s.prob / 2, 'best', s.p2)
    ELSE acc END)"""


def best_points(pair: DataFrame, reps: int, timepoints: int) -> DataFrame:
    """Both directions of each pair: gene_id, tx1, tx2 and ``best`` (diff, p1, p2, sp, importance, prob)."""
    tested = with_segments(with_points(pair, reps, timepoints), reps, timepoints, True)
    item = lambda p, q, prob: f"transform(segs, s -> named_struct('sp', s.sp, 'importance', s.importance, 'diff', s.diff, 'prob', s.{prob}, 'p1', s.{p}, 'p2', s.{q}))"
    one = F.expr(f"named_struct('tx1', tx1, 'tx2', tx2, 'best', {_FOLD.format(items=item('p1', 'p2', 'prob_ab'))})")
    two = F.expr(f"named_struct('tx1', tx2, 'tx2', tx1, 'best', {_FOLD.format(items=item('p2', 'p1', 'prob_ba'))})")
    both = tested.withColumn("corr", dissimilarity(reps, timepoints)).withColumn("ratio", switch_ratio(reps, timepoints)).withColumn("d", F.explode(F.array(one, two)))
    swap = F.col("d.tx1") != F.col("tx1")
    raw = lambda own, other: F.when(swap, F.col(other)).otherwise(F.col(own))
    out = both.select("gene_id", F.col("d.tx1").alias("tx1"), F.col("d.tx2").alias("tx2"), F.col("d.best").alias("best"), "points", "corr", "ratio", raw("ra", "rb").alias("ra"), raw("rb", "ra").alias("rb"))
    empty = F.size("points") == 0
    return out.select("*", F.when(empty, F.lit(1.0)).otherwise(F.col("best.p1")).alias("p1"), F.when(empty, F.lit(1.0)).otherwise(F.col("best.p2")).alias("p2"))


def major(reps: int, timepoints: int, sp: str) -> Column:
    """Whether the first transcript is the major one: a larger median over the replicates of its raw value before the point (at point 0: of the last time)."""
    at = f"pmod({sp} - 1, {timepoints})"
    middle = lambda c: F.expr(f"array_sort(transform(sequence(0, {reps - 1}), r -> {c}[r * {timepoints} + {at}]))")
    low, high = (reps - 1) // 2, reps // 2
    median = lambda c: (F.get(middle(c), F.lit(low)) + F.get(middle(c), F.lit(high))) / 2
    return median("ra") > median("rb")


def candidates(expr: DataFrame, reps: int, timepoints: int) -> DataFrame:
    """Ordered pairs with a switch point: major_transcript, minor_transcript, switch_prob, diff, p values, corr, event_importance, all_switch_points."""
    best = best_points(pairs(packed(expr, timepoints)), reps, timepoints).where("ratio > 0")
    first = major(reps, timepoints, "best.sp")
    return best.select(
        "gene_id",
        F.when(first, F.col("tx1")).otherwise(F.col("tx2")).alias("major_transcript"),
        F.when(first, F.col("tx2")).otherwise(F.col("tx1")).alias("minor_transcript"),
        F.col("best.prob").alias("switch_prob"),
        F.col("best.diff").alias("diff"),
        F.col("p1").alias("maj_pval"),
        F.col("p2").alias("min_pval"),
        stats.fisher_pair(F.col("p1"), F.col("p2")).alias("p_value"),
        "corr",
        F.col("best.sp").alias("best_switch_point"),
        F.col("best.importance").alias("event_importance"),
        F.col("points").alias("all_switch_points"),
    )


def detect_switches(expr: DataFrame, reps: int, timepoints: int, annotation: DataFrame | None = None, prob_cutoff: float = 0.5, corr_cutoff: float = 0.5, event_im_cutoff: float = 0.1, min_diff: float = 0.05, p_val_cutoff: float = 0.05, adjustp: str = "fdr_bh", low_expression: float | None = None) -> DataFrame:
    """Switch events.  Corrections run over all ordered pairs with a point; of a pair that is found both ways the one with the larger probability stays.

    annotation: transcript_id, exons, pfams (arrays), for gained, lost and constant exons and exclusive domains.
    low_expression: genes under this mean go first, where it is given.
    """
    if low_expression is not None:
        expr = expr.join(prep.low_expressed_genes(expr, low_expression).select("gene_id"), "gene_id", "left_anti")
    found = stats.adjust(candidates(expr, reps, timepoints), "p_value", "adj_pval", adjustp)
    kept = found.where((F.col("switch_prob") > prob_cutoff) & (F.col("diff") > min_diff) & (F.col("adj_pval") < p_val_cutoff) & (F.col("corr") > corr_cutoff) & (F.col("event_importance") > event_im_cutoff))
    order = Window.partitionBy("major_transcript", "minor_transcript").orderBy(F.desc("switch_prob"), "p_value", "maj_pval")
    kept = kept.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return kept if annotation is None else with_annotation(kept, annotation)


def with_annotation(events: DataFrame, annotation: DataFrame) -> DataFrame:
    """Events with gain_exons, loss_exons, constant_exons and exclusive_domains."""
    none = F.array().cast("array<string>")
    side = lambda name: annotation.select(F.col("transcript_id").alias(f"{name}_transcript"), F.array_compact("exons").alias(f"{name}_exons"), F.array_compact("pfams").alias(f"{name}_pfams"))
    both = events.join(side("major"), "major_transcript", "left").join(side("minor"), "minor_transcript", "left")
    col = lambda n: F.coalesce(F.col(n), none)
    a, b, p, q = col("major_exons"), col("minor_exons"), col("major_pfams"), col("minor_pfams")
    out = both.withColumns({"gain_exons": F.array_sort(F.array_except(b, a)), "loss_exons": F.array_sort(F.array_except(a, b)), "constant_exons": F.array_sort(F.array_intersect(a, b)), "exclusive_domains": F.array_sort(F.array_union(F.array_except(p, q), F.array_except(q, p)))})
    return out.drop("major_exons", "minor_exons", "major_pfams", "minor_pfams")


def total_isoform_usage(expr: DataFrame, switch_genes: DataFrame | None = None) -> DataFrame:
    """gene_id, tp, value: the sum over transcripts of the change of abundance to the next time, median over replicates; genes of more than one transcript."""
    if switch_genes is not None:
        expr = expr.join(switch_genes.select("gene_id").distinct(), "gene_id", "left_semi")
    steps = isoform_usage(expr, None)
    total = steps.groupBy("gene_id", "rep", "tp").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    return total.where("n > 1").groupBy("gene_id", "tp").agg(F.median("value").alias("value"))


def isoform_usage(expr: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """gene_id, transcript_id, rep, tp, value: each transcript's change of abundance to the next time."""
    if genes is not None:
        expr = expr.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    share = prep.relative_abundance(expr, 0.0)
    following = F.lead("abundance").over(Window.partitionBy("gene_id", "transcript_id", "rep").orderBy("tp"))
    return share.select("gene_id", "transcript_id", "rep", "tp", F.abs(F.col("abundance") - following).alias("value")).where("value IS NOT NULL")


def events_summary(events: DataFrame) -> DataFrame:
    """One row: distinct genes, events and the means of their figures."""
    means = (F.avg(c).alias(f"mean_{c}") for c in ("switch_prob", "diff", "event_importance", "corr"))
    return events.agg(F.count_distinct("gene_id").alias("genes"), F.count("*").alias("events"), *means)


def intervals(pair: DataFrame, timepoints: int) -> DataFrame:
    """gene_id, tx1, tx2, sp, nearest: for each point the shorter of the stretches to its neighbours (or the ends)."""
    ends = F.concat(F.array(F.lit(0)), F.col("points"), F.array(F.lit(timepoints)))
    each = pair.withColumn("ends", ends).select("gene_id", "tx1", "tx2", "ends", F.posexplode("points").alias("i", "sp"))
    return each.select("gene_id", "tx1", "tx2", "sp", F.least(F.col("sp") - F.get("ends", F.col("i")), F.get("ends", F.col("i") + 2) - F.col("sp")).alias("nearest"))


def permutation_orders(timepoints: int, permutations: int, seed: int = 1234321) -> list[list[int]]:
    """For each permutation the old time at each new one: times in order of the MD5 of seed, permutation and time."""
    digest = lambda p, t: hashlib.md5(f"{seed} {p} {t}".encode(), usedforsecurity=False).hexdigest()
    return [sorted(range(timepoints), key=lambda t: digest(p, t)) for p in range(permutations)]


def permutation_switch_p(expr: DataFrame, timepoints: int, permutations: int = 100, seed: int = 1234321) -> DataFrame:
    """gene_id, tx1, tx2, p for data of one replicate: features are the dissimilarity and the longest stretch between points.

    A permutation moves the times of all series alike, and is taken inside a pair's row: nothing is copied or moved.  Each feature's p is the
    share of permutations (and itself) that reach what was seen; dissimilarities count as equal up to nine digits.  A dissimilarity doesn't ask for the order of
    the times, so every permutation has the one that was seen, and only stretches are counted.
    """
    pair = pairs(packed(expr, timepoints))
    orders = permutation_orders(timepoints, permutations, seed)
    found = pair.select("gene_id", "tx1", "tx2", stretch_counts(orders)("a", "b").alias("s"), F.round((1 - stats.pearson(F.col("ra"), F.col("rb"))) / 2, 9).alias("apart"))
    share = lambda reached: stats.empirical_p(reached, F.lit(permutations))
    p = found.select("gene_id", "tx1", "tx2", F.explode(F.array(share(F.col("s.reached")), F.when(F.col("apart").isNotNull(), share(F.lit(permutations))))).alias("p"))
    return stats.fisher_combine(p, ("gene_id", "tx1", "tx2")).select("gene_id", "tx1", "tx2", F.col("combined_p").alias("p"))


def best_point_single(pair: DataFrame, timepoints: int, fixed: bool = False) -> DataFrame:
    """The best point of data of one replicate: the largest magnitude.

    Importance and stretches are taken at the *index* of the point in the list, as published, and at the point itself if ``fixed``;
    index 0 has no stretch before it and gives null.  The probability isn't halved.
    """
    pointed = with_points(pair, 1, timepoints).withColumn("magnitudes", magnitudes(1, timepoints)).where(F.size("points") > 0)
    best = pointed.withColumn("at", F.expr("array_position(magnitudes, array_max(magnitudes)) - 1").cast("int")).withColumn("ends", F.concat(F.array(F.lit(0)), F.col("points"), F.array(F.lit(timepoints))))
    best = best.withColumn("spot", F.expr("points[at]") if fixed else F.col("at")).withColumn("k", F.col("at") + 1 if fixed else F.col("at"))
    share = lambda cond, lo, hi: F.expr(f"CASE WHEN k >= 1 THEN aggregate(sequence({lo}, {hi} - 1), 0D, (n, x) -> n + if({cond}, 1, 0)) / ({hi} - {lo}) END")
    prob = share("a[x] > b[x]", "ends[greatest(k - 1, 0)]", "ends[k]") + share("a[x] < b[x]", "ends[k]", "ends[k + 1]")
    gain = F.expr("CASE WHEN spot >= 1 THEN (try_divide(a[greatest(spot - 1, 0)], top[greatest(spot - 1, 0)]) + try_divide(a[spot], top[spot]) + try_divide(b[greatest(spot - 1, 0)], top[greatest(spot - 1, 0)]) + try_divide(b[spot], top[spot])) / 4 END")
    return best.select("gene_id", "tx1", "tx2", F.expr("magnitudes[at]").alias("diff"), F.expr("points[at]").alias("sp"), gain.alias("importance"), prob.alias("prob"))
