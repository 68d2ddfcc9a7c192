"""Queries on switches, usage and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.operators import prep, stats, switch
from kairoscope.sources import tables as T
from kairoscope.sources.tables import with_views as V

R, N = T.REPS, T.TIMEPOINTS
R6 = lambda c: F.round(c, 6)


def _pairs(spark, d):
    return switch.with_points(switch.pairs(switch.packed(T.expression(spark, d), N)), R, N)


def switch_points(spark, d):
    pair = switch.pairs(switch.packed(T.expression(spark, d), N)).withColumn("found", switch.points_by_replicate(R, N))
    each = pair.select("gene_id", "tx1", "tx2", F.posexplode("found").alias("rep", "p"))
    return each.select("gene_id", "tx1", "tx2", "rep", F.explode("p").alias("tp"))


def switch_consensus(spark, d):
    return _pairs(spark, d).select("gene_id", "tx1", "tx2", F.concat_ws(",", F.transform("points", lambda x: x.cast("string"))).alias("points"), R6(switch.switch_ratio(R, N)).alias("ratio"))


def switch_magnitude(spark, d):
    m = _pairs(spark, d).withColumn("m", switch.magnitudes(R, N))
    return m.select("gene_id", "tx1", "tx2", F.explode(F.arrays_zip("points", "m")).alias("z")).select("gene_id", "tx1", "tx2", F.col("z.points").alias("sp"), R6(F.col("z.m")).alias("magnitude"))


def switch_dissimilarity(spark, d):
    pair = switch.pairs(switch.packed(T.expression(spark, d), N))
    return pair.select("gene_id", "tx1", "tx2", R6(switch.dissimilarity(R, N)).alias("corr"))


def switch_segments(spark, d):
    s = switch.with_segments(_pairs(spark, d), R, N).select("gene_id", "tx1", "tx2", F.explode("segs").alias("s"))
    return s.select("gene_id", "tx1", "tx2", "s.sp", R6("s.importance").alias("importance"), R6("s.diff").alias("diff"), R6("s.prob_ab").alias("prob_ab"), R6("s.prob_ba").alias("prob_ba"))


def major_minor(spark, d):
    p = _pairs(spark, d).select("gene_id", "tx1", "tx2", "ra", "rb", F.explode("points").alias("sp"))
    return p.select("gene_id", "tx1", "tx2", "sp", F.when(switch.major(R, N, "sp"), F.col("tx1")).otherwise(F.col("tx2")).alias("major_transcript"))


def switch_candidates(spark, d):
    found = switch.candidates(T.expression(spark, d), R, N).drop("all_switch_points")
    return found.select(*(R6(c).alias(c) if kind == "double" else c for c, kind in found.dtypes))


def detect_switches(spark, d):
    ann = T.annotations(spark, d).groupBy("transcript_id").agg(F.collect_set("exon").alias("exons"), F.collect_set("pfam").alias("pfams"))
    found = switch.detect_switches(T.expression(spark, d), R, N, ann)
    lists = ("gain_exons", "loss_exons", "constant_exons", "exclusive_domains", "all_switch_points")
    return found.select(*(F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) if c in lists else R6(c).alias(c) if kind == "double" else c for c, kind in found.dtypes))


def events_summary(spark, d):
    found = switch.events_summary(switch.detect_switches(T.expression(spark, d), R, N, min_diff=0.0, corr_cutoff=0.0, p_val_cutoff=0.5))
    return found.select("genes", "events", *(R6(c).alias(c) for c in found.columns[2:]))


def permutation_switches(spark, d):
    return switch.permutation_switch_p(T.expression(spark, d).where("rep = 0"), N, 100).select("gene_id", "tx1", "tx2", R6("p").alias("p"))


def best_point_single(spark, d):
    found = switch.best_point_single(switch.pairs(switch.packed(T.expression(spark, d).where("rep = 0"), N)), N)
    return found.select("gene_id", "tx1", "tx2", "sp", *(R6(c).alias(c) for c in ("diff", "importance", "prob")))


def switch_intervals(spark, d):
    return switch.intervals(_pairs(spark, d), N).select("gene_id", "tx1", "tx2", "sp", "nearest")


def switch_gene_usage(spark, d):
    genes = T.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene_id"))
    return switch.total_isoform_usage(T.expression(spark, d), genes).select("gene_id", "tp", R6("value").alias("value"))


def total_isoform_usage(spark, d):
    return switch.total_isoform_usage(T.expression(spark, d)).select("gene_id", "tp", R6("value").alias("value"))


def isoform_usage(spark, d):
    return switch.isoform_usage(T.expression(spark, d)).select("gene_id", "transcript_id", "rep", "tp", R6("value").alias("value"))


def isoform_abundance(spark, d):
    genes = prep.nodes_of(T.network(spark, d))
    e = T.expression(spark, d).join(genes, "gene_id", "left_semi")
    return prep.relative_abundance(e).select("gene_id", "transcript_id", "rep", "tp", R6("abundance").alias("abundance"))


def gain_loss_exons(spark, d):
    ann = T.annotations(spark, d).groupBy("gene_id", "transcript_id").agg(F.collect_set("exon").alias("exons"), F.collect_set("pfam").alias("pfams"))
    a = ann.select("gene_id", F.col("transcript_id").alias("major_transcript"))
    pairs = a.join(ann.select("gene_id", F.col("transcript_id").alias("minor_transcript")), "gene_id").where("major_transcript < minor_transcript")
    out = switch.with_annotation(pairs, ann.drop("gene_id"))
    return out.select("gene_id", "major_transcript", "minor_transcript", *(F.concat_ws(",", c).alias(c) for c in ("gain_exons", "loss_exons", "constant_exons", "exclusive_domains")))


def _adjusted(method):
    def query(spark, d):
        return stats.adjust(T.pvalues(spark, d), "p", "adj_p", method).select("id", "p", F.round("adj_p", 9).alias("adj_p"))

    return query


def fisher_combine(spark, d):
    return stats.fisher_combine(T.pvalues(spark, d), ("grp",)).select("grp", "k", F.round("combined_p", 9).alias("combined_p"))


def empirical_pvalue(spark, d):
    g = T.pvalues(spark, d).groupBy("grp").agg(F.count("*").alias("total"), F.count_if(F.col("p") >= 0.5).alias("better"))
    return g.select("grp", "better", "total", F.round(stats.empirical_p(F.col("better"), F.col("total")), 9).alias("p"))


def _grid(spark, d):
    return T.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("hits"))


def hypergeom_tail(spark, d):
    g = _grid(spark, d)
    brand, size = g.groupBy("p_brand").agg(F.sum("hits").alias("marked")), g.groupBy("p_size").agg(F.sum("hits").alias("drawn"))
    rows = g.join(brand, "p_brand").join(size, "p_size").crossJoin(g.agg(F.sum("hits").alias("total")))
    return rows.select("p_brand", "p_size", F.round(stats.hypergeometric_tail(F.col("total"), F.col("marked"), F.col("drawn"), F.col("hits")), 8).alias("p"))


def fisher_exact_greater(spark, d):
    g = _grid(spark, d)
    brand, size = g.groupBy("p_brand").agg(F.sum("hits").alias("a_all")), g.groupBy("p_size").agg(F.sum("hits").alias("b_all"))
    rows = g.join(brand, "p_brand").join(size, "p_size").crossJoin(g.agg(F.sum("hits").alias("edges")))
    p = stats.fisher_exact_greater(F.col("hits"), F.col("b_all") - F.col("hits"), F.col("a_all"), F.col("edges"))
    return rows.select("p_brand", "p_size", F.round(p, 9).alias("p"))


QUERIES = {f.__name__: f for f in (switch_consensus, switch_points, switch_magnitude, switch_dissimilarity, switch_segments, major_minor, switch_candidates, detect_switches, events_summary, permutation_switches, switch_intervals, switch_gene_usage, best_point_single, total_isoform_usage, isoform_usage, isoform_abundance, gain_loss_exons, fisher_combine, empirical_pvalue, hypergeom_tail, fisher_exact_greater)} | {"fdr_faithful": _adjusted("fdr_bh"), "fdr_standard": _adjusted("fdr_bh_standard"), "holm": _adjusted("holm"), "bonferroni": _adjusted("bonferroni")}

_SHARE = "sh AS (SELECT *, CASE WHEN sum(value) OVER w = 0 THEN 1.0 ELSE value / sum(value) OVER w END AS ab FROM expr WINDOW w AS (PARTITION BY gene_id, rep, tp)), shm AS (SELECT *, max(ab) OVER (PARTITION BY gene_id, rep, tp) AS top FROM sh)"
_PAIR = f"{_SHARE}, pr AS (SELECT a.gene_id, a.transcript_id AS tx1, b.transcript_id AS tx2, a.rep, a.tp, a.ab AS a, b.ab AS b, a.value AS ra, b.value AS rb, a.top FROM shm a JOIN shm b ON a.gene_id = b.gene_id AND a.rep = b.rep AND a.tp = b.tp AND a.transcript_id < b.transcript_id), sg AS (SELECT *, sign(a - b) AS s, lag(sign(a - b)) OVER (PARTITION BY gene_id, tx1, tx2, rep ORDER BY tp) AS ls, lag(abs(a - b)) OVER (PARTITION BY gene_id, tx1, tx2, rep ORDER BY tp) AS lg FROM pr), pt AS (SELECT gene_id, tx1, tx2, rep, tp FROM sg WHERE tp > 0 AND s <> ls)"
_CONS = f"{_PAIR}, ct AS (SELECT gene_id, tx1, tx2, tp, count(*) AS n FROM pt GROUP BY ALL), al AS (SELECT gene_id, tx1, tx2, max(n) AS most FROM ct GROUP BY ALL), cp AS (SELECT ct.gene_id, ct.tx1, ct.tx2, ct.tp AS sp FROM ct JOIN al USING (gene_id, tx1, tx2) WHERE (most = 3 AND n = 3) OR (most = 2 AND n = 2))"
_SEG = f"{_CONS}, st AS (SELECT *, coalesce(lag(sp) OVER w, 0) AS p0, coalesce(lead(sp) OVER w, 7) AS p1 FROM cp WINDOW w AS (PARTITION BY gene_id, tx1, tx2 ORDER BY sp))"
#: How often two samples of i and j distinct values have each U.
_UC = f"uc AS (SELECT 0 AS i, 0 AS j, 0 AS u, 1.0::DOUBLE AS c UNION ALL SELECT i + 1 - d, j + d, u + j * (1 - d), sum(c) FROM uc, (VALUES (0), (1)) t(d) WHERE i + j < {R * N} GROUP BY ALL), ut AS (SELECT i, j, u, sum(c) OVER (PARTITION BY i, j ORDER BY u DESC) / sum(c) OVER (PARTITION BY i, j) AS share FROM uc)"


def erfc_sql(x: str) -> str:
    """The complementary error function by a series of positive terms."""
    a = f"abs({x})"
    series = f"CASE WHEN {x} = 0 THEN 0.0 ELSE 2 / sqrt(pi()) * exp(-{a} * {a}) * list_sum(list_transform(range(0, 200), lambda k: exp(2 * k * ln(2) + lgamma(k + 1) + (2 * k + 1) * ln({a}) - lgamma(2 * k + 2)))) END"
    return f"(1 - sign({x}) * {series})"


def rank_test_sql(rows: str, keys: str, out: str) -> str:
    """CTEs that end in ``out`` (keys, p): the two-sided rank test of the v of side 0 against side 1 of each key of ``rows``; needs ut."""
    z = f"((m.u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))))"
    return (
        f"{out}_n AS (SELECT {keys}, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM {rows} GROUP BY ALL), "
        f"{out}_t AS (SELECT {keys}, sum(c * c * c - c) AS ties FROM (SELECT {keys}, v, count(*) AS c FROM {rows} GROUP BY ALL) GROUP BY ALL), "
        f"{out}_u AS (SELECT {keys}, sum(CASE WHEN y.v < x.v THEN 2 WHEN y.v = x.v THEN 1 ELSE 0 END) AS t2 FROM {rows} x JOIN {rows} y USING ({keys}) WHERE x.side = 0 AND y.side = 1 GROUP BY ALL), "
        f"{out}_m AS (SELECT {keys}, n1, n2, ties, greatest(t2 / 2, n1 * n2 - t2 / 2) AS u FROM {out}_n JOIN {out}_t USING ({keys}) JOIN {out}_u USING ({keys})), "
        f"{out} AS (SELECT {keys}, round(CASE WHEN least(n1, n2) <= 8 AND ties = 0 THEN least(1.0, 2 * share) WHEN ties = (n1 + n2) * (n1 + n2) * (n1 + n2) - (n1 + n2) THEN 1.0 ELSE least(1.0, {erfc_sql(z + ' / sqrt(2)')}) END, 12) AS p FROM {out}_m m LEFT JOIN ut ON ut.i = n1 AND ut.j = n2 AND ut.u = m.u)"
    )


_K = "gene_id, tx1, tx2, sp"
_FOLD = """list_reduce({items}, lambda acc, s: CASE
  WHEN coalesce(s.p1 < acc.best AND s.importance > acc.importance, false) THEN {{'diff': s.diff, 'p1': s.p1, 'p2': s.p2, 'sp': s.sp, 'importance': s.importance, 'prob': s.prob / 2, 'best': s.p1}}
  WHEN coalesce(s.p2 < acc.best AND s.importance > acc.importance, false) THEN {{'diff': s.diff, 'p1': s.p1, 'p2': s.p2, 'sp': s.sp, 'importance': s.importance, 'prob': s.prob / 2, 'best': s.p2}}
  ELSE acc END, {{'diff': 0.0::DOUBLE, 'p1': 0.0::DOUBLE, 'p2': 0.0::DOUBLE, 'sp': 0::INT, 'importance': 0.0::DOUBLE, 'prob': 0.0::DOUBLE, 'best': 1.0::DOUBLE}})"""
_ITEM = "list({{'diff': diff, 'p1': {p}, 'p2': {q}, 'sp': sp::INT, 'importance': importance, 'prob': {prob}, 'best': 0.0::DOUBLE}} ORDER BY sp)"
#: Candidates ``cd``: both directions of each pair with a point, with p values and ``corr``.
_CAND = (
    f"{_UC}, {_SEG}, ce AS (SELECT {_K}, CASE WHEN tp < sp THEN 0 ELSE 1 END AS side, a, b FROM st JOIN pr USING (gene_id, tx1, tx2) WHERE tp >= p0 AND tp < p1), "
    f"ca AS (SELECT {_K}, side, a AS v FROM ce), cb AS (SELECT {_K}, side, b AS v FROM ce), {rank_test_sql('ca', _K, 'pa')}, {rank_test_sql('cb', _K, 'pb')}, "
    f"sv AS (SELECT {_K}, CASE WHEN count(*) FILTER (tp IN (sp - 1, sp) AND top = 0) > 0 THEN NULL ELSE round(sum((a + b) / nullif(top, 0)) FILTER (tp IN (sp - 1, sp)) / 12, 12) END AS importance, (abs(avg(a) FILTER (tp >= p0 AND tp < sp) - avg(a) FILTER (tp >= sp AND tp < p1)) + abs(avg(b) FILTER (tp >= p0 AND tp < sp) - avg(b) FILTER (tp >= sp AND tp < p1))) / 2 AS diff, "
    "avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END) FILTER (tp >= p0 AND tp < sp) + avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END) FILTER (tp >= sp AND tp < p1) AS ab, avg(CASE WHEN b > a THEN 1.0 ELSE 0.0 END) FILTER (tp >= p0 AND tp < sp) + avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END) FILTER (tp >= sp AND tp < p1) AS ba FROM st JOIN pr USING (gene_id, tx1, tx2) GROUP BY ALL), "
    f"it AS (SELECT gene_id, tx1, tx2, string_agg(CAST(sp AS VARCHAR), ',' ORDER BY sp) AS points, {_ITEM.format(p='pa.p', q='pb.p', prob='ab')} AS i1, {_ITEM.format(p='pb.p', q='pa.p', prob='ba')} AS i2 FROM sv JOIN pa USING ({_K}) JOIN pb USING ({_K}) GROUP BY gene_id, tx1, tx2), "
    f"bs AS (SELECT gene_id, tx1, tx2, points, tx1 AS one, tx2 AS two, {_FOLD.format(items='i1')} AS f FROM it UNION ALL SELECT gene_id, tx1, tx2, points, tx2, tx1, {_FOLD.format(items='i2')} FROM it), "
    "dc AS (SELECT gene_id, tx1, tx2, CASE WHEN count(r) = 3 THEN avg(r) END AS corr FROM (SELECT gene_id, tx1, tx2, rep, CASE WHEN var_pop(ra) = 0 OR var_pop(rb) = 0 THEN NULL ELSE (1 - corr(ra, rb)) / 2 END AS r FROM pr GROUP BY ALL) GROUP BY ALL), "
    "md AS (SELECT gene_id, tx1, tx2, tp, median(ra) AS ma, median(rb) AS mb FROM pr GROUP BY ALL), "
    "cd AS (SELECT bs.gene_id, CASE WHEN CASE WHEN one = bs.tx1 THEN ma > mb ELSE mb > ma END THEN one ELSE two END AS major_transcript, CASE WHEN CASE WHEN one = bs.tx1 THEN ma > mb ELSE mb > ma END THEN two ELSE one END AS minor_transcript, f.prob AS switch_prob, f.diff AS diff, f.p1 AS maj_pval, f.p2 AS min_pval, CASE WHEN f.p1 * f.p2 <= 0 THEN 0.0 ELSE f.p1 * f.p2 * (1 - ln(f.p1 * f.p2)) END AS p_value, corr, f.sp AS best_switch_point, f.importance AS event_importance, points "
    "FROM bs JOIN dc USING (gene_id, tx1, tx2) JOIN md ON md.gene_id = bs.gene_id AND md.tx1 = bs.tx1 AND md.tx2 = bs.tx2 AND md.tp = (f.sp + 6) % 7)"
)
_ROUNDED = "round(switch_prob, 6) AS switch_prob, round(diff, 6) AS diff, round(maj_pval, 6) AS maj_pval, round(min_pval, 6) AS min_pval, round(p_value, 6) AS p_value, round(corr, 6) AS corr, best_switch_point, round(event_importance, 6) AS event_importance"


def _found(diff: str, corr: str, p: str) -> str:
    """``kp``: the events that pass the cutoffs, one a pair."""
    return f"aj AS (SELECT *, least(1.0, max(p_value * (n - i + 1) / n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS adj_pval FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS n FROM cd)), kp AS (SELECT * FROM aj WHERE switch_prob > 0.5 AND diff > {diff} AND adj_pval < {p} AND corr > {corr} AND event_importance > 0.1 QUALIFY row_number() OVER (PARTITION BY major_transcript, minor_transcript ORDER BY switch_prob DESC, p_value, maj_pval) = 1)"


_TAIL = "least(1.0, list_sum(list_transform(range(CAST({k} AS BIGINT), CAST(least({m}, {n}) AS BIGINT) + 1), lambda x: CASE WHEN {n} - x > {t} - {m} THEN 0.0 ELSE exp(lgamma({m} + 1) - lgamma(x + 1) - lgamma({m} - x + 1) + lgamma({t} - {m} + 1) - lgamma({n} - x + 1) - lgamma({t} - {m} - {n} + x + 1) - lgamma({t} + 1) + lgamma({n} + 1) + lgamma({t} - {n} + 1)) END)))"


def tail_sql(total: str, marked: str, drawn: str, hits: str) -> str:
    """P(X >= hits) by log-gammas."""
    return _TAIL.format(t=f"CAST({total} AS DOUBLE)", m=f"CAST({marked} AS DOUBLE)", n=f"CAST({drawn} AS DOUBLE)", k=hits)


_ONE = _PAIR.replace("FROM expr WINDOW", "FROM expr WHERE rep = 0 WINDOW")
_ANN = "an AS (SELECT transcript_id, list(DISTINCT exon) AS x, list(DISTINCT pfam) AS p FROM ann GROUP BY ALL)"
_MINUS = "array_to_string(list_sort(list_filter(coalesce({a}, []), lambda v: {no}list_contains(coalesce({b}, []), v))), ',')"
_PERM = f"pm AS (SELECT perm, tp, CAST(row_number() OVER (PARTITION BY perm ORDER BY md5('1234321 ' || perm || ' ' || tp)) - 1 AS INT) AS moved FROM range(100) p(perm), range({N}) t(tp))"
ORACLE_SQL = {
    "switch_candidates": "WITH RECURSIVE " + V("expr", f"{_CAND} SELECT gene_id, major_transcript, minor_transcript, {_ROUNDED} FROM cd")[5:],
    "detect_switches": "WITH RECURSIVE " + V("expr ann", f"{_CAND}, {_found('0.05', '0.5', '0.05')}, {_ANN} SELECT gene_id, major_transcript, minor_transcript, {_ROUNDED}, points AS all_switch_points, round(adj_pval, 6) AS adj_pval, {_MINUS.format(a='m.x', b='j.x', no='NOT ')} AS gain_exons, {_MINUS.format(a='j.x', b='m.x', no='NOT ')} AS loss_exons, {_MINUS.format(a='j.x', b='m.x', no='')} AS constant_exons, array_to_string(list_sort(list_concat(list_filter(coalesce(j.p, []), lambda v: NOT list_contains(coalesce(m.p, []), v)), list_filter(coalesce(m.p, []), lambda v: NOT list_contains(coalesce(j.p, []), v)))), ',') AS exclusive_domains FROM kp LEFT JOIN an j ON j.transcript_id = major_transcript LEFT JOIN an m ON m.transcript_id = minor_transcript")[5:],
    "events_summary": "WITH RECURSIVE " + V("expr", f"{_CAND}, {_found('0.0', '0.0', '0.5')} SELECT count(DISTINCT gene_id) AS genes, count(*) AS events, round(avg(switch_prob), 6) AS mean_switch_prob, round(avg(diff), 6) AS mean_diff, round(avg(event_importance), 6) AS mean_event_importance, round(avg(corr), 6) AS mean_corr FROM kp")[5:],
    "switch_intervals": V("expr", f"{_SEG} SELECT gene_id, tx1, tx2, sp, CAST(least(sp - p0, p1 - sp) AS INT) AS nearest FROM st"),
    "switch_gene_usage": V("expr", "sh AS (SELECT *, CASE WHEN sum(value) OVER w = 0 THEN 0.0 ELSE value / sum(value) OVER w END AS ab FROM expr WHERE gene_id IN (SELECT 'G' || s_suppkey FROM supplier WHERE s_acctbal > 5000) WINDOW w AS (PARTITION BY gene_id, rep, tp)), st AS (SELECT *, abs(ab - lead(ab) OVER (PARTITION BY transcript_id, rep ORDER BY tp)) AS v FROM sh), t AS (SELECT gene_id, rep, tp, sum(v) AS v FROM st WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT gene_id, tp, round(median(v), 6) AS value FROM t GROUP BY ALL"),
    "best_point_single": V("expr", f"{_ONE}, am AS (SELECT *, row_number() OVER (PARTITION BY gene_id, tx1, tx2 ORDER BY tp) - 1 AS idx, coalesce(lag(tp) OVER (PARTITION BY gene_id, tx1, tx2 ORDER BY tp), 0) AS p0 FROM (SELECT gene_id, tx1, tx2, tp, round((lg + abs(a - b)) / 2, 12) AS m FROM sg WHERE tp > 0 AND s <> ls)), "
    "bp AS (SELECT * FROM am QUALIFY row_number() OVER (PARTITION BY gene_id, tx1, tx2 ORDER BY m DESC, tp) = 1), "
    "en AS (SELECT bp.gene_id, bp.tx1, bp.tx2, bp.tp AS sp, bp.m AS diff, bp.idx, coalesce((SELECT max(x.tp) FROM am x WHERE x.gene_id = bp.gene_id AND x.tx1 = bp.tx1 AND x.tx2 = bp.tx2 AND x.idx = bp.idx - 2), 0) AS e0, (SELECT max(x.tp) FROM am x WHERE x.gene_id = bp.gene_id AND x.tx1 = bp.tx1 AND x.tx2 = bp.tx2 AND x.idx = bp.idx - 1) AS e1 FROM bp) "
    "SELECT en.gene_id, en.tx1, en.tx2, CAST(sp AS INT) AS sp, round(diff, 6) AS diff, "
    "CASE WHEN idx >= 1 AND count(*) FILTER (tp IN (idx - 1, idx) AND top = 0) = 0 THEN round(sum((a + b) / nullif(top, 0)) FILTER (tp IN (idx - 1, idx)) / 4, 6) END AS importance, "
    "CASE WHEN idx >= 1 THEN round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END) FILTER (tp >= e0 AND tp < e1) + avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END) FILTER (tp >= e1 AND tp < sp), 6) END AS prob "
    "FROM en JOIN pr ON pr.gene_id = en.gene_id AND pr.tx1 = en.tx1 AND pr.tx2 = en.tx2 GROUP BY en.gene_id, en.tx1, en.tx2, sp, diff, idx, e0, e1"),
    "permutation_switches": V("expr", f"{_ONE}, {_PERM}, "
    "al AS (SELECT -1 AS perm, gene_id, tx1, tx2, tp, a, b, ra, rb FROM pr UNION ALL SELECT perm, gene_id, tx1, tx2, moved, a, b, ra, rb FROM pr JOIN pm USING (tp)), "
    "ls AS (SELECT *, sign(a - b) <> lag(sign(a - b)) OVER (PARTITION BY perm, gene_id, tx1, tx2 ORDER BY tp) AS pt FROM al), "
    f"iv AS (SELECT perm, gene_id, tx1, tx2, tp - coalesce(lag(tp) OVER w, 0) AS len FROM (SELECT perm, gene_id, tx1, tx2, tp FROM ls WHERE pt UNION ALL SELECT DISTINCT perm, gene_id, tx1, tx2, {N} FROM ls) WINDOW w AS (PARTITION BY perm, gene_id, tx1, tx2 ORDER BY tp)), "
    "fe AS (SELECT perm, gene_id, tx1, tx2, 'interval' AS feature, max(len)::DOUBLE AS value FROM iv GROUP BY ALL UNION ALL SELECT perm, gene_id, tx1, tx2, 'dissimilarity', CASE WHEN var_pop(ra) = 0 OR var_pop(rb) = 0 THEN NULL ELSE round((1 - corr(ra, rb)) / 2, 9) END FROM al GROUP BY ALL), "
    "sp AS (SELECT p.gene_id, p.tx1, p.tx2, p.feature, (1.0 + count(*) FILTER (p.value >= o.value)) / (1.0 + count(*)) AS p FROM fe p JOIN fe o ON o.perm = -1 AND p.perm >= 0 AND o.gene_id = p.gene_id AND o.tx1 = p.tx1 AND o.tx2 = p.tx2 AND o.feature = p.feature WHERE p.value IS NOT NULL AND o.value IS NOT NULL GROUP BY ALL), "
    "lp AS (SELECT gene_id, tx1, tx2, count(*) AS k, -sum(ln(p)) AS s FROM sp GROUP BY ALL) SELECT gene_id, tx1, tx2, round(least(1.0, CASE k WHEN 1 THEN exp(-s) ELSE exp(-s) * (1 + s) END), 6) AS p FROM lp"),
    "switch_points": V("expr", f"{_PAIR} SELECT * FROM pt"),
    "switch_consensus": V("expr", f"{_CONS} SELECT p.gene_id, p.tx1, p.tx2, coalesce(string_agg(CAST(sp AS VARCHAR), ',' ORDER BY sp), '') AS points, round(count(sp) / 7.0::DOUBLE, 6) AS ratio FROM (SELECT DISTINCT gene_id, tx1, tx2 FROM pr) p LEFT JOIN cp USING (gene_id, tx1, tx2) GROUP BY ALL"),
    "switch_magnitude": V("expr", f"{_CONS} SELECT cp.gene_id, cp.tx1, cp.tx2, sp, round(avg(greatest(lg, abs(a - b))), 6) AS magnitude FROM cp JOIN sg ON cp.gene_id = sg.gene_id AND cp.tx1 = sg.tx1 AND cp.tx2 = sg.tx2 AND sg.tp = cp.sp GROUP BY ALL"),
    "switch_dissimilarity": V("expr", f"{_PAIR}, c AS (SELECT gene_id, tx1, tx2, rep, CASE WHEN var_pop(ra) = 0 OR var_pop(rb) = 0 THEN NULL ELSE (1 - corr(ra, rb)) / 2 END AS r FROM pr GROUP BY ALL) SELECT gene_id, tx1, tx2, CASE WHEN count(r) = 3 THEN round(avg(r), 6) END AS corr FROM c GROUP BY ALL"),
    "switch_segments": V("expr", f"{_SEG} SELECT st.gene_id, st.tx1, st.tx2, sp, CASE WHEN count(*) FILTER (tp IN (sp - 1, sp) AND top = 0) > 0 THEN NULL ELSE round(sum((a + b) / nullif(top, 0)) FILTER (tp IN (sp - 1, sp)) / 12, 6) END AS importance, round((abs(avg(a) FILTER (tp >= p0 AND tp < sp) - avg(a) FILTER (tp >= sp AND tp < p1)) + abs(avg(b) FILTER (tp >= p0 AND tp < sp) - avg(b) FILTER (tp >= sp AND tp < p1))) / 2, 6) AS diff, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END) FILTER (tp >= p0 AND tp < sp) + avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END) FILTER (tp >= sp AND tp < p1), 6) AS prob_ab, round(avg(CASE WHEN b > a THEN 1.0 ELSE 0.0 END) FILTER (tp >= p0 AND tp < sp) + avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END) FILTER (tp >= sp AND tp < p1), 6) AS prob_ba FROM st JOIN pr USING (gene_id, tx1, tx2) GROUP BY ALL"),
    "major_minor": V("expr", f"{_CONS} SELECT cp.gene_id, cp.tx1, cp.tx2, sp, CASE WHEN median(ra) > median(rb) THEN cp.tx1 ELSE cp.tx2 END AS major_transcript FROM cp JOIN pr ON cp.gene_id = pr.gene_id AND cp.tx1 = pr.tx1 AND cp.tx2 = pr.tx2 AND pr.tp = sp - 1 GROUP BY cp.gene_id, cp.tx1, cp.tx2, sp"),
    "total_isoform_usage": V("expr", "sh AS (SELECT *, CASE WHEN sum(value) OVER w = 0 THEN 0.0 ELSE value / sum(value) OVER w END AS ab FROM expr WINDOW w AS (PARTITION BY gene_id, rep, tp)), st AS (SELECT *, abs(ab - lead(ab) OVER (PARTITION BY transcript_id, rep ORDER BY tp)) AS v FROM sh), t AS (SELECT gene_id, rep, tp, sum(v) AS v FROM st WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT gene_id, tp, round(median(v), 6) AS value FROM t GROUP BY ALL"),
    "isoform_usage": V("expr", "sh AS (SELECT *, CASE WHEN sum(value) OVER w = 0 THEN 0.0 ELSE value / sum(value) OVER w END AS ab FROM expr WINDOW w AS (PARTITION BY gene_id, rep, tp)), st AS (SELECT *, abs(ab - lead(ab) OVER (PARTITION BY transcript_id, rep ORDER BY tp)) AS v FROM sh) SELECT gene_id, transcript_id, rep, tp, round(v, 6) AS value FROM st WHERE v IS NOT NULL"),
    "isoform_abundance": V("expr net", f"{_SHARE} SELECT gene_id, transcript_id, rep, tp, round(ab, 6) AS abundance FROM sh WHERE gene_id IN (SELECT src FROM net UNION SELECT dst FROM net)"),
    "gain_loss_exons": V("ann", "l AS (SELECT gene_id, transcript_id, list(DISTINCT exon) AS x, list(DISTINCT pfam) AS p FROM ann GROUP BY ALL), j AS (SELECT a.gene_id, a.transcript_id AS major_transcript, b.transcript_id AS minor_transcript, a.x AS ax, b.x AS bx, a.p AS ap, b.p AS bp FROM l a JOIN l b ON a.gene_id = b.gene_id AND a.transcript_id < b.transcript_id) SELECT gene_id, major_transcript, minor_transcript, array_to_string(list_sort(list_filter(bx, lambda v: NOT list_contains(ax, v))), ',') AS gain_exons, array_to_string(list_sort(list_filter(ax, lambda v: NOT list_contains(bx, v))), ',') AS loss_exons, array_to_string(list_sort(list_filter(ax, lambda v: list_contains(bx, v))), ',') AS constant_exons, array_to_string(list_sort(list_concat(list_filter(ap, lambda v: NOT list_contains(bp, v)), list_filter(bp, lambda v: NOT list_contains(ap, v)))), ',') AS exclusive_domains FROM j"),
    "fdr_faithful": V("pv", "o AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM pv) SELECT id, p, round(least(1.0, max(p * (n - i + 1) / n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 9) AS adj_p FROM o"),
    "fdr_standard": V("pv", "o AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM pv) SELECT id, p, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 9) AS adj_p FROM o"),
    "holm": V("pv", "o AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM pv) SELECT id, p, round(least(1.0, max(p * (n - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 9) AS adj_p FROM o"),
    "bonferroni": V("pv", "SELECT id, p, round(least(1.0, p * count(*) OVER ()), 9) AS adj_p FROM pv"),
    "fisher_combine": V("pv", "g AS (SELECT grp, count(*) AS k, -sum(ln(p)) AS s FROM pv GROUP BY grp) SELECT grp, k, round(least(1.0, list_sum(list_transform(range(k), lambda j: CASE WHEN s = 0 THEN CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-s + j * ln(s) - lgamma(j + 1)) END))), 9) AS combined_p FROM g"),
    "empirical_pvalue": V("pv", "SELECT grp, count(*) FILTER (p >= 0.5) AS better, count(*) AS total, round((1.0 + count(*) FILTER (p >= 0.5)) / (1.0 + count(*)), 9) AS p FROM pv GROUP BY grp"),
    "hypergeom_tail": f"WITH g AS (SELECT p_brand, p_size, count(*) AS h FROM part GROUP BY ALL), r AS (SELECT *, sum(h) OVER (PARTITION BY p_brand) AS m, sum(h) OVER (PARTITION BY p_size) AS n, sum(h) OVER () AS t FROM g) SELECT p_brand, p_size, round({tail_sql('t', 'm', 'n', 'h')}, 8) AS p FROM r",
    "fisher_exact_greater": f"WITH g AS (SELECT p_brand, p_size, count(*) AS h FROM part GROUP BY ALL), r AS (SELECT *, sum(h) OVER (PARTITION BY p_brand) AS m, sum(h) OVER (PARTITION BY p_size) AS n, sum(h) OVER () AS t FROM g) SELECT p_brand, p_size, round({tail_sql('2 * t', 'm', 'n', 'h')}, 9) AS p FROM r",
}
