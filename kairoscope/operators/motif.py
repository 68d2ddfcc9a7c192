"""Sequence motifs: count matrices, log-odds scores at every offset, groups of exons and splicing-factor co-expression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions.score_udf import score_limit_column
from kairoscope.functions.tests_udf import pearson_pvalues, pearson_table, rank_pvalue_column
from kairoscope.operators import blocks, prep, stats, steps
from kairoscope.session import cut

LETTERS = ("a", "c", "g", "t")
#: Positions of all motifs of a scan together.
LIBRARY = 1_000_000
#: Buckets of scores in each unit, for ranks.
BUCKETS = 64
#: The most factors and transcripts of a block of correlations (the least where passes count), and the factors of a strip.
BLOCK = (256, 1024, 32)
#: Where passes count before rows leave: the most factors and transcripts of a block, the blocks of both that are wanted, and the transcripts of a strip.
PASS = (16384, 32768, 2, 64, 2048)
#: Where pairs are counted and don't leave: the most factors and transcripts of a block and the blocks of transcripts that are wanted; and the factors and (about) the transcripts of a tile.
TALLY, TILE = (8192, 16384, 64), (128, 2048)


def gc_fraction(seq: Column, digits: int | None = 2) -> Column:
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(seq, "[^GCgc]", "")), F.length(seq)), F.lit(0.0))
    return share if digits is None else F.round(share, digits)


def normalised(pwm: DataFrame) -> DataFrame:
    """Counts as shares of their position; positions without counts are left out."""
    total = sum((F.col(x) for x in LETTERS[1:]), F.col(LETTERS[0]))
    return pwm.select("sf", "motif_id", "pos", *(F.try_divide(F.col(x), total).alias(x) for x in LETTERS)).where("a IS NOT NULL")


def log_odds(pwm: DataFrame) -> DataFrame:
    """sf, motif_id, width, odds: for each position the shares of a, c, g, t, in order."""
    rows = normalised(pwm).groupBy("sf", "motif_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.array(*LETTERS).alias("s")))).alias("r"))
    return rows.select("sf", "motif_id", F.size("r").alias("width"), F.transform("r", lambda x: x["s"]).alias("odds"))


def scan(sequences: DataFrame, pwm: DataFrame, gc_ratio: float | None = None) -> DataFrame:
    """doc_id, grp, sf, motif_id, scores: log2 odds at each offset against the background of the sequence's own (or the given) GC share; null where a count is zero.

    The library of motifs (at most LIBRARY positions, however many sequences there are) goes to every task; a sequence is scored by
    adding one shifted row of odds a position, and results leave in batches of bounded size.
    """
    found = log_odds(pwm).orderBy("sf", "motif_id").collect()
    if sum(r["width"] for r in found) > LIBRARY:
        raise ValueError(f"a library holds at most {LIBRARY} positions; scan with parts of it")
    with np.errstate(divide="ignore"):
        library = [(r["sf"], r["motif_id"], np.log2(np.array(r["odds"], float))) for r in found]
    place = np.zeros(256, np.intp)
    place[[ord(c) for c in "ACGT"]] = range(4)
    s = sequences.select("doc_id", "grp", "seq", (gc_fraction(F.col("seq"), None) if gc_ratio is None else F.lit(gc_ratio)).alias("gc"))
    kind = dict(s.dtypes)["doc_id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, which, parts, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                flat = np.concatenate(parts) if parts else np.zeros(0)
                ends = np.cumsum([0, *map(len, parts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, mask=~np.isfinite(flat)))  # noqa: B023
                taken = pa.array(row, pa.int64())  # noqa: B023
                names = [pa.array([library[m][k] for m in which], pa.string()) for k in (0, 1)]  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), batch.column("grp").take(taken), *names, lists], ["doc_id", "grp", "sf", "motif_id", "scores"])  # noqa: B023

            for i, (seq, gc) in enumerate(zip(batch.column("seq").to_pylist(), batch.column("gc").to_pylist(), strict=True)):
                code = place[np.frombuffer(seq.encode(), np.uint8)]
                with np.errstate(divide="ignore"):
                    back = np.log2(np.array([1 - gc, gc, gc, 1 - gc]) / 2)
                for m, (_, _, odds) in enumerate(library):
                    n = len(code) - len(odds) + 1
                    if n < 1:
                        continue
                    table = np.full(odds.shape, -np.inf)
                    np.subtract(odds, back, out=table, where=np.isfinite(odds) & np.isfinite(back))
                    total = np.zeros(n)
                    for k, line in enumerate(table):
                        total += line[code[k : k + n]]
                    row.append(i)
                    which.append(m)
                    parts.append(total)
                    held += n
                    if held >= 1_000_000:
                        yield flush()
                        row, which, parts, held = [], [], [], 0
            yield flush()

    return s.mapInArrow(scored, f"doc_id {kind}, grp string, sf string, motif_id string, scores array<double>")


def hits(scans: DataFrame, threshold: float) -> DataFrame:
    """doc_id, grp, sf, motif_id, n_hits (scores over the threshold), best."""
    return scans.select("doc_id", "grp", "sf", "motif_id", F.size(F.filter("scores", lambda x: x > threshold)).alias("n_hits"), F.array_max("scores").alias("best"))


def background(sequences: DataFrame) -> DataFrame:
    """gc: the GC share of all letters, one row; null without letters."""
    many = F.sum(F.length(F.regexp_replace("seq", "[^GCgc]", "")))
    return sequences.agg(F.try_divide(many, F.sum(F.length("seq"))).alias("gc"))


def thresholds(pwm: DataFrame, background: DataFrame | float = 0.6, rate: float = 1e-3, step: float = 1e-3) -> DataFrame:
    """sf, motif_id, threshold, share: for each motif the lowest score that random words exceed with a probability of ``rate`` at most, and that probability.

    Words are drawn with the GC share of ``background`` (one row gc, or a number).  Their scores' distribution is exact, but for positions' log odds that are rounded to
    ``step``: it is built up position by position, so no words are listed.  A motif that no word fits has no row.
    """
    motifs = log_odds(pwm)
    both = motifs.withColumn("gc", F.lit(background)) if isinstance(background, float) else motifs.crossJoin(F.broadcast(background.select("gc")))  # one row
    return both.select("sf", "motif_id", score_limit_column(rate, step)("odds", "gc").alias("x")).where("x.threshold IS NOT NULL").select("sf", "motif_id", "x.threshold", "x.share")


def over(scans: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """scans with h, the scores over the threshold: a number for all motifs, or a table (sf, motif_id, threshold); motifs without one are left out."""
    if isinstance(threshold, DataFrame):  # at most as many rows as the library has motifs
        known = scans.join(F.broadcast(threshold.select("sf", "motif_id", "threshold")), ["sf", "motif_id"])
        return known.withColumn("h", F.expr("filter(scores, x -> x > threshold)")).drop("threshold")
    return scans.withColumn("h", F.filter("scores", lambda x: x > threshold))


def group_table(scans: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """sf, motif_id, grp, label, n_sequences, n_hits, mean_hit: hits of each group, labelled LE, GE or UE with the number of sequences."""
    sums = over(scans, threshold).groupBy("sf", "motif_id", "grp").agg(F.count("*").alias("n_sequences"), F.sum(F.size("h")).alias("n_hits"), F.sum(F.aggregate("h", F.lit(0.0), lambda s, x: s + x)).alias("total"))
    name = F.when(F.col("grp") == "lost", "LE").when(F.col("grp") == "gained", "GE").otherwise("UE")
    return sums.select("sf", "motif_id", "grp", F.concat(name, F.lit(" ("), F.col("n_sequences").cast("string"), F.lit(")")).alias("label"), "n_sequences", "n_hits", prep.ratio(F.col("total"), F.col("n_hits")).alias("mean_hit"))


def group_tests(scans: DataFrame, threshold: float | DataFrame | None = None) -> DataFrame:
    """sf, motif_id, lost_vs_background, gained_vs_background, lost_vs_gained: one-sided rank tests of all scores over the threshold (a number, or ``thresholds``);
    without a threshold, of each sequence's best score.  Scores are rounded, so that equal ones are ties; a test without scores in one group has p 1.

    Equal scores are counted first; how many lie below each comes from sums over buckets of scores and inside each bucket, so no task ranks all scores of a motif.
    """
    if threshold is None:
        taken = scans.select("sf", "motif_id", "grp", F.round(F.array_max("scores"), 9).alias("score")).where("score IS NOT NULL")
    else:
        taken = over(scans, threshold).select("sf", "motif_id", "grp", F.explode("h").alias("score")).withColumn("score", F.round("score", 9))
    groups = ("lost", "gained", "background")
    n = taken.groupBy("sf", "motif_id", "score").agg(*(F.count_if(F.col("grp") == g).alias(g) for g in groups)).withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    totals = n.groupBy("sf", "motif_id", "bucket").agg(*(F.sum(g).alias(g) for g in groups))
    before = Window.partitionBy("sf", "motif_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sf", "motif_id", "bucket", *(F.coalesce(F.sum(g).over(before), F.lit(0)).alias(f"{g}_below") for g in groups))
    inside = Window.partitionBy("sf", "motif_id", "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = n.join(totals, ["sf", "motif_id", "bucket"]).withColumns({f"{g}_below": F.col(f"{g}_below") + F.coalesce(F.sum(g).over(inside), F.lit(0)) for g in groups})
    tests = (("lost", "background"), ("gained", "background"), ("lost", "gained"))
    # As doubles: products and cubes of counts outgrow longs, and only small samples need them exact.
    size = lambda x: F.col(x).cast("double")
    twice = [F.sum(size(x) * (2 * size(f"{y}_below") + size(y))).alias(f"u_{x}_{y}") for x, y in tests]
    ties = [F.sum(F.pow(size(x) + size(y), F.lit(3)) - (size(x) + size(y))).alias(f"t_{x}_{y}") for x, y in tests]
    sums = ranked.groupBy("sf", "motif_id").agg(*(F.sum(g).alias(g) for g in groups), *twice, *ties)
    p = rank_pvalue_column("greater")
    return sums.select("sf", "motif_id", *(p(F.col(x), F.col(y), F.col(f"u_{x}_{y}"), F.col(f"t_{x}_{y}")).alias(f"{x}_vs_{y}") for x, y in tests))


def windows(exons: DataFrame, genome: DataFrame, site: str = "5p", flanking: int = 400) -> DataFrame:
    """exon_id, seq: the stretch around an exon's start (5p) or end (3p) of a sequence table (seqname, sequence), coordinates from 1."""
    at = F.col("start") if site == "5p" else F.col("end")
    first = F.greatest(F.lit(1), at - flanking)
    both = exons.join(genome, "seqname")
    return both.select("exon_id", F.upper(F.substr("sequence", first.cast("int"), (at + flanking - first + 1).cast("int"))).alias("seq"))


def exon_sets(events: DataFrame, which: str = "loss", mode: str = "all") -> DataFrame:
    """gene_id, exon of the loss, gain or constant exons of switch events; mode ``last`` keeps the last event of a gene only."""
    column = f"{which}_exons"
    kept = events
    if mode == "last":
        last = events.groupBy("gene_id").agg(F.max_by(column, F.struct("p_value", "major_transcript", "minor_transcript")).alias(column))
        kept = last
    return kept.select("gene_id", F.explode(column).alias("exon")).distinct()


def centred(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows less their mean, and their sums of squares, summed in order of the values."""
    x = np.stack(values.to_numpy()).astype(float)
    x = x - (np.cumsum(x, 1)[:, -1] / x.shape[1])[:, None]
    return x, np.cumsum(x * x, 1)[:, -1]


def factor_blocks(frame: DataFrame, names: list[str], values: str, size: int) -> tuple[DataFrame, int]:
    """Series that aren't constant, in blocks of about ``size`` dealt by the last of ``names``, and how many there are."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        x, square = centred(rows[values])
        kept = square > 0
        return pd.DataFrame({"n": [int(kept.sum())], **{c: [rows[c].to_numpy()[kept].tolist()] for c in names}, values: [x[kept].tobytes()], f"{values}_squares": [square[kept].tobytes()]})

    count = -(-frame.count() // size) or 1
    dealt = frame.withColumn("blk", F.pmod(F.xxhash64(names[-1]), F.lit(count))).groupBy("blk")
    packs = cut(dealt.applyInPandas(pack, f"n long, {', '.join(f'{c} array<string>' for c in names)}, {values} binary, {values}_squares binary").where("n > 0"))
    return packs.drop("n"), packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def correlated(factors: DataFrame, transcripts: DataFrame, points: int, cutoff: float) -> tuple[DataFrame, int]:
    """sf, gene_id, transcript_id, corr, p_value of the pairs whose correlation has a size of ``cutoff`` or more, and the number of all pairs that have one.

    factors: sf, x; transcripts: gene_id, transcript_id, y (arrays of ``points``).  Blocks of both meet, and pairs are rows only where they leave.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(row[c]).reshape(-1, points) for c in "xy")
                xx, yy = np.frombuffer(row["x_squares"]), np.ascontiguousarray(np.frombuffer(row["y_squares"]))
                names = [pa.array(row[c]) for c in ("sf", "gene_id", "transcript_id")]
                columns = np.ascontiguousarray(y.T)
                for at in range(0, len(x), BLOCK[2]):
                    part = slice(at, at + BLOCK[2])
                    r = np.zeros((len(x[part]), len(y)))
                    for v, w in zip(x[part].T, columns, strict=True):
                        r += v[:, None] * w
                    r /= np.sqrt(xx[part, None] * yy)
                    i, j = np.nonzero(np.abs(r) >= cutoff)
                    if len(i):
                        kept = r[i, j]
                        p = pearson_pvalues(kept, points)
                        yield pa.RecordBatch.from_arrays([names[0].take(pa.array(i + at)), names[1].take(pa.array(j)), names[2].take(pa.array(j)), pa.array(kept), pa.array(p, mask=np.isnan(p))], ["sf", "gene_id", "transcript_id", "corr", "p_value"])

    a, n_a = factor_blocks(cut(factors), ["sf"], "x", BLOCK[0])
    b, n_b = factor_blocks(cut(transcripts), ["gene_id", "transcript_id"], "y", BLOCK[1])
    both = blocks.spread(a.crossJoin(b), a.count() * b.count())  # a row a pair of blocks
    return both.mapInArrow(compare, "sf string, gene_id string, transcript_id string, corr double, p_value double"), n_a * n_b


def tallied(factors: DataFrame, transcripts: DataFrame, points: int, cutoff: float, even: bool = False) -> DataFrame:
    """sf, grp, up, down: how many transcripts of a group follow and oppose a factor by a correlation over ``cutoff``; a row for each block that holds some of the group.

    factors: sf, x; transcripts: grp string, gene_id, transcript_id, y.  Without ``even`` up and down are 1 or 0, and groups may lie in many blocks.  With it groups are genes, which lie in
    one block where they fit, and those that do leave only where up and down are equal.  Correlations come from a product; those within its rounding of the cutoff are taken again.
    """
    transcripts = cut(transcripts)
    many = transcripts.groupBy("gene_id").agg(F.ceil(F.count("*") / BLOCK[1]).alias("pieces"))
    size = min(max(BLOCK[1], transcripts.count() // TALLY[2]), TALLY[1])
    count = -(-transcripts.count() // size) or 1

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        code, groups = pd.factorize(rows["grp"], use_na_sentinel=False)
        y, square = centred(rows["y"])
        at = np.flatnonzero(square > 0)
        at = at[np.argsort(code[at], kind="stable")]
        held, starts = np.unique(code[at], return_index=True)
        whole = rows["pieces"].to_numpy()[at[starts]] == 1 if even else np.zeros(len(starts), bool)
        names = [g if isinstance(g, str) else None for g in np.asarray(groups, object)[held]]
        return pd.DataFrame({"n": [len(at)], "groups": [names], "starts": [starts.astype(np.int64).tobytes()], "whole": [whole.tobytes()], "y": [y[at].tobytes()], "y_squares": [square[at].tobytes()]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(row[c]).reshape(-1, points) for c in "xy")
                xx, yy = np.frombuffer(row["x_squares"]), np.frombuffer(row["y_squares"])
                starts, whole = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["whole"], bool)
                sf, groups = pa.array(row["sf"], pa.string()), pa.array(row["groups"], pa.string())
                p, q = x / np.sqrt(xx)[:, None], y / np.sqrt(yy)[:, None]
                tiles = [0, *(k for k in range(1, len(starts)) if starts[k] // TILE[1] > starts[k - 1] // TILE[1]), len(starts)]  # no group is in two
                ends = np.append(starts, len(y))
                for at in range(0, len(x), TILE[0]):
                    for g, h in zip(tiles[:-1], tiles[1:], strict=True):
                        part, first = slice(ends[g], ends[h]), starts[g:h] - starts[g]
                        r = q[part] @ p[at : at + TILE[0]].T
                        j, i = np.nonzero(np.abs(np.abs(r) - cutoff) <= 1e-9)
                        if len(i):
                            again = np.zeros(len(i))
                            for k in range(points):
                                again += x[i + at, k] * y[j + ends[g], k]
                            r[j, i] = again / np.sqrt(xx[i + at] * yy[j + ends[g]])
                        two = [(r > cutoff).view(np.int8), (r < -cutoff).view(np.int8)]
                        if even:
                            kind = np.int8 if np.diff(ends[g : h + 1]).max() < 128 else np.int32
                            up, down = (np.add.reduceat(v.astype(kind, copy=False), first, axis=0, dtype=kind) for v in two)
                            j, i = np.nonzero(np.where(whole[g:h, None], (up == down) & (up > 0), (up > 0) | (down > 0)))
                        else:
                            up, down = (np.maximum.reduceat(v, first, axis=0) for v in two)
                            j, i = np.nonzero(up | down)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([sf.take(pa.array(i + at)), groups.take(pa.array(j + g)), *(pa.array(v[j, i].astype(np.int32)) for v in (up, down)), pa.array(whole[j + g])], ["sf", "grp", "up", "down", "whole"])

    a, _ = factor_blocks(cut(factors), ["sf"], "x", TALLY[0])
    place = F.pmod(F.xxhash64("gene_id", F.pmod(F.xxhash64("transcript_id"), F.col("pieces"))), F.lit(count))
    dealt = transcripts.join(many, "gene_id").select("grp", "y", "pieces", place.alias("blk")).groupBy("blk")
    b = cut(dealt.applyInPandas(pack, "n long, groups array<string>, starts binary, whole binary, y binary, y_squares binary").where("n > 0").drop("n"))
    both = blocks.spread(a.crossJoin(b), a.count() * b.count())  # a row a pair of blocks
    return both.mapInArrow(compare, "sf string, grp string, up int, down int, whole boolean")


def tested_series(expr: DataFrame, factors: DataFrame, reps: int, timepoints: int, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """sf, x of the factors with a variance over 1, and gene_id, transcript_id, y of the transcripts of genes that have more than one (of ``genes``, if given)."""
    expr = cut(expr, forget=True)  # both read it
    at = (F.col("rep") * timepoints + F.col("tp")).alias("at")
    total = prep.gene_level(expr).join(factors.select("gene_id").distinct(), "gene_id", "left_semi")
    sf = total.groupBy(F.col("gene_id").alias("sf")).agg(F.var_pop("value").alias("variance"), F.array_sort(F.collect_list(F.struct(at, "value"))).alias("v")).where("variance > 1")
    share = prep.relative_abundance(expr if genes is None else expr.join(genes.select("gene_id").distinct(), "gene_id", "left_semi"))
    iso = cut(share.groupBy("gene_id", "transcript_id").agg(F.array_sort(F.collect_list(F.struct(at, F.col("abundance").alias("value")))).alias("w")))
    many = iso.groupBy("gene_id").agg(F.count("*").alias("n")).where("n > 1").select("gene_id")
    return sf.select("sf", F.col("v.value").alias("x")), iso.join(many, "gene_id", "left_semi").select("gene_id", "transcript_id", F.col("w.value").alias("y"))


def strips(row: dict, points: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of a pair of blocks: first factor, first transcript and the correlations of a strip, each the same in every pass."""
    x, y = (np.frombuffer(row[c]).reshape(-1, points) for c in "xy")
    xx, columns, yy = np.frombuffer(row["x_squares"]), np.ascontiguousarray(y.T), np.frombuffer(row["y_squares"])
    for j in range(0, len(y), PASS[4]):
        far = slice(j, j + PASS[4])
        for i in range(0, len(x), BLOCK[2]):
            part = slice(i, i + BLOCK[2])
            r = np.zeros((len(x[part]), len(yy[far])))
            each = np.empty_like(r)
            for v, w in zip(x[part].T, columns[:, far], strict=True):
                r += np.multiply(v[:, None], w, out=each)
            np.multiply(xx[part, None], yy[far], out=each)
            r /= np.sqrt(each, out=each)
            yield i, j, r


def corrected(factors: DataFrame, transcripts: DataFrame, points: int, method: str, corr_cutoff: float, padj_cutoff: float, digits: int) -> DataFrame | None:
    """sf, gene_id, transcript_id, corr, p_value, adj_p of the pairs under both cutoffs, adj_p rounded; a pair is a row only where it leaves.

    Passes over pairs of blocks find at which correlation each corrected value begins (``steps``); None where they can't tell.
    """
    factors, transcripts = cut(factors), cut(transcripts)
    a, n_a = factor_blocks(factors, ["sf"], "x", min(max(BLOCK[0], -(-factors.count() // PASS[2])), PASS[0]))
    b, n_b = factor_blocks(transcripts, ["gene_id", "transcript_id"], "y", min(max(BLOCK[1], -(-transcripts.count() // PASS[3])), PASS[1]))
    both = cut(blocks.spread(a.crossJoin(b), a.count() * b.count()))  # a row a pair of blocks
    tests = n_a * n_b

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for row in batch.to_pylist():
                for _, _, r in strips(row, points):
                    v = np.abs(r).ravel()
                    if len(v := v[v > corr_cutoff]):
                        yield v

    table = None
    if method != "bonferroni":
        measure = partial(steps.measured, sizes, both.select("x", "x_squares", "y", "y_squares"))
        table = steps.steps(measure, lambda x: pearson_pvalues(x, points), corr_cutoff, tests, method, digits, padj_cutoff)
        if table is None:
            return None

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pvalues = pearson_table(points, corr_cutoff)
        for batch in batches:
            for row in batch.to_pylist():
                names = [pa.array(row[c]) for c in ("sf", "gene_id", "transcript_id")]
                for at, far, r in strips(row, points):
                    k = np.flatnonzero(np.abs(r) > corr_cutoff)
                    i, j = np.divmod(k, r.shape[1])
                    kept = r.ravel()[k]
                    p = pvalues(kept)
                    adj, passed = (np.minimum(1.0, p * tests), p * tests < padj_cutoff) if table is None else table.of(np.abs(kept))
                    if table is None and padj_cutoff > 1.0:
                        passed = np.ones(len(p), bool)
                    if not passed.all():
                        i, j, kept, p, adj = (v[passed] for v in (i, j, kept, p, adj))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([names[0].take(pa.array(i + at)), *(v.take(pa.array(j + far)) for v in names[1:]), pa.array(kept), pa.array(p), pa.array(adj)], ["sf", "gene_id", "transcript_id", "corr", "p_value", "adj_p"])

    return both.mapInArrow(leave, "sf string, gene_id string, transcript_id string, corr double, p_value double, adj_p double")


def factor_coexpression(expr: DataFrame, factors: DataFrame, reps: int, timepoints: int, genes: DataFrame | None = None, method: str = "bonferroni", corr_cutoff: float = 0.7, padj_cutoff: float = 0.05, digits: int | None = None) -> DataFrame:
    """sf, gene_id, transcript_id, corr, p_value, adj_p, direction: factors (gene_id) whose expression follows or opposes a transcript's abundance.

    Factors with a variance over 1; transcripts of genes that have more than one (of ``genes``, if given).  With ``digits`` adj_p is rounded to so many and pairs are rows only where they
    leave; else (and by fdr_bh_standard, which asks for all p-values) pairs over the cutoff are corrected as rows.
    """
    series, points = tested_series(expr, factors, reps, timepoints, genes), reps * timepoints
    out = None
    if digits is not None and method != "fdr_bh_standard" and points > 2 and 0 <= corr_cutoff < 1:
        out = corrected(*series, points, method, corr_cutoff, padj_cutoff, digits)
    if out is None:
        tested, tests = correlated(*series, points, 0.0 if method == "fdr_bh_standard" else corr_cutoff)
        out = stats.adjust(tested, "p_value", "adj_p", method, None if method == "fdr_bh_standard" else tests).where((F.abs("corr") > corr_cutoff) & (F.col("adj_p") < padj_cutoff))
        out = out if digits is None else out.withColumn("adj_p", F.round("adj_p", digits))
    return out.withColumn("direction", F.when(F.col("corr") > 0, "+").otherwise("-"))


def correction_is_idle(points: int, method: str, corr_cutoff: float, padj_cutoff: float) -> bool:
    """Whether every correlation over the cutoff is under that of corrected p-values, too: ``fdr_bh`` makes no value larger than the largest p-value so far."""
    return method == "fdr_bh" and 0 < corr_cutoff < 1 and points > 2 and bool(pearson_pvalues(np.array([corr_cutoff]), points)[0] * (1 + 1e-9) < padj_cutoff)


def coexpression_sets(expr: DataFrame, factors: DataFrame, clusters: DataFrame, reps: int, timepoints: int, genes: DataFrame | None = None, method: str = "bonferroni", corr_cutoff: float = 0.7, padj_cutoff: float = 0.05) -> DataFrame:
    """``factor_sets`` of ``factor_coexpression``; where no correction can leave a pair out, pairs are marked in blocks and none becomes a row."""
    if not correction_is_idle(reps * timepoints, method, corr_cutoff, padj_cutoff):
        return factor_sets(factor_coexpression(expr, factors, reps, timepoints, genes, method, corr_cutoff, padj_cutoff), clusters)
    kind = clusters.schema["cluster"].dataType
    first = clusters.groupBy("gene_id").agg(F.min("cluster").cast("string").alias("grp"))
    sf, transcripts = tested_series(expr, factors, reps, timepoints, genes)
    found = tallied(sf, transcripts.join(first, "gene_id"), reps * timepoints, corr_cutoff)
    signs = F.filter(F.array(F.when(F.col("up") > 0, "+"), F.when(F.col("down") > 0, "-")), lambda v: v.isNotNull())
    each = found.select(F.col("grp").cast(kind).alias("cluster"), F.explode(signs).alias("direction"), "sf")
    return each.groupBy("cluster", "direction").agg(F.array_sort(F.collect_set("sf")).alias("sfs"))


def coexpression_balanced(expr: DataFrame, factors: DataFrame, reps: int, timepoints: int, genes: DataFrame | None = None, method: str = "bonferroni", corr_cutoff: float = 0.7, padj_cutoff: float = 0.05) -> DataFrame:
    """``balanced`` of ``factor_coexpression``; where no correction can leave a pair out, a gene's transcripts are counted in its block, and only genes too large for one are summed behind that."""
    if not correction_is_idle(reps * timepoints, method, corr_cutoff, padj_cutoff):
        return balanced(factor_coexpression(expr, factors, reps, timepoints, genes, method, corr_cutoff, padj_cutoff))
    sf, transcripts = tested_series(expr, factors, reps, timepoints, genes)
    many = cut(transcripts).withColumn("grp", F.col("gene_id"))
    found = tallied(sf, many, reps * timepoints, corr_cutoff, even=True)
    large = many.groupBy("gene_id").count().where(F.col("count") > BLOCK[1])
    out = found.where("whole").select(F.col("grp").alias("gene_id"), "sf", F.lit(0).cast("long").alias("net"))
    if large.isEmpty():
        return out
    rest = found.where("NOT whole").groupBy(F.col("grp").alias("gene_id"), "sf").agg(F.sum(F.col("up") - F.col("down")).alias("net")).where("net = 0")
    return out.unionByName(rest)


def factor_sets(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, direction, sfs: the distinct factors of each direction, by the first cluster of the gene (gene_id, cluster)."""
    first = clusters.groupBy("gene_id").agg(F.min("cluster").alias("cluster"))
    return found.join(first, "gene_id").groupBy("cluster", "direction").agg(F.array_sort(F.collect_set("sf")).alias("sfs"))


def unique_factors(sets: DataFrame) -> DataFrame:
    """cluster, both (found in both directions), positive, negative (only there)."""
    none = F.array().cast("array<string>")
    two = sets.groupBy("cluster").agg(F.coalesce(F.first(F.when(F.col("direction") == "+", F.col("sfs")), True), none).alias("p"), F.coalesce(F.first(F.when(F.col("direction") == "-", F.col("sfs")), True), none).alias("n"))
    return two.select("cluster", F.array_intersect("p", "n").alias("both"), F.array_except("p", "n").alias("positive"), F.array_except("n", "p").alias("negative"))


def balanced(found: DataFrame) -> DataFrame:
    """gene_id, sf, net: pairs whose directions cancel out."""
    net = found.groupBy("gene_id", "sf").agg(F.sum(F.when(F.col("direction") == "+", 1).otherwise(-1)).alias("net"))
    return net.where("net = 0")
