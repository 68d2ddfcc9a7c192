"""Steps that must not make a row of each pair before they know which they need."""

import numpy as np
import pytest

from kairoscope.operators import cluster


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def packed(spark, x):
    return spark.createDataFrame([(i, [None if v != v else float(v) for v in row]) for i, row in enumerate(x)], "object_idx long, vals array<double>")


@pytest.mark.parametrize("name", ["correlation", "softdtw", "euclidean"])
def test_all_pairs_come_from_blocks(spark, name):
    x = np.random.default_rng(3).normal(size=(150, 5))
    x[7] = 2.0
    found = cluster.pair_distances(packed(spark, x), name)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    want = cluster.block_distances(x, x, name)
    got = {(r["i"], r["j"]): r["distance"] for r in found.collect()}
    assert got.keys() == {(i, j) for i in range(150) for j in range(i + 1, 150)}
    assert all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())


def test_pairs_with_missing_values(spark):
    x = np.arange(12.0).reshape(4, 3) ** 2
    x[2, 1] = np.nan
    assert {(r["i"], r["j"]) for r in cluster.pair_distances(packed(spark, x)).where("distance IS NULL").collect()} == {(0, 2), (1, 2), (2, 3)}
    assert cluster.pair_distances(packed(spark, x), "correlation").where("distance = 0 AND (i = 2 OR j = 2)").count() == 3
    assert cluster.pair_distances(packed(spark, x).where("false")).count() == 0


def test_dense_clusters_make_no_row_of_each_near_pair(spark, monkeypatch):
    """Blocks of 16 objects, so that all steps meet; against the table of near pairs, which neither clustering takes."""
    from kairoscope.operators import density

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.4, (60, 4)), rng.normal(3, 0.7, (60, 4)), rng.uniform(-6, 6, (30, 4)), np.full((5, 4), 9.0)])
    monkeypatch.setattr(density, "BLOCK", 16)
    monkeypatch.setattr(density, "FIRST", 2)
    near = cluster.near_pairs(packed(spark, x), 1.5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert near.count() == (np.triu(d <= 1.5, 1)).sum()

    def refuse(*_):
        raise AssertionError("all near pairs")

    monkeypatch.setattr(cluster, "near_pairs", refuse)
    for least in (1, 3):
        adjacent = (d <= 1.5) & ~np.eye(len(x), dtype=bool)
        core = adjacent.sum(1) >= max(least - 1, 1)
        label = np.where(core, np.arange(len(x)), -1)
        for _ in range(len(x)):
            for i in np.flatnonzero(core):
                label[i] = min(label[i], label[adjacent[i] & core].min(initial=label[i]))
        order = {c: k for k, c in enumerate(sorted(set(label[core])), 1)}
        reach = np.where(core, 0.0 if least <= 1 else np.sort(d, 1)[:, max(least, 1) - 1], np.inf)
        by_id, by_reach = {}, {}
        for i in range(len(x)):
            others = np.flatnonzero(adjacent[i] & core)
            by_id[i] = order[label[i]] if core[i] else min((order[label[j]] for j in others), default=0)
            by_reach[i] = order[label[i]] if core[i] else min(((max(d[i, j], reach[j]), j, order[label[j]]) for j in others), default=(0, 0, 0))[2]
        series = packed(spark, x)
        assert {r["object_idx"]: r["cluster"] for r in cluster.dbscan(series, 1.5, least).collect()} == by_id
        assert {r["object_idx"]: r["cluster"] for r in cluster.optics(series, 1.5, least).collect()} == by_reach


def test_many_correlation_pvalues_are_those_of_one():
    from kairoscope.functions import tests_udf as U

    r = np.concatenate([np.linspace(-1, 1, 401), [1e-9, 0.999999999, 0.3, 0.3, np.nan]])
    for n in (3, 4, 7, 21, 60):
        want = [np.nan if x != x else 0.0 if abs(x) >= 1 else U.t_tail(abs(x) * np.sqrt((n - 2) / (1 - x * x)), n - 2) for x in r]
        got = U.pearson_pvalues(r, n)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-300, nan_ok=True) and got[-2] == got[-3]
    assert np.isnan(U.pearson_pvalues(r, 2)).all()


@pytest.mark.parametrize("method", ["fdr_bh", "holm", "bonferroni"])
def test_corrections_from_the_smallest_pvalues_alone(spark, method):
    from kairoscope.operators import stats

    frame = spark.createDataFrame([(float(i % 37 + 1) / 40,) for i in range(90)], "p double")
    want = {r["p"]: r["adj_p"] for r in stats.adjust(frame, "p", "adj_p", method).collect()}
    part = stats.adjust(frame.where("p <= 0.4"), "p", "adj_p", method, 90).collect()
    assert part and all(r["adj_p"] == want[r["p"]] for r in part)


def test_factors_meet_transcripts_in_blocks(spark, monkeypatch):
    from kairoscope.operators import motif

    monkeypatch.setattr(motif, "BLOCK", (3, 7, 2))
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(8, 6)), rng.normal(size=(30, 6))
    y[4] = 1.0
    factors = spark.createDataFrame([(f"F{i}", v.tolist()) for i, v in enumerate(x)], "sf string, x array<double>")
    transcripts = spark.createDataFrame([(f"G{i % 9}", f"T{i}", v.tolist()) for i, v in enumerate(y)], "gene_id string, transcript_id string, y array<double>")
    found, tests = motif.correlated(factors, transcripts, 6, 0.4)
    assert tests == 8 * 29
    got = {(r["sf"], r["transcript_id"]): r["corr"] for r in found.collect()}
    want = {(f"F{i}", f"T{j}"): r for i in range(8) for j in range(30) if j != 4 and abs(r := np.corrcoef(x[i], y[j])[0, 1]) >= 0.4}
    assert got == pytest.approx(want)


def test_steps_from_many_sources_in_blocks(spark, monkeypatch):
    from kairoscope.operators import graph, paths

    monkeypatch.setattr(paths, "NODES", 16)
    rng = np.random.default_rng(2)
    edges = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (60, 2)).tolist() if a != b})
    far = np.where(np.eye(70, dtype=bool), 0.0, np.inf)
    for a, b in edges:
        far[a, b] = far[b, a] = 1
    for k in range(70):
        far = np.minimum(far, far[:, [k]] + far[[k]])
    name = [f"n{i:02d}" for i in range(70)]
    net = spark.createDataFrame([(name[a], name[b]) for a, b in edges], "src string, dst string")
    sources = [*range(0, 60, 3), 65]  # the last is no node
    found = graph.distances(net, spark.createDataFrame([(name[i],) for i in sources] * 2, "source string"))
    assert "Join" not in plan(found).split("MapInArrow")[0]
    assert sorted(tuple(r) for r in found.collect()) == sorted((name[i], name[j], int(far[i, j])) for i in sources for j in range(70) if np.isfinite(far[i, j]))
    x = rng.normal(size=(40, 3))
    gene = [name[(2 * i) % 66] for i in range(40)]  # two objects may have one gene
    series = spark.createDataFrame([(i, gene[i], v.tolist()) for i, v in enumerate(x)], "object_idx long, gene_id string, vals array<double>")
    at = [int(g[1:]) for g in gene]
    top = max(far[i, j] for i in set(at) for j in range(70) if np.isfinite(far[i, j]))
    close = np.array([[(top - far[i, j]) / top if np.isfinite(far[i, j]) else 0.0 for j in at] for i in at])
    want = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + 1 - close) / 2
    got = {(r["i"], r["j"]): r["distance"] for r in cluster.composite_distance(series, net).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i in range(40) for j in range(i + 1, 40)})


def test_soft_warping_takes_exponentials_where_ways_are_near(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(9, 6)) * np.repeat([0.1, 3, 400], 3)[:, None], rng.normal(size=(12, 6)) * np.repeat([0.1, 3, 400], 4)[:, None]
    x[8], y[11] = y[3], np.nan
    want = np.empty((9, 12))
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            d = np.full((7, 7), np.inf)
            d[0, 0] = 0.0
            for p in range(6):
                for q in range(6):
                    ways = np.array([d[p, q], d[p, q + 1], d[p + 1, q]])
                    d[p + 1, q + 1] = (a[p] - b[q]) ** 2 + ways.min() - np.log(np.exp(ways.min() - ways).sum())
            want[i, j] = d[6, 6]
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda v: taken.append(np.size(v)) or exp(v))
    assert cluster.soft_dtw_block(x, y) == pytest.approx(want, rel=1e-14, nan_ok=True)
    taken.clear()
    cluster.soft_dtw_block(x[6:8], y[8:11])
    assert sum(taken) < 2 * 3 * 36


def test_segments_of_all_points_at_once(spark):
    """Against each point alone; values tie, a gene has nothing at times, and one pair has no point."""
    from kairoscope.functions import tests_udf as U
    from kairoscope.operators import switch

    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        a, b, top = rng.integers(0, 6, (3, 21)) / 4.0
        at = sorted(rng.choice(np.arange(1, 7), k % 6, replace=False).tolist())
        if k == 7:
            a = rng.random(21)
        rows.append((k, a.tolist(), b.tolist(), top.tolist(), at))
    pair = spark.createDataFrame(rows, "k long, a array<double>, b array<double>, top array<double>, points array<int>")
    both = switch.with_segments(pair, 3, 7, True)
    assert "ArrowEvalPython" in plan(both)
    got = {r["k"]: [s.asDict() for s in r["segs"]] for r in both.collect()}
    each = pair.join(spark.range(40).withColumnRenamed("id", "k"), "k").transform(lambda f: switch.with_segments(f, 3, 7)).selectExpr("k", "explode(segs)")
    assert each.count() == sum(len(r[-1]) for r in rows)  # what asks for points isn't pushed into the join
    assert [x.name for x in switch.with_segments(pair, 3, 7).schema["segs"].dataType.elementType] == ["sp", "importance", "diff", "prob_ab", "prob_ba"]
    for k, *arrays, at in rows:
        a, b, top = (np.array(v).reshape(3, 7) for v in arrays)
        ends = [0, *at, 7]
        assert [s["sp"] for s in got[k]] == at
        for s, i, j, m in zip(got[k], ends[:-2], ends[1:-1], ends[2:], strict=True):
            p, q, r, t = a[:, i:j].ravel(), a[:, j:m].ravel(), b[:, i:j].ravel(), b[:, j:m].ravel()
            near = top[:, j - 1 : j + 1]
            importance = None if (near == 0).any() else sum(((v[:, j - 1 : j + 1]) / near).sum() for v in (a, b)) / 12
            assert s["importance"] == (importance if importance is None else pytest.approx(importance, abs=2e-12))
            assert s["diff"] == pytest.approx((abs(p.mean() - q.mean()) + abs(r.mean() - t.mean())) / 2)
            assert (s["prob_ab"], s["prob_ba"]) == pytest.approx(((p > r).mean() + (q < t).mean(), (r > p).mean() + (t < q).mean()))
            assert (s["p1"], s["p2"]) == (round(U.mann_whitney(p, q), 12), round(U.mann_whitney(r, t), 12))


def test_permutations_of_all_pairs_at_once(spark):
    """Against each permutation of each pair alone, dissimilarities as well."""
    from kairoscope.operators import switch

    rng = np.random.default_rng(9)
    value = rng.integers(0, 5, (2, 4, 6)).astype(float)
    value[0, 3] = 2.0  # its dissimilarities can't be told
    rows = [(f"g{g}", f"g{g}.t{t}", 0, p, float(value[g, t, p])) for g in range(2) for t in range(4) for p in range(6)]
    found = switch.permutation_switch_p(spark.createDataFrame(rows, "gene_id string, transcript_id string, rep int, tp int, value double"), 6, 30)
    assert "ArrowEvalPython" in plan(found)
    share = value / np.where(value.sum(1, keepdims=True) > 0, value.sum(1, keepdims=True), 1)

    def longest(s):
        ends = [0, *(t for t in range(1, 6) if s[t] != s[t - 1]), 6]
        return max(np.diff(ends))

    for r in found.collect():
        g, i, j = int(r["gene_id"][1:]), int(r["tx1"][-1]), int(r["tx2"][-1])
        sign, apart = np.sign(share[g, i] - share[g, j]), lambda o: round((1 - np.corrcoef(value[g, i, o], value[g, j, o])[0, 1]) / 2, 9)
        orders = switch.permutation_orders(6, 30)
        p = [(1 + sum(longest(sign[o]) >= longest(sign) for o in orders)) / 31]
        if value[g, i].std() and value[g, j].std():
            p.append((1 + sum(apart(o) >= apart(list(range(6))) for o in orders)) / 31)
        assert r["p"] == pytest.approx(p[0] if len(p) == 1 else p[0] * p[1] * (1 - np.log(p[0] * p[1])))


def test_points_are_taken_once(spark):
    """Against the arrays of each replicate; a filter on them is not pushed into the join of pairs."""
    from kairoscope.operators import switch

    rng = np.random.default_rng(12)
    for reps in (1, 2, 3, 5):
        rows = [("g", f"t{k}", v.tolist(), v.tolist(), [1.0] * (4 * reps)) for k, v in enumerate(rng.integers(0, 3, (9, 4 * reps)) / 2.0)]
        pair = switch.pairs(spark.createDataFrame(rows, "gene_id string, transcript_id string, abundance array<double>, raw array<double>, top array<double>"))
        found = switch.with_points(pair, reps, 4).withColumn("found", switch.points_by_replicate(reps, 4))
        for r in found.collect():
            sets = [set(f) for f in r["found"]]
            two = [sets[i] & sets[j] for j in range(1, reps - switch.agreement(reps) + 2) for i in range(j)] if switch.agreement(reps) > 1 else []
            assert r["points"] == sorted(set.intersection(*sets) or set().union(*two))
        kept = switch.with_points(pair, reps, 4).where("size(points) > 0")
        assert kept.count() == sum(len(r["points"]) > 0 for r in found.collect())
        assert "signum" not in plan(kept).lower() and "ArrowEvalPython" in plan(kept)


@pytest.mark.parametrize("name", ["clara", "kmedoids"])
def test_medoids_read_their_series_once(spark, name):
    series = spark.range(300).selectExpr("id AS object_idx", "array(double(id % 7), double(id % 11), double(id)) AS vals")
    found = cluster.find_clusters(series, name, 3)
    assert "Range" not in plan(found)
    assert {r["cluster"] for r in found.collect()} == {1, 2, 3}


def test_nearest_clusters_by_a_product_are_exact():
    """Copies lie at 0, far from the origin, and ties go to the first place."""
    from kairoscope.operators import linkage

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (90, 3)) * 0.1 + 5000
    for n in (np.ones(90), rng.integers(1, 5, 90).astype(float)):
        want = linkage._costs(n, x, n[20:], x[20:])
        best, place = linkage._nearest(n, x, n[20:], x[20:])
        assert (place == want.argmin(1)).all() and (best == want.min(1)).all()
        want = linkage._costs(n, x, n, x)
        np.fill_diagonal(want, np.inf)
        best, place = linkage._nearest(n, x, n, x, np.arange(90))
        assert (place == want.argmin(1)).all() and (best == want.min(1)).all()
    assert np.isinf(linkage._nearest(n[:1], x[:1], n[:1], x[:1], np.arange(1))[0]).all()


def test_distance_sums_by_a_product(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8)) + 1000
    x[30:40] = x[:10]
    x[41] = x[42] + 1e-7
    label = rng.integers(0, 4, 60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert cluster.far_distances(x, x) == pytest.approx(d, abs=1e-9) and (cluster.far_distances(x[30:40], x[:10]).diagonal() == 0).all()
    monkeypatch.setattr(cluster, "BLOCK", (16, 16, 16))
    monkeypatch.setattr(cluster, "STRIP", 7)
    series = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(60)], "object_idx long, cluster int, vals array<double>")
    got = {(r["object_idx"], r["c"]): (r["total"], r["n"]) for r in cluster.distance_sums(series).collect()}
    want = {(i, c): (d[i, label == c].sum(), int((label == c).sum() - (label[i] == c))) for i in range(60) for c in range(4)}
    assert got.keys() == {k for k, v in want.items() if v[1]}
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-8) for k in got)


def test_factors_and_transcripts_are_counted_in_blocks(spark, monkeypatch):
    """Against the table of pairs, which isn't made; some genes are larger than a block, one correlation is at the cutoff, and a gene has no cluster."""
    from kairoscope.operators import motif

    rng = np.random.default_rng(14)
    rows = []
    for g in range(12):
        for t in range(1 if g == 3 else 2 + g):
            v = rng.integers(0, 6, (2, 4)) + (0 if g != 5 else 3 * np.arange(4))
            rows += [(f"g{g:02d}", f"g{g:02d}.t{t}", r, p, float(v[r, p])) for r in range(2) for p in range(4)]
    expr = spark.createDataFrame(rows, "gene_id string, transcript_id string, rep int, tp int, value double")
    factors = spark.createDataFrame([(f"g{g:02d}",) for g in range(0, 12, 2)], "gene_id string")
    clusters = spark.createDataFrame([(f"g{g:02d}", c) for g in range(11) for c in {g % 3, 2}] + [("g10", None)], "gene_id string, cluster int")
    found = motif.factor_coexpression(expr, factors, 2, 4, None, "fdr_bh", 0.3, 1.0).cache()
    cut = min(abs(r["corr"]) for r in found.collect())
    monkeypatch.setattr(motif, "BLOCK", (3, 6, 2))
    monkeypatch.setattr(motif, "TALLY", (3, 12, 4))
    monkeypatch.setattr(motif, "TILE", (2, 4))
    kept = found.where(f"abs(corr) > {cut!r}D")
    assert kept.count() < found.count()
    sets = {(r["cluster"], r["direction"]): r["sfs"] for r in motif.factor_sets(kept, clusters).collect()}
    even = {tuple(r) for r in motif.balanced(kept).collect()}
    with monkeypatch.context() as m:
        m.setattr(motif, "correlated", lambda *_: pytest.fail("all pairs"))
        got = motif.coexpression_sets(expr, factors, clusters, 2, 4, None, "fdr_bh", cut, 1.0)
        assert {(r["cluster"], r["direction"]): r["sfs"] for r in got.collect()} == sets and len(sets) > 4
        pairs = motif.coexpression_balanced(expr, factors, 2, 4, None, "fdr_bh", cut, 1.0).collect()
        assert {tuple(r) for r in pairs} == even and len(pairs) == len(even) > 4
    # Where a correction may leave pairs out, they are tested.
    found = motif.factor_coexpression(expr, factors, 2, 4, None, "bonferroni", 0.3, 0.9)
    assert {tuple(r) for r in motif.coexpression_balanced(expr, factors, 2, 4, None, "bonferroni", 0.3, 0.9).collect()} == {tuple(r) for r in motif.balanced(found).collect()}


def test_rounds_of_communities_read_links_once(spark, monkeypatch):
    """What a round finds is kept before moves are judged, and its number is in no plan that reads the links."""
    from kairoscope.operators import communities

    seen, cut = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda f, forget=False: seen.append(plan(f)) or cut(f, forget))
    edges = [(f"n{4 * g + i}", f"n{4 * g + j}") for g in range(3) for i in range(4) for j in range(i)] + [("n0", "n4"), ("n4", "n8")]
    found = communities.communities(spark.createDataFrame(edges, "src string, dst string"), 1.0)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(f"n{4 * g + i}" for i in range(4)) for g in range(3))
    numbered = [p for p in seen if "Join" in p and "xxhash64" in p]
    assert numbered and not any("ExistingRDD" in p for p in numbered)


def test_bits_of_steps_move_once(spark, monkeypatch):
    """Frontiers and levels aren't dealt again behind the join that they are dealt for."""
    from kairoscope.operators import blocks, paths

    monkeypatch.setattr(paths, "NODES", 16)
    monkeypatch.setattr(blocks, "spread", lambda *_: pytest.fail("rows with bits move again"))
    ring = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(39)], "src string, dst string")
    series = spark.createDataFrame([(i, f"n{i:02d}", [0.0]) for i in range(40)], "object_idx long, gene_id string, vals array<double>")
    found = cluster.composite_distance(series, ring)
    assert {(r["i"], r["j"]): r["distance"] for r in found.collect()} == pytest.approx({(i, j): (1 - (39 - j + i) / 39) / 2 for i in range(40) for j in range(i + 1, 40)})


def test_blocks_of_one_component_are_not_compared_pair_by_pair(spark, monkeypatch):
    """What moves grows with the blocks, not with their square; one object, which no block begins with, links two clouds."""
    from kairoscope.operators import blocks, density

    moved, spread = [], blocks.spread
    monkeypatch.setattr(density, "BLOCK", 16)
    monkeypatch.setattr(density, "FIRST", 1)
    monkeypatch.setattr(blocks, "spread", lambda frame, rows: moved.append(rows) or spread(frame, rows))
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.uniform(0, 0.9, 100), rng.uniform(2.5, 3.4, 50), [9.0, 9.1, 9.2, 1.7, 10.15, 30.0]])
    found = {r["object_idx"]: r["cluster"] for r in cluster.optics(packed(spark, np.stack((x, x * 0), 1)), 1.0, 4).collect()}
    want = np.where(x < 5, 1, np.where(x < 20, 2, 0))
    assert found == dict(enumerate(want.tolist()))
    assert 20 < sum(moved) < 300  # about 20 blocks; each with each would be 400 and half as many again


def test_gene_sums_make_no_row_of_a_transcript(spark, tmp_path):
    """Against the SQL; what was measured in no time point of the series or on no line of it counts nowhere."""
    import duckdb

    from kairoscope.plans import cluster_queries
    from kairoscope.sources import tables as T

    lines = [(s, p, n, f"{1993 + (s + p + 2 * n) % 11}-05-01", float(1 + (s * p + n) % 50)) for s in range(4) for p in range(9) for n in range(8)] + [(9, 1, 1, "1994-05-01", 3.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_linenumber int, l_shipdate string, l_quantity double").selectExpr("*", "to_timestamp(l_shipdate) AS d").drop("l_shipdate").withColumnRenamed("d", "l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        each = set(con.execute(T.with_views("expr", "SELECT gene_id, transcript_id, rep, tp, value FROM expr")).fetchall())
        want = set(con.execute(T.with_views("expr", "SELECT gene_id, rep, tp, sum(value) FROM expr GROUP BY ALL")).fetchall())
    assert len(want) == 5 * 21 and {tuple(r) for r in T.gene_expression(spark, str(tmp_path)).select("gene_id", "rep", "tp", "value").collect()} == want
    assert {tuple(r) for r in T.expression(spark, str(tmp_path)).select("gene_id", "transcript_id", "rep", "tp", "value").collect()} == each
    assert "l_partkey" not in plan(cluster_queries._genes(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("method", ["fdr_bh", "holm", "bonferroni"])
def test_corrected_correlations_are_no_rows_before_they_leave(spark, monkeypatch, method):
    """Few cells and values, so that bounds narrow over passes; half the series come again, so that many correlations are equal."""
    from kairoscope.operators import motif, stats, steps

    for name, value in (("CELLS", 64), ("LIMIT", 120), ("CHUNK", 16)):
        monkeypatch.setattr(steps, name, value)
    for name, value in (("BLOCK", (3, 7, 2)), ("PASS", (8, 64, 2, 4, 5))):
        monkeypatch.setattr(motif, name, value)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(9, 7)), rng.normal(size=(80, 7))
    x[5:], y[40:], y[11] = x[:4], y[:40], 2.0
    factors = spark.createDataFrame([(f"F{i}", v.tolist()) for i, v in enumerate(x)], "sf string, x array<double>")
    transcripts = spark.createDataFrame([(f"G{i % 9}", f"T{i}", v.tolist()) for i, v in enumerate(y)], "gene_id string, transcript_id string, y array<double>")
    found, tests = motif.correlated(factors, transcripts, 7, 0.3)
    for cutoff in (1.0, 0.31):
        want = {tuple(r) for r in stats.adjust(found, "p_value", "adj_p", method, tests).where(f"abs(corr) > 0.3 AND adj_p < {cutoff}").selectExpr("sf", "transcript_id", "corr", "round(p_value, 11)", "round(adj_p, 3)").collect()}
        with monkeypatch.context() as m:
            m.setattr(stats, "adjust", lambda *_: pytest.fail("all pairs"))
            got = motif.corrected(factors, transcripts, 7, method, 0.3, cutoff, 3)
        assert "Exchange" not in plan(got) and "Join" not in plan(got)
        rows = {tuple(r) for r in got.selectExpr("sf", "transcript_id", "corr", "round(p_value, 11)", "round(adj_p, 3)").collect()}
        assert rows == want and len(rows) > (300 if cutoff == 1.0 and method == "fdr_bh" else 0)


def test_tabled_correlation_pvalues_are_those_of_one():
    from kairoscope.functions import tests_udf as U

    r = np.concatenate([np.linspace(0.3, 0.9, 777), [-0.31, 0.95, -1.0, np.nan]])
    for n in (3, 4, 7, 21, 60):
        assert U.pearson_table(n, 0.3)(r) == pytest.approx(U.pearson_pvalues(r, n), rel=1e-12, abs=1e-300, nan_ok=True)


def test_blocks_of_all_pairs_move_once_to_each_pair(spark, monkeypatch):
    """What moves is the same few blocks however many objects there are, and a strip holds so many distances however large a block is."""
    from kairoscope.operators import blocks

    monkeypatch.setattr(blocks, "spread", lambda *_: pytest.fail("pairs of blocks move again"))
    for name, value in (("SIZE", (2, 4096)), ("PARTS", 3), ("PAIRS", 20)):
        monkeypatch.setattr(blocks, name, value)
    x, sizes, packs, seen = np.random.default_rng(4).normal(size=(60, 2)), [], blocks.packs, []
    monkeypatch.setattr(blocks, "packs", lambda series, count: sizes.append(count) or packs(series, count))
    for n in (12, 60):
        seen.append({(r["i"], r["j"]): r["distance"] for r in cluster.pair_distances(packed(spark, x[:n])).collect()})
    assert sizes == [3, 3]
    want = cluster.block_distances(x, x, "euclidean")
    assert seen[1] == pytest.approx({(i, j): want[i, j] for i in range(60) for j in range(i + 1, 60)}) and len(seen[0]) == 66


def test_bits_of_a_task_are_bounded_however_many_nodes(spark, monkeypatch):
    """With more blocks of nodes a block has fewer sources, so what a task joins doesn't grow; distances are as before."""
    from kairoscope.operators import graph, paths

    monkeypatch.setattr(paths, "NODES", 16)
    monkeypatch.setattr(paths, "JOINED", 100)
    ring = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(69)], "src string, dst string")
    found = paths.levels(graph.both_ways(ring), spark.createDataFrame([(f"n{i:02d}",) for i in range(70)], "node string"), 3)
    kinds = found.nodes.select("k").distinct().count()
    assert kinds >= 5 and kinds * 16 * found.width <= max(100, kinds * 16)
    assert {(r["source"], r["node"], r["distance"]) for r in paths.rows(found).collect()} == {(f"n{i:02d}", f"n{j:02d}", abs(i - j)) for i in range(70) for j in range(70) if abs(i - j) <= 3}


def test_rounds_of_nearest_clusters_take_few_tasks(spark, monkeypatch):
    """The driver keeps track of each task of a round: as many for 320 clusters as for 3,200."""
    from kairoscope.operators import linkage

    dealt, spread = [], linkage.spread
    monkeypatch.setattr(linkage, "spread", lambda frame, rows: dealt.append(rows) or spread(frame, rows))
    x = np.random.default_rng(9).normal(size=(320, 2))
    clusters = spark.createDataFrame([(i, 1.0, v.tolist()) for i, v in enumerate(x)], "c long, n double, total array<double>")
    got = {(r["i"], r["j"]) for r in linkage.nearest_by_blocks(clusters, 320, 4).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(320, np.inf))
    assert got == {(min(i, j), max(i, j)) for i, j in enumerate(d.argmin(1).tolist())}
    assert dealt == [256]
