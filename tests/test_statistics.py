"""Answers worked out by hand, and properties."""

import functools
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.functions import prize_trees, score_udf
from kairoscope.functions import tests_udf as U
from kairoscope.operators import cluster, density, graph, medoids, modules, motif, pathways, prep, stats, switch
from kairoscope.operators import linkage as tree
from kairoscope.operators.communities import communities
from kairoscope.session import cut
from kairoscope.sources import readers


def adjusted(spark, values, method):
    rows = stats.adjust(spark.createDataFrame([(i, p) for i, p in enumerate(values)], "i int, p double"), "p", "a", method).orderBy("i").collect()
    return [r["a"] for r in rows]


@pytest.mark.parametrize(("method", "want"), [("fdr_bh", [0.01, 0.015, 0.015, 0.125]), ("fdr_bh_standard", [0.04, 0.04, 0.04, 0.5]), ("bonferroni", [0.04, 0.08, 0.12, 1.0]), ("holm", [0.04, 0.06, 0.06, 0.5])])
def test_corrections(spark, method, want):
    assert adjusted(spark, [0.01, 0.02, 0.03, 0.5], method) == pytest.approx(want)


def test_corrections_keep_nulls_and_zero(spark):
    got = adjusted(spark, [None, 0.0, 1.0, 0.5], "holm")
    assert got[0] is None and got[1:] == pytest.approx([0.0, 1.0, 1.0])


def test_fisher(spark):
    row = spark.range(1).select(stats.fisher_pair(F.lit(0.03), F.lit(0.2)).alias("x"), stats.fisher_tail(F.lit(-math.log(0.03 * 0.2)), F.lit(2)).alias("y")).first()
    assert row["x"] == pytest.approx(0.0366959748585) and row["y"] == pytest.approx(0.0366959748585)


def test_hypergeometric(spark):
    cases = [(10, 4, 5, k) for k in range(6)]
    f = spark.createDataFrame(cases, "t int, m int, n int, k int")
    got = [r[0] for r in f.orderBy("k").select(stats.hypergeometric_tail(*map(F.col, "tmnk"))).collect()]
    share = lambda x: math.comb(4, x) * math.comb(6, 5 - x) / math.comb(10, 5) if x <= 4 else 0
    assert got == pytest.approx([sum(share(x) for x in range(k, 6)) for k in range(6)])


def test_agreement():
    assert [switch.agreement(r) for r in range(2, 8)] == [1, 2, 2, 3, 4, 4]


def test_mann_whitney():
    # 3 against 3 distinct values, all apart: 1 of 20 orders on each side.
    assert U.mann_whitney(np.array([1.0, 2, 3]), np.array([4.0, 5, 6])) == pytest.approx(0.1)
    assert U.mann_whitney(np.array([4.0, 5, 6]), np.array([1.0, 2, 3]), "greater") == pytest.approx(0.05)
    assert U.mann_whitney(np.array([1.0, 1]), np.array([1.0, 1])) == 1.0
    assert U.mann_whitney(np.array([]), np.array([1.0])) == 1.0
    # With ties: U = 8, mean 4.5, variance 9 / 12 * (7 - 6 / 30).
    p = math.erfc((8.5 - 4.5 - 0.5) / math.sqrt(9 / 12 * (7 - 6 / 30)) / math.sqrt(2))
    assert U.mann_whitney(np.array([3.0, 4, 5]), np.array([1.0, 2, 3])) == pytest.approx(p)


def test_t_tail():
    # One degree of freedom is the Cauchy distribution: P(|T| > 1) = 1/2; two: t / sqrt(2 + t^2).
    assert U.t_tail(1.0, 1) == pytest.approx(0.5)
    assert U.t_tail(1.0, 2) == pytest.approx(1 - 1 / math.sqrt(3))
    assert U.t_quantile(0.975, 1) == pytest.approx(12.7062047, rel=1e-6)


def test_snap_takes_the_first_of_equal(spark):
    row = spark.range(1).select(prep.snap(F.lit(0.5), F.array(F.lit(0.0), F.lit(1.0))).alias("x")).first()
    assert row["x"] == 0.0


def expression(spark, table):
    rows = [(g, t, r, i, float(v)) for (g, t), reps in table.items() for r, series in enumerate(reps) for i, v in enumerate(series)]
    return spark.createDataFrame(rows, "gene_id string, transcript_id string, rep int, tp int, value double")


def test_switch_of_two_series(spark):
    up, down = [1, 1, 1, 9, 9, 9], [9, 9, 9, 1, 1, 1]
    e = expression(spark, {("g", "a"): [up, up, up], ("g", "b"): [down, down, down]})
    rows = switch.candidates(e, 3, 6).orderBy("switch_prob").collect()
    assert len(rows) == 2 and {tuple(r["all_switch_points"]) for r in rows} == {(3,)}
    best = rows[-1]
    assert (best["major_transcript"], best["minor_transcript"], best["best_switch_point"]) == ("b", "a", 3)
    assert best["corr"] == pytest.approx(1.0) and best["diff"] == pytest.approx(0.8) and best["switch_prob"] == pytest.approx(1.0)
    assert best["event_importance"] == pytest.approx((1 / 9 + 1 + 1 + 1 / 9) / 4)
    found = switch.detect_switches(e, 3, 6, p_val_cutoff=0.5).collect()
    assert [(r["major_transcript"], r["minor_transcript"]) for r in found] == [("b", "a")]


def test_constant_series_have_no_dissimilarity(spark):
    e = expression(spark, {("g", "a"): [[1, 1, 1]] * 2, ("g", "b"): [[1, 2, 3]] * 2})
    pair = switch.pairs(switch.packed(e, 3)).select(switch.dissimilarity(2, 3).alias("c")).first()
    assert pair["c"] is None


def test_empty_gene_counts_as_full_or_none(spark):
    e = expression(spark, {("g", "a"): [[0, 1]], ("g", "b"): [[0, 3]]})
    full = {(r["transcript_id"], r["tp"]): r["abundance"] for r in prep.relative_abundance(e).collect()}
    none = {(r["transcript_id"], r["tp"]): r["abundance"] for r in prep.relative_abundance(e, 0.0).collect()}
    assert full[("a", 0)] == 1.0 and none[("a", 0)] == 0.0 and full[("b", 1)] == 0.75


def test_wide_needs_all_columns(spark):
    wide = spark.createDataFrame([("g", 1.0, 2.0)], "gene_id string, v0 double, v1 double")
    with pytest.raises(ValueError):
        readers.wide_to_long(wide, ["v0", "v1"], 2, 2)
    assert readers.wide_to_long(wide, ["v0", "v1"], 1, 2).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# net\nb a 0.5\na a 1\na b 0.7\nc\td 2\n")
    e = readers.read_edge_list(spark, str(tmp_path / "edges.txt"), {"weight": "double"})
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [("a", "b"), ("c", "d")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "X.SF1.motif.mat.txt").write_text("AC M1\nID SF1.1\nP0 A C G T\n01 1 2 3 4\n02 4 3 2 1\nXX\n//\n")
    (tmp_path / "m" / "X.SF2.empty.mat.txt").write_text("AC M2\nID SF2.1\n//\n")
    rows = readers.read_motifs(spark, str(tmp_path / "m")).orderBy("pos").collect()
    assert [(r["sf"], r["motif_id"], r["pos"], r["t"]) for r in rows] == [("SF1", "SF1.1", 0, 4.0), ("SF1", "SF1.1", 1, 1.0)]


def agglomerate(distance, k, linkage):
    """Labels 1..k by nearest pairs and the updates of Lance and Williams; complete, single, average and ward."""
    n, heights = len(distance), []
    d = distance.astype(float).copy()
    d = d * d if linkage == "ward" else d
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - min(k, n)):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        heights.append(d[i, j] ** (0.5 if linkage == "ward" else 1))
        a, b = d[i].copy(), d[j].copy()
        if linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            new = ((size[i] + size) * a + (size[j] + size) * b - size * d[i, j]) / (size[i] + size[j] + size)
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1] + 1, heights


@pytest.mark.parametrize("linkage, given", [("single", True), ("complete", True), ("average", True), ("ward", True), ("ward", False)])
def test_hierarchical_clusters_are_those_of_one_pair_at_a_time(spark, linkage, given):
    series = packed_series(spark, 40, seed=7)
    x = np.array([r["vals"] for r in series.orderBy("object_idx").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = cluster.pair_distances(series) if given else None
    merges = cut(tree.dendrogram(series, linkage, pairs, finish=12, block=16), forget=True)
    labels, heights = agglomerate(d, 1, linkage)
    assert sorted(r["height"] for r in merges.collect()) == pytest.approx(sorted(heights))
    assert len({r["b"] for r in merges.collect()}) == 39 and all(r["a"] < r["b"] for r in merges.collect())
    for k in (5, 1):
        assert labels_and_values(tree.cut_tree(series, merges, k)).tolist() == agglomerate(d, k, linkage)[0].tolist()


def test_hierarchical_clusters_of_ties_and_few_objects(spark):
    same = spark.createDataFrame([(i, [float(i // 6), 0.0]) for i in range(18)], "object_idx long, vals array<double>")
    for linkage in ("ward", "average"):
        merges = tree.dendrogram(same, linkage, None if linkage == "ward" else cluster.pair_distances(same), finish=4, block=8)
        assert labels_and_values(tree.cut_tree(same, merges, 3)).tolist() == [1] * 6 + [2] * 6 + [3] * 6
    one = same.limit(1)
    assert labels_and_values(cluster.hierarchical(one, 3, "complete")).tolist() == [1] and cluster.hierarchical(same.where("false"), 2, "ward").count() == 0


def test_medoids_of_a_line():
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    d = np.abs(x[:, None] - x[None])
    assert set(cluster.swap_medoids(d, 3)) <= {1, 3, 4, 5} and len(cluster.swap_medoids(d, 3)) == 3


def test_dbscan(spark):
    rows = [(i, [float(v)]) for i, v in enumerate([0, 0.1, 0.2, 5, 5.1, 5.2, 20])]
    s = spark.createDataFrame(rows, "object_idx long, vals array<double>")
    got = {r[0]: r[1] for r in cluster.dbscan(s, 0.15, 2).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 0}


def ring_of_cliques(n=4, size=6):
    edges = [(f"c{c}n{i}", f"c{c}n{j}") for c in range(n) for i in range(size) for j in range(i + 1, size)]
    return edges + [(f"c{c}n0", f"c{(c + 1) % n}n1") for c in range(n)]


def serial_communities(edges, resolution):
    """Node by node, in order of their names."""
    weights: dict = defaultdict(lambda: defaultdict(float))
    for a, b in edges:
        weights[a][b] += 1.0
        weights[b][a] += 1.0
    total = 2.0 * len(edges)
    gamma = 1.0 / resolution
    group = {n: n for n in weights}
    while True:
        strength = {n: sum(w.values()) for n, w in weights.items()}
        place, volume = {n: n for n in weights}, dict(strength)
        moved, moved_any = True, False
        while moved:
            moved = False
            for n in sorted(weights):
                own = place[n]
                to: dict = defaultdict(float)
                for m, w in weights[n].items():
                    if m != n:
                        to[place[m]] += w
                volume[own] -= strength[n]
                best, gain = own, to[own] - gamma * strength[n] * volume[own] / total
                for c in sorted(to):
                    g = to[c] - gamma * strength[n] * volume[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                volume[best] += strength[n]
                if best != own:
                    place[n], moved, moved_any = best, True, True
        group = {n: place[c] for n, c in group.items()}
        if not moved_any:
            break
        merged: dict = defaultdict(lambda: defaultdict(float))
        for a, row in weights.items():
            for b, w in row.items():
                merged[place[a]][place[b]] += w
        weights = merged
    names = {c: i for i, c in enumerate(sorted(set(group.values())))}
    return {n: names[c] for n, c in group.items()}


def modularity_of(edges, place, gamma):
    degree, volume, inside = defaultdict(int), defaultdict(int), 0
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
        inside += place[a] == place[b]
    for n, d in degree.items():
        volume[place[n]] += d
    return inside / len(edges) - gamma * sum(v * v for v in volume.values()) / (2 * len(edges)) ** 2


def test_communities_are_as_good_as_the_serial_ones(spark):
    rng = np.random.default_rng(2)
    edges = sorted({tuple(sorted((f"n{a:02d}", f"n{b:02d}"))) for a, b in rng.integers(0, 40, (260, 2)) if a != b and (a % 4 == b % 4 or rng.random() < 0.15)})
    table = spark.createDataFrame(edges, "src string, dst string")
    found = {r["node"]: r["community"] for r in communities(table, 1.0).collect()}
    assert modularity_of(edges, found, 1.0) >= 0.98 * modularity_of(edges, serial_communities(edges, 1.0), 1.0)
    assert communities(table.where("false")).count() == 0


def test_prize_tree_takes_what_pays():
    nodes = {"a": 1.0, "b": 0.0, "c": 1.0, "d": 0.1, "e": 1.0}
    edges = [("a", "b", 0.4), ("b", "c", 0.4), ("c", "d", 0.5), ("d", "e", 0.9)]
    assert modules.prize_tree(nodes, edges) == {"a", "b", "c"}
    assert modules.prize_tree({"a": 1.0, "b": 1.0}, [("a", "b", 0.0)]) == {"a", "b"}


def stepwise_tree(nodes, edges):
    """Moats step by step: every open edge and component is looked at for each event."""
    part, left, grown, forest = {n: n for n in nodes}, dict(nodes), dict.fromkeys(nodes, 0.0), []
    active = {n: p > 0 for n, p in nodes.items()}
    while any(active.values()):
        open_edges = [e for e in edges if part[e[0]] != part[e[1]] and active[part[e[0]]] + active[part[e[1]]]]
        waits = [(max(0.0, (c - grown[a] - grown[b]) / (active[part[a]] + active[part[b]])), 0, k) for k, (a, b, c) in enumerate(open_edges)]
        step, kind, which = min(waits + [(left[c], 1, c) for c in sorted(active) if active[c]])
        for n in nodes:
            grown[n] += step * active[part[n]]
        for c in active:
            left[c] -= step * active[c]
        if kind:
            active[which] = False
            continue
        forest.append(open_edges[which])
        keep, gone = (part[x] for x in open_edges[which][:2])
        part = {n: keep if p == gone else p for n, p in part.items()}
        left[keep] += left.pop(gone)
        active.pop(gone)
        active[keep] = left[keep] > 1e-12
    names = sorted(nodes)
    found = prize_trees.pruned([nodes[n] for n in names], [(names.index(a), names.index(b), c) for a, b, c in forest])
    return {names[k] for k in found}


def random_prizes(seed, most):
    r = random.Random(seed)
    names = [f"n{k:02}" for k in range(r.randint(2, most))]
    nodes = {n: r.random() * r.choice([0.3, 1, 2]) if r.random() < 0.5 else 0.0 for n in names}
    return nodes, [(a, b, r.random()) for a, b in itertools.combinations(names, 2) if r.random() < r.choice([0.1, 0.3, 0.6])]


def test_prize_trees_are_those_of_one_event_at_a_time():
    for seed in range(200):
        nodes, edges = random_prizes(seed, 30)
        assert modules.prize_tree(nodes, edges) == stepwise_tree(nodes, edges), seed


def test_prize_trees_cost_at_most_twice_the_least():
    def cost(inside, nodes, edges):
        part, total, joins = {n: n for n in inside}, 0.0, 0
        for a, b, c in sorted(edges, key=lambda e: e[2]):
            if a in part and b in part and part[a] != part[b]:
                part, total, joins = {n: part[a] if p == part[b] else p for n, p in part.items()}, total + c, joins + 1
        return total + sum(p for n, p in nodes.items() if n not in inside) if joins >= len(inside) - 1 else math.inf

    for seed in range(15):
        nodes, edges = random_prizes(1000 + seed, 10)
        least = min(cost(set(w), nodes, edges) for k in range(len(nodes) + 1) for w in itertools.combinations(nodes, k))
        got = cost(modules.prize_tree(nodes, edges), nodes, edges)
        assert least - 1e-9 <= got <= 2 * least + 1e-9


def test_split_counts_paths_anew_where_an_edge_went():
    edges = sorted({(min(a, b), max(a, b)) for a, b in ring_of_cliques(4, 6)})
    nodes = {n for e in edges for n in e}

    def cut_once_more(left):  # the busiest edges of the whole network go until it has one more part
        before = parts_of(left)
        while len(parts_of(left)) == len(before):
            adjacent = {n: [b if a == n else a for a, b in left if n in (a, b)] for n in nodes}
            flow = modules.betweenness(adjacent)
            left.remove(max(flow, key=lambda e: (round(flow[e], 6), e)))
        return parts_of(left)

    def parts_of(left):
        part = {n: n for n in nodes}
        for a, b in left:
            part = {n: part[a] if p == part[b] else p for n, p in part.items()}
        return {frozenset(n for n in nodes if part[n] == p) for p in set(part.values())}

    left, want = list(edges), None
    for _ in range(3):
        want = cut_once_more(left)
    assert {frozenset(p) for p in modules.split_module(nodes, edges, 60, most=10)} == want


def test_betweenness_of_a_bridge():
    adjacent = {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b", "d"], "d": ["c", "e", "f"], "e": ["d", "f"], "f": ["d", "e"]}
    flow = modules.betweenness(adjacent)
    assert max(flow, key=flow.get) == ("c", "d")


def test_modules_find_the_active_clique(spark):
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in ring_of_cliques(6, 12)], "src string, dst string").distinct()
    active = spark.createDataFrame([(f"c2n{i}",) for i in range(10)], "node string")
    rows = modules.find_modules(edges, active, parts=modules.slices(edges, 1.0)).collect()
    assert {r["node"] for r in rows} >= {f"c2n{i}" for i in range(10)} and all(r["node"].startswith("c2") for r in rows)
    assert all(r["p"] <= 0.05 for r in rows)


def test_components_and_distances(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")] + [(f"x{i:03d}", f"x{i + 1:03d}") for i in range(60)], "src string, dst string")
    got = {r[0]: r[1] for r in graph.connected_components(edges).collect()}
    assert got["c"] == "a" and got["e"] == "d" and {got[f"x{i:03d}"] for i in range(61)} == {"x000"}
    far = {r["node"]: r["distance"] for r in graph.distances(edges, spark.createDataFrame([("a",)], "source string")).collect()}
    assert far == {"a": 0, "b": 1, "c": 2}


def test_diffusion_threshold(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("c", "f")], "src string, dst string")
    got = {r["node"]: r["layer"] for r in graph.diffusion(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1}  # c has one active neighbour of four


def test_overlap_touches_across_cells(spark):
    exons = spark.createDataFrame([("g", "e1", 990, 1010), ("g", "e2", 5, 5), ("h", "e3", 0, 9)], "gene_id string, exon_id string, start long, end long")
    domains = spark.createDataFrame([("g", "d1", 1010, 3000), ("g", "d2", 5, 995), ("k", "d3", 0, 9)], "gene_id string, domain_id string, start long, end long")
    got = {(r["exon_id"], r["domain_id"]) for r in pathways.overlaps(exons, domains).collect()}
    assert got == {("e1", "d1"), ("e1", "d2"), ("e2", "d2")}


def test_motif_scores(spark):
    pwm = spark.createDataFrame([("s", "m", 0, 3.0, 1.0, 0.0, 0.0), ("s", "m", 1, 1.0, 1.0, 1.0, 1.0)], "sf string, motif_id string, pos int, a double, c double, g double, t double")
    seq = spark.createDataFrame([(1, "ACG", "lost")], "doc_id long, seq string, grp string")
    scores = motif.scan(seq, pwm, 0.5).first()["scores"]
    assert scores == pytest.approx([math.log2(0.75 / 0.25), math.log2(0.25 / 0.25)])


@pytest.mark.parametrize("width", [1, 3, 6])
def test_score_distribution_is_that_of_all_words(width):
    rng = np.random.default_rng(width)
    odds = rng.dirichlet(np.ones(4), width)
    odds[0, 2] = 0.0
    lowest, p = score_udf.score_distribution(odds, 0.3, 0.01)
    back, want = np.array([0.35, 0.15, 0.15, 0.35]), defaultdict(float)
    for word in itertools.product(range(4), repeat=width):
        if all(odds[k, c] > 0 for k, c in enumerate(word)):
            want[sum(int(np.rint(np.log2(odds[k, c] / back[c]) / 0.01)) for k, c in enumerate(word))] += float(np.prod(back[list(word)]))
    got = {lowest + k: x for k, x in enumerate(p) if x > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for rate in (0.0, 0.05, 0.5, 1.0):
        t, share = score_udf.score_limit(odds, 0.3, rate, 0.01)
        over = lambda x: sum(v for k, v in want.items() if k * 0.01 > x + 1e-9)
        assert share == pytest.approx(over(t)) and share <= rate + 1e-9
        assert not any(over(k * 0.01) <= rate - 1e-9 for k in want if k * 0.01 < t - 1e-9)


def test_motifs_are_tested_on_all_scores_over_their_threshold(spark):
    kind = "sf string, motif_id string, pos int, a double, c double, g double, t double"
    pwm = spark.createDataFrame([("s", "m", 0, 7.0, 1.0, 1.0, 1.0), ("s", "m", 1, 1.0, 2.0, 6.0, 1.0), ("s", "none", 0, 0.0, 0.0, 0.0, 0.0), ("s", "rare", 0, 1.0, 1.0, 1.0, 1.0)], kind)
    rng = np.random.default_rng(5)
    rows = [(k, "".join(rng.choice(list("ACGT"), 60, p=[0.4 - 0.1 * (k % 3), 0.2, 0.2 + 0.1 * (k % 3), 0.2])), ("lost", "gained", "background")[k % 3]) for k in range(30)] + [(99, "A", "lost"), (98, "", "lost")]
    seqs = spark.createDataFrame(rows, "doc_id long, seq string, grp string")
    limits = motif.thresholds(pwm, motif.background(seqs), 0.2, 1e-4)
    limit = {r["motif_id"]: r["threshold"] for r in limits.collect()}
    assert set(limit) == {"m", "rare"}
    scans = motif.scan(seqs, pwm, 0.5)
    scores = {g: [x for r in scans.where(f"motif_id = 'm' AND grp = '{g}'").collect() for x in r["scores"] if x > limit["m"]] for g in ("lost", "gained", "background")}
    got = {r["motif_id"]: r for r in motif.group_tests(scans, limits).collect()}
    for x, y in (("lost", "background"), ("gained", "background"), ("lost", "gained")):
        a, b = (np.round(scores[g], 9) for g in (x, y))
        assert len(a) and got["m"][f"{x}_vs_{y}"] == pytest.approx(U.mann_whitney(a, b, "greater"))
    table = {r["grp"]: r for r in motif.group_table(scans.where("motif_id = 'm'"), limits).collect()}
    assert {g: table[g]["n_hits"] for g in scores} == {g: len(x) for g, x in scores.items()}
    assert motif.thresholds(pwm, motif.background(seqs.limit(0)), 0.2).count() == 0


def test_junctions(spark):
    e = spark.createDataFrame([(True, "g", "0.1;x", "0.99;0.2", "10-20;10-30", 1)], "es boolean, gene_id string, delta string, prob string, coords string, event_id long")
    assert {(r["source"], r["target"]) for r in pathways.junctions(e).collect()} == {("10", "20"), ("10", "30")}
    assert pathways.confident_events(e).first()["max_change"] == pytest.approx(0.1)


def test_standard_events_need_their_prefix(spark):
    rows = spark.createDataFrame([("ENSG1", "5", "9", 0.1), ("ENSG1", "x", "9", 0.1)], "gene_id string, start string, end string, delta double")
    assert pathways.standard_events(rows).count() == 1
    with pytest.raises(Exception, match="ENS"):
        pathways.standard_events(rows.withColumn("gene_id", F.lit("Q"))).collect()


def test_usage_is_not_negative_and_shares_sum_to_one(spark):
    rng = np.random.default_rng(0)
    e = expression(spark, {("g", f"t{k}"): rng.random((3, 5)).tolist() for k in range(4)})
    assert all(r["value"] >= 0 for r in switch.total_isoform_usage(e).collect())
    assert all(r[0] == pytest.approx(1.0) for r in prep.relative_abundance(e).groupBy("rep", "tp").agg(F.sum("abundance")).select("sum(abundance)").collect())


def test_permutation_p_is_bounded(spark):
    rng = np.random.default_rng(1)
    e = expression(spark, {("g", f"t{k}"): rng.random((1, 6)).tolist() for k in range(3)})
    rows = switch.permutation_switch_p(e, 6, 20).collect()
    assert len(rows) == 3 and all(0 < r["p"] <= 1 for r in rows)


def test_writers_and_what_reads_them(spark, tmp_path):
    parts = spark.createDataFrame([(7, "a"), (7, "b"), (7, "b"), (9, "c")], "slice_id long, node string")
    readers.write_slices(parts, str(tmp_path / "slices"))
    assert sorted(map(tuple, readers.read_slices(spark, str(tmp_path / "slices")).collect())) == [(7, "a"), (7, "b"), (9, "c")]
    readers.write_modules(parts.withColumnRenamed("slice_id", "module_id"), str(tmp_path / "modules"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "modules")).collect()) == ["[a, b]", "[c]"]
    (tmp_path / "one.txt").write_text("# 0: 2 nodes\n[x, y]\n# 1: 1 nodes\n['z']\n")
    assert sorted(map(tuple, readers.read_slices(spark, str(tmp_path / "one.txt")).collect())) == [(0, "x"), (0, "y"), (1, "z")]
    readers.write_ids(parts.select("node").distinct(), str(tmp_path / "ids"))
    assert sorted(r[0] for r in readers.read_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b", "c"]
    (tmp_path / "edges.tsv").write_text("x\ty\t0.5\ny\tx\t0.5\nz\tz\t1\nb\ta\t2\n")
    assert sorted(map(tuple, readers.read_edge_table(spark, str(tmp_path / "edges.tsv")).collect())) == [("a", "b"), ("x", "y")]
    spark.createDataFrame([("e1", ["p", "q", None]), ("e2", None), (None, ["r"])], "exon string, pfams array<string>").write.parquet(str(tmp_path / "map"))
    assert sorted(map(tuple, readers.read_map(spark, str(tmp_path / "map"), "exon", "pfams").collect())) == [("e1", "p"), ("e1", "q")]
    (tmp_path / "names.json").write_text('{"id": "a", "name": "A"}\n{"id": "b", "name": "B"}\n')
    assert sorted(map(tuple, readers.read_map(spark, str(tmp_path / "names.json"), "id", "name").collect())) == [("a", "A"), ("b", "B")]


def packed_series(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 9, (4, 5))
    return spark.createDataFrame([(i, (centres[i % 4] + rng.normal(0, 1.0, 5)).tolist()) for i in range(n)], "object_idx long, vals array<double>")


def test_near_pairs_are_all_pairs_within(spark):
    series = packed_series(spark)
    for eps in (0.5, 2.0, 6.0):
        want = {(r["i"], r["j"]) for r in cluster.pair_distances(series).where(F.col("distance") <= eps).collect()}
        assert {(r["i"], r["j"]) for r in cluster.near_pairs(series, eps).collect()} == want


def labels_and_values(frame):
    rows = sorted(frame.collect(), key=lambda r: r["object_idx"])
    return np.array([r["cluster"] for r in rows])


def test_centroid_and_medoid_clusters_by_brute_force(spark):
    series = packed_series(spark)
    x = np.array([r["vals"] for r in series.orderBy("object_idx").collect()])
    truth = np.arange(60) % 4
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for name in ("kmeans", "kmedoids", "clara"):
        found = labels_and_values(cluster.find_clusters(series, name, 4))
        assert all(len(set(found[truth == c])) == 1 for c in range(4)) and len(set(found)) == 4
    found = labels_and_values(cluster.find_clusters(series, "kmeans", 4))
    centres = {c: x[found == c].mean(0) for c in set(found)}
    assert all(min(centres, key=lambda c, v=v: ((v - centres[c]) ** 2).sum()) == c for v, c in zip(x, found, strict=True))
    medoids = cluster.swap_medoids(distance, 4)
    cost = distance[medoids].min(0).sum()
    for k in range(4):  # no exchange helps
        for h in range(60):
            other = [*np.delete(medoids, k), h]
            assert distance[other].min(0).sum() >= cost - 1e-9


def exchanged(d, chosen):
    """The best exchange of all, again and again."""
    while True:
        now = d[chosen].min(0).sum()
        options = [(round(d[[*chosen[:m], h, *chosen[m + 1 :]]].min(0).sum(), 9), m, h) for m in range(len(chosen)) for h in range(len(d)) if h not in chosen]
        cost, m, h = min(options, default=(math.inf, 0, 0))
        if cost >= now - 1e-9 * max(1.0, now):
            return chosen, now
        chosen = sorted([*chosen[:m], *chosen[m + 1 :], h])


@pytest.mark.parametrize(("name", "k", "block"), [("euclidean", 5, 64), ("correlation", 3, 2048), ("softdtw", 2, 32), ("euclidean", 1, 16)])
def test_medoids_are_those_of_the_whole_matrix(spark, monkeypatch, name, k, block):
    n = 90 if name == "softdtw" else 300
    x = np.random.default_rng(k).normal(0, 1, (n, 4)) + np.arange(n)[:, None] % 5 * [3.0, -2.0, 1.0, 0.0]
    x[7] = x[8] = x[9]
    series = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "object_idx long, vals array<double>")
    monkeypatch.setattr(medoids, "BLOCK", block)
    monkeypatch.setattr(medoids, "RUN", 2)
    distances = functools.partial(cluster.block_distances, name=name)
    d = distances(x, x)
    start = sorted(r[0] for r in series.orderBy(F.xxhash64(F.lit(1234321), "object_idx"), "object_idx").limit(k).collect())
    want, cost = exchanged(d, start)
    ids, values = medoids.find(series, k, distances)
    assert d[ids].min(0).sum() == pytest.approx(cost) and np.array_equal(values, x[ids])
    got = {r["object_idx"]: r["cluster"] for r in cluster.kmedoids(series, k, name).collect()}
    assert [got[i] for i in range(n)] == (d[ids].argmin(0) + 1).tolist()


def test_medoids_of_few_objects(spark):
    series = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [5.0])], "object_idx long, vals array<double>")
    assert {r["object_idx"]: r["cluster"] for r in cluster.kmedoids(series, 5).collect()} == {1: 1, 2: 1, 3: 3}
    assert cluster.kmedoids(series.limit(0), 2).count() == 0


def test_warped_distances_of_blocks(spark):
    x = np.random.default_rng(1).normal(size=(6, 5))
    rows = [(a.tolist(), b.tolist()) for a in x for b in x]
    want = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(U.soft_dtw_column()("a", "b")).collect()]
    assert cluster.block_distances(x, x, "softdtw").ravel() == pytest.approx(want)


def test_kmeans_by_warped_distance_takes_medoids(spark):
    found = labels_and_values(cluster.find_clusters(packed_series(spark, 20), "kmeans", 4, name="softdtw"))
    assert len(set(found)) == 4


def test_optics_stretches_are_density_clusters(spark):
    series = packed_series(spark)
    a, b = labels_and_values(cluster.optics(series, 3.0, 4)), labels_and_values(cluster.dbscan(series, 3.0, 4))
    x = np.array([r["vals"] for r in series.orderBy("object_idx").collect()])
    core = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 3.0).sum(1) >= 4
    assert core.sum() > 30
    for i in np.flatnonzero(core):
        for j in np.flatnonzero(core):
            assert (a[i] == a[j]) == (b[i] == b[j])


def test_correlation_sums_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [(i, i % 3 if i < 40 else 7, (rng.normal(size=6) * (i % 5 != 0) + 3).tolist()) for i in range(41)]  # some constant, a cluster of one
    series = spark.createDataFrame(rows, "object_idx long, cluster int, vals array<double>")
    got = {(r["object_idx"], r["c"]): (r["total"], r["n"]) for r in cluster.correlation_sums(series).collect()}
    want = {(r["object_idx"], r["c"]): (r["total"], r["n"]) for r in cluster.distance_sums(series, "correlation").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)
    assert cluster.silhouettes(series.where("false"), "correlation").count() == 0


def test_spanning_forest_is_the_lightest(spark):
    rng = np.random.default_rng(11)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 50, (120, 2)) if a != b})
    edges = [(a, b, float(rng.integers(1, 9))) for a, b in edges] + [(60, 61, 1.0), (61, 62, 1.0), (60, 62, 1.0)]
    forest, labels = density.spanning_forest(spark.createDataFrame(edges, "i long, j long, w double"))
    root = {}
    find = lambda n: n if root.get(n, n) == n else find(root[n])
    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            want.add((a, b, w))
    assert {tuple(r) for r in forest.collect()} == want
    assert {r["node"]: r["component"] for r in labels.collect()} == {n: find(n) for a, b, _ in edges for n in (a, b)}
    assert [x.count() for x in density.spanning_forest(spark.createDataFrame([], "i long, j long, w double"))] == [0, 0]


def test_reachability_by_brute_force(spark):
    series = packed_series(spark, 50, seed=9)
    x = np.array([r["vals"] for r in series.orderBy("object_idx").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for eps, least in ((2.0, 4), (2.6, 2), (1.5, 1)):
        near = (d <= eps) & ~np.eye(50, dtype=bool)
        core = np.where(near.sum(1) + 1 >= least, np.sort(d, 1)[:, least - 1], np.inf)
        core[~near.any(1)] = np.inf
        _, placed, border = density.reachable(cluster.near_pairs(series, eps), least)
        assert {r["node"] for r in placed.collect()} == set(np.flatnonzero(np.isfinite(core)))
        for r in border.collect():
            reach = np.where(near[r["node"]], np.maximum(d[r["node"]], core), np.inf)
            assert not np.isfinite(core[r["node"]]) and r["reach"] == pytest.approx(reach.min())
        reached = {int(i) for i in range(50) if not np.isfinite(core[i]) and np.isfinite(core[near[i]]).any()}
        assert {r["node"] for r in border.collect()} == reached


def test_clusters_of_a_table_in_one_call(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"g{i}", r, t, float(rng.random() + 10 * (i % 3))) for i in range(20) for r in range(7) for t in range(3)]
    table = spark.createDataFrame(rows, "object_idx long, gene_id string, rep int, tp int, value double")
    found = cluster.cluster_dataset(table, "hierarchical", 3, linkage="ward", name="euclidean")
    labels = labels_and_values(found.series)
    assert all(len(set(labels[np.arange(20) % 3 == c])) == 1 for c in range(3)) and found.prototypes.count() == 9
    assert found.silhouette.first()[0] > 0.8 and 0 < found.davies_bouldin.first()[0] < 0.3
    edges = spark.createDataFrame([("g0", "g3"), ("g3", "g6")], "src string, dst string")
    assert cluster.cluster_dataset(table, "hierarchical", 3, transform="log", edges=edges).series.count() == 20


def test_split_keeps_the_other_clusters(spark):
    series = packed_series(spark).withColumn("cluster", F.when(F.col("object_idx") % 4 < 2, 1).otherwise(2))
    out = cluster.split(series, 1, 2)
    labels = labels_and_values(out)
    index = np.arange(60) % 4
    assert set(labels[index >= 2]) == {2} and len(set(labels[index == 0])) == len(set(labels[index == 1])) == 1 and set(labels) == {2, 3, 4}


def test_network_slices_are_communities(spark):
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in ring_of_cliques(6, 12)], "src string, dst string").distinct()
    got = {r["node"]: r["slice_id"] for r in modules.slices(edges, 1.0).collect()}
    assert len(got) == 72 and all(len({got[f"c{c}n{i}"] for i in range(12)}) == 1 for c in range(6)) and len(set(got.values())) == 6


def test_domain_modules(spark):
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in ring_of_cliques(6, 12)], "src string, dst string").distinct()
    named = edges.select(F.concat("src", F.lit("/P")).alias("src"), F.concat("dst", F.lit("/P")).alias("dst"))
    exclusive = spark.createDataFrame([(f"c2n{i}", "P") for i in range(10)], "gene_id string, domain_id string")
    rows = modules.domain_modules(named, exclusive, parts=modules.slices(named, 1.0)).collect()
    assert {r["node"] for r in rows} >= {f"c2n{i}/P" for i in range(10)}
