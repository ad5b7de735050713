import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from panelnet.operators import network as net

S = 1 / math.sqrt(2)


def vecs(spark, rows):
    return spark.createDataFrame([(0, i, list(map(float, v))) for i, v in rows], "t int, id long, v array<double>")


def test_nearest_neighbours_with_ties_and_negative_similarity(spark):
    v = vecs(spark, [(1, (1, 0)), (2, (S, S)), (3, (S, -S)), (4, (-1, 0))])
    edges = net.knn_edges(v, 1)
    assert sorted((r.src, r.dst, round(r.w, 6)) for r in edges.collect()) == [(1, 2, 0.707107), (1, 3, 0.707107)]
    summary = net.component_summary(net.component_labels(v.select("t", "id"), edges)).first()
    assert (summary.n_components, summary.giant_share) == (2, 0.75)
    assert net.degrees(edges, v.groupBy("t").agg(F.count("*").alias("n"))).first().mean_degree == 1


def test_blocks_do_not_change_neighbours(spark):
    rng = np.random.default_rng(1)
    v = vecs(spark, [(i, rng.standard_normal(4)) for i in range(60)])
    whole = {(r.i, r.j, round(r.s, 9)) for r in net.nearest(v, 3).collect()}
    assert whole == {(r.i, r.j, round(r.s, 9)) for r in net.nearest(v, 3, block=7).collect()}


def test_window_moves_inside_the_series(spark):
    diffs = spark.createDataFrame([(1, t, float(t)) for t in range(23)], "entity int, t int, x double")
    got = {r.t: r.v for r in net.change_windows(diffs, ["x"], 12, 24).collect()}
    assert {t: got[t][0] for t in (0, 11, 23)} == {0: 0.0, 11: 5.0, 23: 11.0} and all(len(x) == 12 for x in got.values())


def test_smoothing_is_the_recursion(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (1, 3, 4, 1.0)], "t int, src int, dst int, w double")
    got = {(r.t, r.src): r.w for r in net.smoothed(edges, 0.5, 3).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 0.5, (2, 1): 0.25, (1, 3): 0.5, (2, 3): 0.25}
    assert {(r.t, r.src): r.w for r in net.smoothed(edges, 0.0, 3).collect()} == {(0, 1): 1.0, (1, 3): 1.0}


def test_lagged_correlation_finds_the_shift(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(30)
    rows = [(1, t, float(x[t])) for t in range(25)] + [(2, t, float(x[t + 2])) for t in range(25)]
    got = {(r.i, r.j): (r.lag, round(r.s, 6)) for r in net.lag_similarity(net.lagged_series(spark.createDataFrame(rows, "entity long, t int, x double"), ["x"]), 2).collect()}
    assert got == {(1, 2): (-2, 1.0), (2, 1): (2, 1.0)}


def test_lagged_neighbours_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    series = spark.createDataFrame([(i, rng.standard_normal((9, 2)).tolist()) for i in range(40)], "id long, v array<array<double>>")
    pairs = {(r.i, r.j): r for r in net.lag_similarity(series, 2, block=1000).collect()}
    assert {k: (round(r.s, 9), r.lag) for k, r in pairs.items()} == {(r.i, r.j): (round(r.s, 9), r.lag) for r in net.lag_similarity(series, 2, block=7).collect()}
    larger = lambda i, j: max(pairs[i, j].s, pairs[j, i].s)
    for block in (1000, 7):
        best = net.lag_nearest(series, 2, 3, block)
        got = best.collect()
        assert {(r.i, r.j, r.rank) for r in got} == {(i, j, n + 1) for i in range(40) for n, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: -larger(i, j))[:3])}
        assert all((round(r.s, 9), r.lag, r.back, round(r.zero, 9)) == (round(larger(r.i, r.j), 9), pairs[r.i, r.j].lag, pairs[r.j, r.i].lag, round(pairs[r.i, r.j].zero, 9)) for r in got)
        edges = {(min(r.i, r.j), max(r.i, r.j)) for r in got if r.s > 0}
        stats = net.lag_statistics(best).first()
        assert math.isclose(stats.lag1, sum(abs(pairs[e].lag) == 1 for e in edges) / len(edges)) and math.isclose(stats.zero, sum(pairs[e].zero for e in edges) / len(edges))


def test_components_of_a_long_path(spark):
    nodes = spark.range(200).select(F.lit(0).alias("t"), "id")
    edges = spark.range(199).select(F.lit(0).alias("t"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).filter("src <> 99")
    got = {r.id: r.component for r in net.component_labels(nodes, edges).collect()}
    assert set(got.values()) == {0, 100} and got[99] == 0


def test_reverse_distances_decide(spark):
    rel = spark.createDataFrame([(1, 2, "road", 5.0), (2, 1, "road", 7.0), (1, 3, "rail", 1.0)], "x int, y int, type string, distance double")
    assert {(r.i, r.j): r.d for r in net.distances(rel, "road").collect()} == {(1, 2): 7.0, (2, 1): 5.0}


def test_components_of_a_path_in_random_order(spark):
    n = np.random.default_rng(6).permutation(400).tolist()
    nodes = spark.createDataFrame([(0, k) for k in n], "t int, id long")
    edges = spark.createDataFrame([(0, min(a, b), max(a, b)) for a, b in itertools.pairwise(n)], "t int, src long, dst long")
    assert {r.component for r in net.component_labels(nodes, edges, rounds=15).collect()} == {0}


def test_blocks_meet_once_with_wide_partners(spark):
    rows = spark.createDataFrame([("a", k, [float(k)]) for k in range(64)], "g string, id long, v array<double>")
    cells = net.pairs_of_blocks(rows, "g", ["id"], 4).collect()
    assert len(cells) == 64 * 16 + 64  # pairs of equal blocks would be 64 * 31
    left, right = ([r for r in cells if r.side == s] for s in (0, 1))
    met = [(x.id, y.id) for x in left for y in right if (x.a, x.b) == (y.a, y.b)]
    assert sorted(met) == [(i, j) for i in range(64) for j in range(64)]
