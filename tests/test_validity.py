import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelnet.operators import validity as val


def points(spark, groups):
    rows = [("g", i, [float(x)], label) for i, (x, label) in enumerate((x, k) for k, xs in enumerate(groups) for x in xs)]
    return spark.createDataFrame(rows, "g string, id long, v array<double>, label long")


def test_silhouette_calinski_and_s_dbw(spark):
    p = points(spark, [(0, 1), (10, 11)])
    assert math.isclose(val.silhouette(p).first().sw, 0.899749, abs_tol=1e-6)
    assert math.isclose(val.calinski_harabasz(p).first().ch, 200)
    assert math.isclose(val.s_dbw(p).first().s_dbw, 0.009901, abs_tol=1e-6)
    assert math.isclose(val.s_dbw(points(spark, [(0, 0.1, 0.2), (1, 1.1, 1.2)])).first().s_dbw, 0.025974, abs_tol=1e-6)


def test_a_cluster_of_one_has_silhouette_zero(spark):
    assert {r.id: r.s for r in val.silhouette_points(points(spark, [(0,), (5, 6)])).collect()}[0] == 0.0


def test_network_indices(spark):
    edges = spark.createDataFrame([("g", a, b, 1.0) for a, b in ((1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4))], "g string, src long, dst long, w double")
    labels = spark.createDataFrame([("g", i, int(i > 3)) for i in range(1, 7)], "g string, id long, label int")
    r = val.network_indices(edges, labels).first()
    assert [round(x, 6) for x in (r.avi, r.avu, r.mq, r.q)] == [0.857143, 1.0, 1.714286, 0.357143]


def pairs(spark, a, b):
    return spark.createDataFrame([("g", x, y) for x, y in zip(a, b, strict=True)], "g string, a int, b int")


def test_adjusted_rand(spark):
    a, b = (1, 1, 1, 2, 2, 2), (1, 1, 2, 2, 2, 2)
    assert math.isclose(val.adjusted_rand(pairs(spark, a, b)).first().ari, 0.324324, abs_tol=1e-6)
    assert math.isclose(val.adjusted_rand(pairs(spark, a, [5 - x for x in b])).first().ari, 0.324324, abs_tol=1e-6)
    assert val.adjusted_rand(pairs(spark, a, a)).first().ari == 1.0
    assert val.adjusted_rand(pairs(spark, (1, 1), (2, 2))).first().ari == 1.0


def test_kruskal_with_ties(spark):
    rows = spark.createDataFrame([("v", "A", x) for x in (1.0, 2.0, 2.0)] + [("v", "B", x) for x in (3.0, 4.0, 5.0)], "g string, grp string, x double")
    r = val.kruskal(rows).first()
    assert math.isclose(r.h, 3.970588, abs_tol=1e-6) and math.isclose(r.epsilon2, 0.742647, abs_tol=1e-6)
    assert val.kruskal(rows.filter("grp = 'A'")).first().h is None


def test_chi_squared_tail():
    for h, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (0.0, 4, 1.0)):
        assert math.isclose(val.chi2_tail(h, df), p, abs_tol=1e-6)


@pytest.mark.parametrize(("x", "want"), [(0.8, "stable"), (0.7, "membership unsure"), (0.1, "unstable")])
def test_verdict(spark, x, want):
    assert spark.range(1).select(val.verdict(F.lit(x))).first()[0] == want


def test_silhouettes_of_many_clusters_over_small_blocks(spark):
    rng = np.random.default_rng(1)
    x, label = rng.standard_normal((300, 3)), rng.integers(0, 90, 300)
    p = spark.createDataFrame([("g", i, x[i].tolist(), int(label[i])) for i in range(300)], "g string, id long, v array<double>, label long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for block in (2048, 5):
        sums = val.distance_sums(p, block).collect()
        assert len(sums) <= 300 * 2 * (1 + 3 * (300 // (5 * 16) + 1) * (block == 5))  # not a row for each point and cluster
        by = {}
        for r in sums:
            assert math.isclose(r.d, d[r.id, label == r.other].sum(), rel_tol=1e-9, abs_tol=1e-12) and r.n == (label == r.other).sum()
            by.setdefault(r.id, {})[r.other] = r.d / r.n
        for i in range(300):
            assert label[i] in by[i]
            want = min(d[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
            assert math.isclose(min(v for c, v in by[i].items() if c != label[i]), want, rel_tol=1e-9)
