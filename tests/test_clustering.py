import itertools
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelnet.functions import kernels
from panelnet.operators import clustering as clu


def agreement(a, b):
    table = np.zeros((max(a) + 1, max(b) + 1))
    np.add.at(table, (a, b), 1)
    two = lambda n: (n * (n - 1) / 2).sum()
    expected = two(table.sum(1)) * two(table.sum(0)) / two(np.array([len(a)]))
    return (two(table) - expected) / ((two(table.sum(1)) + two(table.sum(0))) / 2 - expected)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    truth = np.repeat(np.arange(3), 20)
    x = rng.standard_normal((60, 2)) * 0.3 + np.array([(0, 0), (6, 0), (0, 6)])[truth]
    near = ((x[:, None] - x[None]) ** 2).sum(2)
    close = near < np.sort(near, axis=1)[:, [12]]
    i, j = np.nonzero(np.triu(close | close.T, 1))
    return truth, x, i, j, np.exp(-near[i, j])


def test_planted_partitions_come_back(blobs):
    truth, x, i, j, w = blobs
    bridge = np.append(i, [0, 20]), np.append(j, [20, 40]), np.append(w, [0.01, 0.01])
    a = kernels.adjacency(60, *bridge)
    for assign in ("kmeans", "discretize", "cluster_qr"):
        assert agreement(truth, kernels.spectral(a, 3, assign=assign)) > 0.95, assign
    assert agreement(truth, kernels.kmeans(x, 3)[0]) > 0.95
    assert agreement(truth, kernels.ward_connected(x, i, j, 3)) > 0.95
    assert agreement(truth, kernels.louvain(60, i, j, w, 0.2)) > 0.8


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_the_best_permutation(rows):
    gain = np.array(rows)
    got = kernels.assignment(gain)
    assert sorted(got) == list(range(len(gain)))
    best = max(sum(gain[p[c], c] for c in range(len(gain))) for p in itertools.permutations(range(len(gain))))
    assert sum(gain[got[c], c] for c in range(len(gain))) == best


def test_names_are_handed_on(spark):
    rows = [("s", 0, 1, 0), ("s", 0, 2, 0), ("s", 0, 3, 1), ("s", 0, 4, 1), ("s", 1, 1, 1), ("s", 1, 2, 1), ("s", 1, 3, 0), ("s", 1, 4, 0)]
    got = clu.handed_on(spark.createDataFrame(rows, "s string, t int, id long, label int"), 2)
    assert [r.type for r in got.filter("t = 1").orderBy("id").collect()] == [0, 0, 1, 1]
    assert clu.handed_on(spark.createDataFrame(rows[:4], "s string, t int, id long, label int"), 2).count() == 4


def test_groups_run_apart_and_twice_alike(spark, blobs):
    truth, x, i, j, w = blobs
    points = spark.createDataFrame([(g, n, x[n].tolist()) for g in ("a", "b") for n in range(60)], "g string, id long, v array<double>")
    edges = spark.createDataFrame([(g, int(a), int(b), float(c)) for g in ("a", "b") for a, b, c in zip(i, j, w, strict=True)], "g string, src long, dst long, w double")
    for method in clu.METHODS:
        one, two = (clu.run(method, points, edges, 3).orderBy("g", "id").collect() for _ in range(2))
        assert one == two and len(one) == 120
        assert agreement(truth, [r.label for r in one[:60]]) > 0.5
    with pytest.raises(ValueError, match="unknown method"):
        clu.run("nothing", points, edges, 3)


def test_large_kmeans(spark, blobs):
    truth, x, *_ = blobs
    points = spark.createDataFrame([(n, x[n].tolist()) for n in range(60)], "id long, v array<double>")
    assert agreement(truth, [r.label for r in clu.kmeans_large(points, 3).orderBy(F.col("id")).collect()]) > 0.95


def _planted(n, every=100):
    """A graph of three groups: six random links of each node within its group, one in ``every`` nodes with a link to any other."""
    rng = np.random.default_rng(3)
    truth = np.arange(n) % 3
    i = np.concatenate((np.repeat(np.arange(n), 6), np.arange(0, n, every)))
    j = np.concatenate((rng.integers(0, n // 3, 6 * n) * 3 + np.repeat(truth, 6), rng.integers(0, n, len(range(0, n, every)))))
    pairs = np.unique(np.stack((np.minimum(i, j), np.maximum(i, j)), 1)[i != j], axis=0)
    return truth, pairs[:, 0], pairs[:, 1]


def test_sparse_embedding_is_the_dense_one():
    _, i, j = _planted(300, 4)
    w = np.random.default_rng(4).uniform(0.5, 1, len(i))
    assert np.abs(kernels.leading_vectors(300, i, j, w, 3) - kernels.spectral_embedding(kernels.adjacency(300, i, j, w), 3)).max() < 1e-6
    i, j = np.arange(0, 1200, 2), np.arange(1, 1200, 2)  # 600 pairs and 100 nodes alone: the eigenvalue 1 is manifold, any of its vectors is constant on a part
    e = kernels.leading_vectors(1300, i, j, np.ones(600), 4)
    assert np.abs(e[i] - e[j]).max() < 1e-6 and np.linalg.matrix_rank(e) == 4


def test_groups_of_more_than_20000_nodes(spark):
    n = 21_000
    truth, i, j = _planted(n)
    points = spark.createDataFrame([("a", k, [float(truth[k] * 50 + k % 7), float(k % 11)]) for k in range(n)], "g string, id long, v array<double>")
    edges = spark.createDataFrame([("a", a, b, 1.0) for a, b in zip(i.tolist(), j.tolist(), strict=True)], "g string, src long, dst long, w double")
    for method in ("kmeans", "spectral", "ward_net"):
        got = {r.id: r.label for r in clu.run(method, points, edges, 3).collect()}
        assert len(got) == n and agreement(truth, np.array([got[k] for k in range(n)])) > 0.95, method


def test_parts_are_bridged_at_their_nearest_points():
    x = np.random.default_rng(5).standard_normal((400, 3))
    x[100:120] = x[300:320]
    left, right = np.arange(0, 150), np.arange(150, 400)
    d = ((x[left][:, None] - x[right][None]) ** 2).sum(axis=2)
    assert np.allclose(kernels.squared_distances(x[left], x[right]), d, rtol=1e-9, atol=0)
    p, q = np.unravel_index(d.argmin(), d.shape)
    assert kernels.nearest_pair(x, left, right) == (left[p], right[q])


def test_small_groups_run_in_tasks_of_their_own(spark):
    points = spark.createDataFrame([(f"g{g}", n, [float(n % 3), float(g)]) for g in range(24) for n in range(9)], "g string, id long, v array<double>")
    edges = spark.createDataFrame([(f"g{g}", n, n + 1, 1.0) for g in range(24) for n in range(8)], "g string, src long, dst long, w double")
    for got in (clu.kmeans(points, 3), clu.louvain(points, edges)):
        assert got.select(F.spark_partition_id()).distinct().count() >= 12


def test_one_embedding_gives_the_labels_of_each_number_of_clusters(spark, blobs):
    _, x, i, j, w = blobs
    points = spark.createDataFrame([("a", n, x[n].tolist()) for n in range(60)], "g string, id long, v array<double>")
    edges = spark.createDataFrame([("a", int(a), int(b), float(c)) for a, b, c in zip(i, j, w, strict=True)], "g string, src long, dst long, w double")
    got = {(r.k, r.id): r.label for r in clu.spectral_each(points, edges, [2, 3, 5]).collect()}
    for k in (2, 3, 5):
        assert {r.id: r.label for r in clu.spectral(points, edges, k).collect()} == {n: got[k, n] for n in range(60)}


def test_a_task_holds_its_edges_once():
    n, m = 20_000, 1_000_000
    i = np.repeat(np.arange(n, dtype=np.int32), m // n)
    j = (i + 1 + np.tile(np.arange(m // n, dtype=np.int32), n)) % n
    tracemalloc.start()
    kernels.leading_vectors(n, i, j.astype(np.int32), np.ones(m), 4, tol=1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 72e6  # the edges are 16 MB, the basis 25 MB


def test_streamed_groups_keep_vectors_and_edges_whole(spark):
    n = 25_000  # more rows than an Arrow batch has
    x = np.random.default_rng(6).standard_normal((n, 2))
    points = spark.createDataFrame([(g, k, x[k].tolist()) for g in ("a", "b") for k in range(n)], "g string, id long, v array<double>")
    edges = spark.createDataFrame([("b", n - 1 - k, k, float(k)) for k in range(n)] + [("b", 0, n, 1.0), ("c", 0, 1, 1.0)], "g string, src long, dst long, w double")

    def told(x, i, j, w):
        return (x[:, 0] > 0) + 2 * (np.bincount(i, w, len(x)) + 3 * np.bincount(j, minlength=len(x)) * (np.diff(i, prepend=0).min(initial=0) >= 0)).astype(int)

    got = {(r.g, r.id): r.label for r in clu._by_group(points, edges, told).collect()}
    assert got == {("a", k): int(x[k, 0] > 0) for k in range(n)} | {("b", k): int(x[k, 0] > 0) + 2 * (n - 1 - k + 3) for k in range(n)}
