"""Clustering of many groups at once: each group's kernel runs in one task, groups run in parallel.

Points are (g, id, v), edges (g, src, dst, w). A kernel holds its group's points, and its edges at 16 bytes each, in memory, and nothing
n x n beyond kernels.DENSE_NODES nodes; a single group too large for that takes kmeans_large().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.functions import kernels
from panelnet.operators.network import dealt

METHODS = ("kmeans", "louvain", "spectral", "ward_net")


class _Links:
    """The edges of a group between its nodes, as positions in the ids: 16 bytes each, in arrays that grow in place."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.n, self.parts = ids, 0, [np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)]

    def add(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        if not len(self.ids):
            return
        i, j = (np.searchsorted(self.ids, z).clip(max=len(self.ids) - 1) for z in (src, dst))
        ok = (self.ids[i] == src) & (self.ids[j] == dst)
        to = self.n + int(ok.sum())
        for z, more in zip(self.parts, (i, j, w), strict=True):
            if to > len(z):
                z.resize(to + to // 8, refcheck=False)
            z[self.n : to] = more[ok]
        self.n = to

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(i, j, w) in order; the edges are given up, and no more than 32 bytes each are held meanwhile."""
        i, j, w = self.parts
        key = i[: self.n].astype(np.int64)
        key *= len(self.ids)
        key += j[: self.n]
        self.parts = i = j = None
        order = np.argsort(key, kind="stable")
        w = w[: self.n][order]
        del order
        key.sort()
        i = (key // max(len(self.ids), 1)).astype(np.int32)
        key -= i.astype(np.int64) * len(self.ids)
        return i, key.astype(np.int32), w


def _by_group(points: DataFrame, edges: DataFrame | None, f: Callable[..., np.ndarray], kind: str = "int") -> DataFrame:
    """(g, id, label): f(x, i, j, w) for each group, nodes in order of id; a label is of the given kind, ``array<int>`` if f gives a row of several.

    A group comes to its task as a stream, nodes first: the task holds 16 bytes an edge and never the rows themselves.
    """

    def labelled(g: str | None, links: _Links, x: np.ndarray) -> pa.RecordBatch:
        ids = links.ids
        label = np.asarray(f(x, *links.arrays()) if len(ids) else np.zeros(0, int), np.int32)
        return pa.record_batch({"g": pa.array([g] * len(ids), pa.string()), "id": pa.array(ids, pa.int64()), "label": pa.array(label) if kind == "int" else pa.array(list(label), pa.list_(pa.int32()))})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, pa.RecordBatch]]:
        for batch in batches:
            code = batch["g"].dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = [*(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if lo < hi:
                    yield batch["g"][lo].as_py(), batch.slice(lo, hi - lo)

    def begun(ids: list[np.ndarray]) -> tuple[np.ndarray, _Links]:
        own = np.concatenate([np.zeros(0, np.int64), *ids])
        order = np.argsort(own, kind="stable")
        return order, _Links(own[order])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, group in groupby(runs(batches), key=lambda run: run[0]):
            ids, vs, links, order = [], [], None, None
            for _, rows in group:
                n = len(rows) - pc.sum(rows["side"]).as_py()
                if n:
                    nodes = rows.slice(0, n)
                    ids.append(nodes["a"].to_numpy())
                    vs.append(None if nodes["v"].null_count else np.array([v.split(",") if v else [] for v in nodes["v"].to_pylist()], float))
                if n < len(rows):
                    if links is None:
                        order, links = begun(ids)
                    links.add(*(rows[c].slice(n).to_numpy() for c in ("a", "b", "w")))
            if links is None:
                order, links = begun(ids)
            x = np.concatenate(vs)[order] if len(order) and all(v is not None for v in vs) else np.zeros((len(order), 0))
            yield labelled(g, links, x)
            del links

    text = F.array_join(F.col("v").cast("array<string>"), ",", "NaN").alias("v")  # exact; Spark takes the size of an Arrow list anew at each row
    rows = points.select(F.col("g").cast("string").alias("g"), F.lit(0).alias("side"), F.col("id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"), text)
    if edges is not None:
        rows = rows.unionByName(edges.select(F.col("g").cast("string").alias("g"), F.lit(1).alias("side"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("w").cast("double").alias("w"), F.lit(None).cast("string").alias("v")))
    return dealt(rows, "g").sortWithinPartitions("g", "side").mapInArrow(each, f"g string, id long, label {kind}")


def kmeans(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return _by_group(points, None, lambda x, i, j, w: kernels.kmeans(x, k, seed)[0])


def kmeans_large(points: DataFrame, k: int, seed: int = 42, n_init: int = 3) -> DataFrame:
    """(id, label) for one large group: distributed k-means, the best of several seeds by cost."""
    rows = points.select("id", array_to_vector("v").alias("features"))
    models = [KMeans(k=k, seed=seed + s, featuresCol="features").fit(rows) for s in range(n_init)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("id", F.col("prediction").alias("label"))


def louvain(points: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    return _by_group(points, edges, lambda x, i, j, w: kernels.louvain(len(x), i, j, w, resolution, seed))


def spectral(points: DataFrame, edges: DataFrame, k: int, seed: int = 42, assign: str = "kmeans") -> DataFrame:
    return _by_group(points, edges, lambda x, i, j, w: kernels.spectral_of_edges(len(x), i, j, w, [k], seed, assign)[0])


def spectral_each(points: DataFrame, edges: DataFrame, ks: list[int], seed: int = 42, assign: str = "kmeans") -> DataFrame:
    """(g, id, k, label): spectral() for several numbers of clusters, with one embedding of each group."""
    many = _by_group(points, edges, lambda x, i, j, w: np.stack(kernels.spectral_of_edges(len(x), i, j, w, ks, seed, assign), axis=1), "array<int>")
    of = F.array(*map(F.lit, ks))
    return many.select("g", "id", F.explode(F.arrays_zip(of.alias("k"), F.col("label"))).alias("x")).select("g", "id", "x.k", "x.label")


def ward_net(points: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    return _by_group(points, edges, lambda x, i, j, w: kernels.ward_connected(x, i, j, k))


def run(method: str, points: DataFrame, edges: DataFrame, k: int, seed: int = 42, resolution: float = 1.0) -> DataFrame:
    """Labels by the named method; an unknown one fails."""
    if method == "kmeans":
        return kmeans(points, k, seed)
    if method == "louvain":
        return louvain(points, edges, resolution, seed)
    if method == "spectral":
        return spectral(points, edges, k, seed)
    if method == "ward_net":
        return ward_net(points, edges, k)
    raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")


def run_matrix(points: DataFrame, graphs: dict[str, DataFrame], methods: list[str], k: int, reference: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Labels (config, g, id, label) and the edges that each configuration's network indices are taken on.

    k-means runs once, on features, with the reference graph's indices; every other method on every graph.
    """
    labels, edges = [], []
    for method in methods:
        for name in [reference] if method == "kmeans" else list(graphs):
            config = method if method == "kmeans" else f"{method}@{name}"
            labels.append(run(method, points, graphs[name], k, seed).withColumn("config", F.lit(config)))
            edges.append(graphs[name].withColumn("config", F.lit(config)))
    for parts in (labels, edges):
        while len(parts) > 1:
            parts[:2] = [parts[0].unionByName(parts[1])]
    return labels[0], edges[0]


def handed_on(labels: DataFrame, k: int) -> DataFrame:
    """(s, t, id, type): raw labels (s, t, id, label) of each scenario renamed period by period by the largest overlap with the types before.

    Only K x K counts of each pair of periods meet in a scenario's task.
    """
    after = labels.select("s", (F.col("t") - 1).alias("t"), "id", F.col("label").alias("b"))
    n = labels.select("s", "t", "id", F.col("label").alias("a")).join(after, ["s", "t", "id"]).groupBy("s", "t", "a", "b").agg(F.count("*").alias("n"))
    n = n.unionByName(labels.select("s").distinct().select("s", F.lit(-1).alias("t"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("n")))

    def chain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, a, b, count = (table[c].to_numpy() for c in ("t", "a", "b", "n"))
        steps = []
        for at in range(int(t.max()) + 1):
            c = np.zeros((k, k), np.int64)
            c[a[t == at], b[t == at]] = count[t == at]
            steps.append(c)
        names = kernels.align_chain(steps) if steps else [np.arange(k)]
        return pa.table({"s": pa.array([key[0].as_py()] * (k * len(names)), pa.string()), "t": pa.array(np.repeat(np.arange(len(names)), k), pa.int32()), "label": pa.array(np.tile(np.arange(k), len(names)), pa.int32()), "type": pa.array(np.concatenate(names), pa.int32())})

    names = n.select("s", F.col("t").cast("int").alias("t"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n").groupBy("s").applyInArrow(chain, "s string, t int, label int, type int")
    return labels.join(names, ["s", "t", "label"]).select("s", "t", "id", "type")
