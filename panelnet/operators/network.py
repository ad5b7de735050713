"""Temporal similarity networks: all-pairs similarities by blocks, symmetric nearest-neighbour graphs, graph summaries.

All-pairs similarity is quadratic work by its nature. It is dealt out as pairs of blocks of vectors: a task holds a narrow and a
wide block and returns the k best partners of each row of the narrow one, so what is shuffled is n x k for each wide block, never n x n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.storage import saved

BLOCK = 2048
WIDE = 16


def vectors(panel: DataFrame, columns: list[str], entity: str = "entity", t: str = "t") -> DataFrame:
    """(t, id, v) from feature columns."""
    return panel.select(F.col(t).alias("t"), F.col(entity).cast("long").alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _best(k: int, centre: bool):
    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        x = np.stack(table["v"].to_numpy())
        x = _unit(x - x.mean(axis=1, keepdims=True) if centre else x)
        order = np.argsort(ids, kind="stable")
        left, right = order[side[order] == 0], order[side[order] == 1]
        others = ids[right]
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(left), 256):
            some = left[lo : lo + 256]
            own, least = ids[some], np.full(len(some), -np.inf)
            row, col, w = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for at in range(0, len(right), 2048):  # in order of id, so a later one must be better to count
                s = x[some] @ x[right[at : at + 2048]].T
                mine = np.searchsorted(others[at : at + 2048], own, "left")
                there = np.searchsorted(others[at : at + 2048], own, "right")
                for r in np.flatnonzero(mine < there).tolist():
                    s[r, mine[r] : there[r]] = -np.inf
                some_rows = np.flatnonzero(~(s.max(axis=1) <= least))  # most rows have nothing better in a later tile
                if at == 0 and s.shape[1] > k:
                    ok = s >= np.partition(np.where(np.isnan(s), -np.inf, s), -k, axis=1)[:, -k, None]
                    some_rows = np.arange(len(s))
                else:
                    ok = s[some_rows] > least[some_rows, None]
                r, c = np.divmod(np.flatnonzero(ok), s.shape[1])
                r = some_rows[r]
                if not len(r):
                    continue
                row, col, w = np.concatenate((row, r)), np.concatenate((col, c + at)), np.concatenate((w, s[r, c]))
                by = np.lexsort((col, -w, row))
                row, col, w = row[by], col[by], w[by]
                rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
                row, col, w, rank = (z[rank < k] for z in (row, col, w, rank))
                full = rank == k - 1
                least[row[full]] = w[full]
            ok = np.isfinite(w)
            out.append((own[row[ok]], others[col[ok]], w[ok]))
        a, b, w = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"t": pa.array([key[0].as_py()] * len(a), pa.int32()), "i": pa.array(a, pa.int64()), "j": pa.array(b, pa.int64()), "s": pa.array(w)})

    return cell


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by the keys of groups whose work is not their bytes: adaptive execution would put small groups into one task, here they run apart."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def pairs_of_blocks(rows: DataFrame, by: str, columns: list, block: int, place: Column | None = None) -> DataFrame:
    """(by, a, b, side, columns): the rows of block a (side 0) beside those of block b (side 1), for all pairs; a b-block has the rows of WIDE a-blocks,
    or with ``place``, a number from 0 to the rows of the group less one, those next to each other by it."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    wide = (F.floor(F.col("block") / WIDE) if place is None else F.floor(place / (block * WIDE))).cast("int")
    mine = rows.select(by, F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / WIDE).cast("int"))).alias("b"), F.lit(0).alias("side"), *columns)
    theirs = rows.select(by, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), wide.alias("b"), F.lit(1).alias("side"), *columns)
    return dealt(mine.unionByName(theirs), by, "a", "b")


def nearest(vecs: DataFrame, k: int, centre: bool = False, block: int = BLOCK) -> DataFrame:
    """(t, i, j, s, rank): for each vector of (t, id, v) the k most similar ones of its period by cosine, or with ``centre`` by Pearson correlation.

    Ties go to the smaller id. Vectors of norm 0 have similarity 0 with all.
    """
    cells = pairs_of_blocks(vecs.select(F.col("t").cast("int").alias("t"), "id", "v"), "t", ["id", "v"], block)
    found = cells.groupBy("t", "a", "b").applyInArrow(_best(k, centre), "t int, i long, j long, s double")
    return ranked(found, k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best partners of each i in each t, stable: by s, then the smaller j."""
    order = Window.partitionBy("t", "i").orderBy(F.col("s").desc(), F.col("j"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def symmetric(best: DataFrame, k: int | None = None) -> DataFrame:
    """(t, src, dst, w), src < dst: an edge if either end chose the other, of positive finite similarity; w is the larger one."""
    best = best.filter((F.col("s") > 0) & ~F.isnan("s") & (F.col("s") < float("inf")))
    best = best if k is None else best.filter(F.col("rank") <= k)
    return best.groupBy("t", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.max("s").alias("w"))


def knn_edges(vecs: DataFrame, k: int, centre: bool = False) -> DataFrame:
    return symmetric(nearest(vecs, k, centre))


def knn_sweep(vecs: DataFrame, ks: list[int], rule: str, centre: bool = False) -> DataFrame:
    """Edges for several k, tagged with rule and k: neighbours are sought once, for the largest."""
    best = nearest(vecs, max(ks), centre)
    parts = [symmetric(best, k).select(F.lit(rule).alias("rule"), F.lit(k).alias("k"), "*") for k in ks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changes(panel: DataFrame, columns: list[str], entity: str = "entity", t: str = "t") -> DataFrame:
    """(entity, t, columns): first differences; t is that of the earlier period."""
    order = Window.partitionBy(entity).orderBy(t)
    diff = {c: F.lead(c).over(order) - F.col(c) for c in columns}
    follows = F.lead(t).over(order) == F.col(t) + 1
    return panel.select(entity, t, follows.alias("_next"), *(x.alias(c) for c, x in diff.items())).filter("_next").drop("_next")


def time_varying(panel: DataFrame, columns: list[str], entity: str = "entity", least: float = 1e-9) -> DataFrame:
    """(feature, spread): the largest standard deviation over time of any entity, and whether it exceeds ``least``."""
    spread = panel.groupBy(entity).agg(*(F.stddev_pop(c).alias(c) for c in columns)).agg(*(F.max(c).alias(c) for c in columns))
    return spread.unpivot([], columns, "feature", "spread").withColumn("varies", F.col("spread") > least)


def change_windows(diffs: DataFrame, columns: list[str], window: int, n_periods: int, entity: str = "entity", t: str = "t") -> DataFrame:
    """(t, id, v): for each of the periods the changes of all features in a window of ``window`` changes about it, moved inside the series at its ends.

    A window longer than the series is the whole series.
    """
    most = n_periods - 1
    lo = lambda at: max(0, min(max(0, at - window // 2), most - window))
    of = F.array(*(F.struct(F.lit(at).alias("at"), F.lit(lo(at)).alias("lo")) for at in range(n_periods)))
    # a change belongs to the windows that start at most window - 1 before it
    spread = diffs.withColumn("w", F.explode(of)).filter((F.col(t) >= F.col("w.lo")) & (F.col(t) < F.col("w.lo") + window))
    row = F.struct(F.col(t).alias("t"), F.array(*(F.col(c) for c in columns)).alias("v"))
    got = spread.groupBy(F.col("w.at").alias("at"), F.col(entity).alias("id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return got.select(F.col("at").alias("t"), F.col("id").cast("long").alias("id"), F.flatten(F.transform("r", lambda x: x["v"])).alias("v"))


def lagged_series(diffs: DataFrame, columns: list[str], entity: str = "entity", t: str = "t") -> DataFrame:
    """(id, v): all changes of an entity, in order of time."""
    row = F.struct(F.col(t).alias("t"), F.array(*(F.col(c) for c in columns)).alias("v"))
    got = diffs.groupBy(F.col(entity).cast("long").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return got.select("id", F.transform("r", lambda x: x["v"]).alias("v"))


def _lag_scores(x: np.ndarray, y: np.ndarray, lags: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row of x and of y the largest Pearson correlation of x at t with y at t + lag, the first such of ``lags``, and that at lag 0."""
    span = x.shape[1]
    best = np.full((len(x), len(y)), -np.inf)
    arg = np.zeros(best.shape, np.int32)
    zero = np.zeros(best.shape)
    part = lambda z, lo, hi: (lambda flat: _unit(flat - flat.mean(axis=1, keepdims=True)))(z[:, lo:hi].reshape(len(z), -1))
    for lag in lags:
        s = part(x, max(0, -lag), span - max(0, lag)) @ part(y, max(0, lag), span - max(0, -lag)).T
        if lag == 0:
            zero = s
        better = s > best + 1e-12
        best[better], arg[better] = s[better], lag
    return best, arg, zero


def _block_pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and series of the two blocks of a cell, in order of id; of one block twice where they are the same."""
    table = table.sort_by("id")
    ids, own = table["id"].to_numpy(), table["block"].to_numpy() == key[0].as_py()
    other = own if key[0].as_py() == key[1].as_py() else ~own
    x = np.array(table["v"].to_pylist(), float)
    return ids[own], x[own], ids[other], x[other]


def _block_cells(series: DataFrame, block: int) -> DataFrame:
    """The rows of (id, v) for each unordered pair (a, b) of blocks, a block paired with itself included."""
    n = series.agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = series.crossJoin(n).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "block", "id", "v")


def lag_similarity(series: DataFrame, max_lag: int, block: int = 1024) -> DataFrame:
    """(i, j, s, lag, zero) for all ordered pairs: the largest Pearson correlation of i at t with j at t + lag, the first such lag from -max_lag up, and that at lag 0.

    This is the whole matrix, n x n rows by its definition; lag_nearest gives the neighbours without it.
    """
    ahead = range(-max_lag, max_lag + 1)

    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, x, b, y = _block_pair(key, table)
        out = []
        for ids, left, others, right in [(a, x, b, y)] + [(b, y, a, x)] * (key[0] != key[1]):
            s, lag, zero = _lag_scores(left, right, ahead)
            i, j = np.nonzero(ids[:, None] != others[None, :])
            out.append((ids[i], others[j], s[i, j], lag[i, j], zero[i, j]))
        return pa.table(dict(zip(("i", "j", "s", "lag", "zero"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return _block_cells(series, block).groupBy("a", "b").applyInArrow(cell, "i long, j long, s double, lag int, zero double")


def lag_nearest(series: DataFrame, max_lag: int, k: int, block: int = 1024) -> DataFrame:
    """(t = 0, i, j, s, lag, back, zero, rank): for each i the k partners of the largest lagged correlation in either direction.

    lag is that of i to j, back that of j to i, each the first from -max_lag up. A cell holds both directions of its two blocks, so
    it returns k rows for each of its series and never the pairs. Ties go to the smaller id.
    """
    ahead = range(-max_lag, max_lag + 1)

    def top(s: np.ndarray, ids: np.ndarray, others: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        ok = np.isfinite(np.take_along_axis(s, at, 1))
        return (np.repeat(ids, at.shape[1])[ok.ravel()], others[at][ok], *(np.take_along_axis(m, at, 1)[ok] for m in (s, *more)))

    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, x, b, y = _block_pair(key, table)
        there, lag, zero = _lag_scores(x, y, ahead)
        back_s, back, _ = _lag_scores(x, y, ahead[::-1])  # the lag of j to i is that of i to j, negated
        s = np.where(a[:, None] == b[None, :], -np.inf, np.maximum(there, back_s))
        out = [top(s, a, b, lag, -back, zero)]
        if key[0] != key[1]:
            out.append(top(s.T, b, a, -back.T, lag.T, zero.T))
        return pa.table(dict(zip(("i", "j", "s", "lag", "back", "zero"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = _block_cells(series, block).groupBy("a", "b").applyInArrow(cell, "i long, j long, s double, lag int, back int, zero double")
    return ranked(found.select(F.lit(0).alias("t"), "*"), k)


def lag_statistics(best: DataFrame) -> DataFrame:
    """(lag0, lag1, lag2, zero, best) of the symmetric graph of ``best``, as lag_nearest gives it: the shares of edges whose lag is 0, 1, and 2 or more
    in either direction, and their mean correlations at lag 0 and at the best lag. An edge's lag is that of its smaller id to the larger one."""
    best = best.filter((F.col("s") > 0) & (F.col("s") < float("inf")))
    lag = F.when(F.col("i") < F.col("j"), F.col("lag")).otherwise(F.col("back"))
    edges = best.groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.max("s").alias("w"), F.min(lag).alias("lag"), F.min("zero").alias("zero"))
    share = lambda ok: F.avg(ok.cast("double"))
    far = F.abs("lag")
    return edges.agg(share(far == 0).alias("lag0"), share(far == 1).alias("lag1"), share(far >= 2).alias("lag2"), F.avg("zero").alias("zero"), F.avg("w").alias("best"))


def distances(relation: DataFrame, kind: str, members: DataFrame | None = None, entity: str = "entity") -> DataFrame:
    """(i, j, d) in both directions of the rows of ``kind`` between members; where the relation has both directions, the reverse of its rows decides."""
    rel = relation.filter(F.col("type") == kind).select(F.col("x").alias("i"), F.col("y").alias("j"), F.col("distance").alias("d"))
    if members is not None:
        ids = members.select(F.col(entity).alias("i")).distinct()
        rel = rel.join(ids, "i", "left_semi").join(ids.withColumnRenamed("i", "j"), "j", "left_semi")
    back = rel.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("d").alias("back"))
    return rel.join(back, ["i", "j"], "full_outer").select("i", "j", F.coalesce("back", "d").alias("d"))


def geo_scale(dist: DataFrame, k: int) -> DataFrame:
    """The median over entities of the (k + 1)-th smallest distance, of those that have as many."""
    order = Window.partitionBy("i").orderBy("d", "j")
    return dist.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k + 1).agg(F.median("d").alias("scale"))


def geo_similarity(dist: DataFrame, k: int) -> DataFrame:
    """(t = 0, i, j, s): exp(-distance, rounded half to even to one decimal, / scale)."""
    near = dist.filter("i <> j").crossJoin(geo_scale(dist, k))
    return near.select(F.lit(0).alias("t"), "i", "j", F.exp(-F.bround("d", 1) / F.col("scale")).alias("s"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def degrees(edges: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """(t, n_edges, mean_degree); n_nodes has (t, n)."""
    return n_nodes.join(edges.groupBy("t").agg(F.count("*").alias("e")), "t", "left").select("t", F.coalesce("e", F.lit(0)).cast("long").alias("n_edges"), (2 * F.coalesce("e", F.lit(0)) / F.col("n")).alias("mean_degree"))


def component_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(t, id, component): the least id reachable within the period; isolated nodes are components of their own.

    Each round a node, and the node its label names, take the least label among the node's neighbours, and then that label's own label: whole
    trees of labels are hooked onto others, so the number of rounds grows with the logarithm of the nodes, not with the length of paths.
    Each round is written to the shared folder and only the number of changes reaches the driver.
    """
    pairs = saved(both_ways(edges.select("t", "src", "dst")))
    label = saved(nodes.select("t", "id", F.col("id").alias("c")))
    for _ in range(rounds):
        least = pairs.join(label.select("t", F.col("id").alias("dst"), "c"), ["t", "dst"]).groupBy("t", F.col("src").alias("id")).agg(F.min("c").alias("m"))
        near = label.join(least, ["t", "id"]).select("t", "id", "c", "m")
        offers = near.select("t", "id", "m").unionByName(near.select("t", F.col("c").alias("id"), "m")).groupBy("t", "id").agg(F.min("m").alias("m"))
        step = label.join(offers, ["t", "id"], "left").select("t", "id", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = step.select("t", F.col("id").alias("c"), F.col("c").alias("up"))
        new = step.join(jump, ["t", "c"], "left").select("t", "id", "was", F.least("c", F.coalesce("up", "c")).alias("c"))
        new = saved(new)
        changed = new.filter("c <> was").limit(1).count()
        label = new.drop("was")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.withColumnRenamed("c", "component")


def component_summary(labels: DataFrame) -> DataFrame:
    """(t, n_components, giant_share)."""
    sizes = labels.groupBy("t", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("t").agg(F.count("*").alias("n_components"), (F.max("n") / F.sum("n")).alias("giant_share"))


def edge_lengths(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(t, median_length) of the edges with a known distance."""
    return edges.join(dist, (F.col("src") == F.col("i")) & (F.col("dst") == F.col("j"))).groupBy("t").agg(F.median("d").alias("median_length"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(t, jaccard) of two edge sets."""
    x, y = (e.select("t", "src", "dst").distinct().withColumn(n, F.lit(1)) for e, n in ((a, "x"), (b, "y")))
    both = x.join(y, ["t", "src", "dst"], "full_outer")
    return both.groupBy("t").agg((F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count("*")).alias("jaccard"))


def stability(edges: DataFrame) -> DataFrame:
    """(t, jaccard) of the edges of t and t + 1."""
    last = edges.agg(F.max("t").alias("m"))
    later = edges.withColumn("t", F.col("t") - 1).filter("t >= 0")
    return overlap(edges.crossJoin(last).filter("t < m").drop("m"), later)


def mean_graph(edges: DataFrame, n_periods: Column) -> DataFrame:
    """(src, dst, w): sum over periods / number of periods; absent edges count as 0."""
    return edges.groupBy("src", "dst").agg((F.sum("w") / n_periods).alias("w"))


def smoothed(edges: DataFrame, alpha: float, n_periods: int) -> DataFrame:
    """(t, src, dst, w) of S_0 = A_0, S_t = (1 - alpha) A_t + alpha S_{t-1}, by its closed form.

    The weight of A_s in S_t is alpha^t for s = 0 and (1 - alpha) alpha^(t - s) else; weights below 1e-12 of a graph are kept as the recursion has them.
    """
    spread = edges.withColumnRenamed("t", "s").withColumn("t", F.explode(F.sequence("s", F.lit(n_periods - 1))))
    weight = F.when(F.col("s") == 0, F.pow(F.lit(alpha), F.col("t"))).otherwise((1 - alpha) * F.pow(F.lit(alpha), F.col("t") - F.col("s")))
    return spread.groupBy("t", "src", "dst").agg(F.sum(weight * F.col("w")).alias("w")).filter("w > 0")
