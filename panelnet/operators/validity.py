"""Validity of partitions by features and by networks, and agreement between partitions.

Points are (g, id, v, label): g names the partition (configuration, period); edges are (g, src, dst, w), each once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.functions.columns import safe
from panelnet.functions.kernels import squared_distances
from panelnet.operators.network import pairs_of_blocks

BLOCK = 2048


def _flat(points: DataFrame) -> DataFrame:
    return points.select("g", "id", "label", F.posexplode("v").alias("f", "x"))


def centroids(points: DataFrame) -> DataFrame:
    """(g, label, f, m, v, n): mean, population variance and size of each cluster by feature."""
    return _flat(points).groupBy("g", "label", "f").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n"))


def _sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For a pair of blocks: sums of distances from the rows of the first to clusters in the second, of n points each: to their own, to those that
    other blocks have points of, and of those that are here whole only the nearest by the mean."""
    side, size = table["side"].to_numpy(), table["n"].to_numpy()
    x, ids, own = np.stack(table["v"].to_numpy()), table["id"].to_numpy(), table["label"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right[np.argsort(own[right], kind="stable")]
    labels, first, code, count = np.unique(own[right], return_index=True, return_inverse=True, return_counts=True)
    n = size[right[first]] if len(right) else np.zeros(0, int)
    whole, most = count == n, np.finfo(float).max
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(left) if len(right) else 0, 128):
        some = left[lo : lo + 128]
        total = np.zeros((len(some), len(labels)))
        for at in range(0, len(right), 2048):
            d = squared_distances(x[some], x[right[at : at + 2048]])
            here = code[at : at + 2048]
            starts = np.flatnonzero(np.diff(here, prepend=-1))
            total[:, here[starts]] += np.add.reduceat(np.sqrt(d, out=d), starts, axis=1)
        mine = own[some, None] == labels
        rank = np.where(whole & ~mine, np.nan_to_num(total / n, nan=most, posinf=most / 2), np.inf)
        keep = mine | ~whole
        keep[np.arange(len(some)), rank.argmin(axis=1)] = True
        i, j = np.nonzero(keep)
        out.append((ids[some[i]], own[some[i]], labels[j], n[j], total[i, j]))
    id_, label, other, n, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 4 + (np.zeros(0),)
    return pa.table({"g": pa.array([key[0].as_py()] * len(d), pa.string()), "id": pa.array(id_), "label": pa.array(label), "other": pa.array(other), "n": pa.array(n), "d": pa.array(d)})


def distance_sums(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, id, label, other, n, d): the sum of Euclidean distances from each point to its own cluster and to others of n points, the nearest by the mean among them.

    Quadratic work in pairs of blocks. Clusters lie next to each other in wide blocks, so a point has few rows in each, however many clusters there are.
    """
    rows = points.select(F.col("g").cast("string").alias("g"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v")
    sizes = rows.groupBy("g", "label").agg(F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sizes.withColumn("place", F.sum("n").over(before) - F.col("n")), ["g", "label"])
    place = F.col("place") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("n"))
    parts = pairs_of_blocks(rows, "g", ["id", "label", "n", "v"], block, place).groupBy("g", "a", "b").applyInArrow(_sums, "g string, id long, label long, other long, n long, d double")
    return parts.groupBy("g", "id", "label", "other", "n").agg(F.sum("d").alias("d"))


def silhouette_points(points: DataFrame) -> DataFrame:
    """(g, id, label, s): Euclidean silhouette of each point; 0 in a cluster of one."""
    d = distance_sums(points)
    own = F.col("other") == F.col("label")
    ab = d.groupBy("g", "id", "label").agg(F.max(F.when(own, safe(F.col("d"), F.col("n") - 1.0))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    return ab.select("g", "id", "label", F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(safe(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("s"))


def silhouette(points: DataFrame) -> DataFrame:
    """(g, sw): the mean over points."""
    return silhouette_points(points).groupBy("g").agg(F.avg("s").alias("sw"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """(g, ch): (between / (k - 1)) / (within / (n - k))."""
    whole = _flat(points).groupBy("g", "f").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    total = whole.groupBy("g").agg(F.sum(F.col("v") * F.col("n")).alias("total"), F.max("n").alias("n"))
    within = centroids(points).groupBy("g").agg(F.sum(F.col("v") * F.col("n")).alias("within"), F.count_distinct("label").alias("k"))
    both = total.join(within, "g")
    return both.select("g", safe((F.col("total") - F.col("within")) / F.nullif(F.col("k") - 1, F.lit(0)), F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0))).alias("ch"))


def s_dbw(points: DataFrame) -> DataFrame:
    """(g, s_dbw): scatter, the mean norm of cluster variances over that of all, plus the mean over ordered pairs of clusters of the
    density at their midpoint over the larger of those at their centres; density counts the points within sqrt(sum of the norms) / k. Centres are
    as many as clusters; they meet the points of their own cluster or pair by joins on the cluster."""
    c = centroids(points)
    spread = c.groupBy("g", "label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("sigma"))
    whole = _flat(points).groupBy("g", "f").agg(F.var_pop("x").alias("v")).groupBy("g").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("all"))
    scat = spread.groupBy("g").agg(F.avg("sigma").alias("sigma"), (F.sqrt(F.sum("sigma")) / F.count("*")).alias("radius"), F.count("*").alias("k")).join(whole, "g")
    scat = scat.select("g", "radius", "k", safe(F.col("sigma"), F.col("all")).alias("scat"))
    centre = c.groupBy("g", "label").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("c")).select("g", "label", F.transform("c", lambda x: x["m"]).alias("c"))
    other = centre.select("g", F.col("label").alias("other"), F.col("c").alias("oc"))
    pair = centre.join(other, "g").filter("label <= other").withColumn("at", F.zip_with("c", "oc", lambda x, y: (x + y) / 2))
    side = pair.select("g", "label", "other", "at", F.explode(F.array_distinct(F.array("label", "other"))).alias("of"))
    near = side.join(points.select("g", F.col("label").alias("of"), "v"), ["g", "of"]).join(scat.select("g", "radius"), "g")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "at", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    dens = near.groupBy("g", "label", "other").agg(F.count_if(gap <= F.col("radius")).alias("n"))
    own = dens.filter("label = other").select("g", "label", F.col("n").alias("own"))
    mid = dens.filter("label < other").join(own, ["g", "label"]).join(own.select("g", F.col("label").alias("other"), F.col("own").alias("own2")), ["g", "other"])
    between = mid.groupBy("g").agg(F.sum(2 * F.coalesce(safe(F.col("n"), F.greatest("own", "own2").cast("double")), F.lit(0.0))).alias("b"))
    return scat.join(between, "g", "left").select("g", (F.col("scat") + safe(F.coalesce("b", F.lit(0.0)), (F.col("k") * (F.col("k") - 1)).cast("double"))).alias("s_dbw"))


def block_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, a, b, w), a <= b: summed weight of the edges between or within clusters, each edge once; labels are (g, id, label)."""
    la = labels.select("g", F.col("id").alias("src"), F.col("label").alias("x"))
    lb = labels.select("g", F.col("id").alias("dst"), F.col("label").alias("y"))
    return edges.join(la, ["g", "src"]).join(lb, ["g", "dst"]).groupBy("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))


def network_indices(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, avi, avu, mq, q): isolation, unifiability, turbo modularisation quality and modularity; every cluster counts, those without edges too."""
    w = block_weights(edges, labels)
    clusters = labels.select("g", "label").distinct()
    ends = w.select("g", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("c"), F.col("w").alias("inner"), F.lit(0.0).alias("cut")))).otherwise(F.array(F.struct(F.col("a").alias("c"), F.lit(0.0).alias("inner"), F.col("w").alias("cut")), F.struct(F.col("b").alias("c"), F.lit(0.0).alias("inner"), F.col("w").alias("cut"))))).alias("e"))
    own = ends.groupBy("g", F.col("e.c").alias("label")).agg(F.sum("e.inner").alias("inner"), F.sum("e.cut").alias("cut"))
    own = clusters.join(own, ["g", "label"], "left").fillna(0.0, ["inner", "cut"])
    size = own.groupBy("g").agg((F.sum("inner") + F.sum("cut") / 2).alias("m"), F.count("*").alias("k"))
    isolation = F.coalesce(safe(2 * F.col("inner"), 2 * F.col("inner") + F.col("cut")), F.lit(0.0))
    part = safe(F.col("inner"), F.col("m")) - F.pow(safe(2 * F.col("inner") + F.col("cut"), 2 * F.col("m")), 2)
    by = own.join(size, "g").groupBy("g").agg(F.avg(isolation).alias("avi"), F.sum(isolation).alias("mq"), F.sum(part).alias("q"), F.max("k").alias("k"))
    cuts = own.select("g", F.col("label").alias("a"), F.col("cut").alias("ca"))
    cross = w.filter("a < b").join(cuts, ["g", "a"]).join(cuts.select("g", F.col("a").alias("b"), F.col("ca").alias("cb")), ["g", "b"])
    den = F.col("ca") + F.col("cb") - F.col("w")
    unify = cross.groupBy("g").agg(F.sum(F.when(den > 0, 2 * F.col("w") / den).otherwise(0.0)).alias("u"))
    return by.join(unify, "g", "left").select("g", "avi", (F.coalesce("u", F.lit(0.0)) / F.col("k")).alias("avu"), "mq", "q")


def sizes(points: DataFrame) -> DataFrame:
    """(g, k, min_size, max_share)."""
    by = points.groupBy("g", "label").agg(F.count("*").alias("n"))
    return by.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("min_size"), (F.max("n") / F.sum("n")).alias("max_share"))


def bundle(points: DataFrame, edges: DataFrame) -> DataFrame:
    """All indices, a row for each g; those by features are null unless 1 < k < n."""
    out = sizes(points).join(network_indices(edges, points.select("g", "id", "label")), "g")
    n = points.groupBy("g").agg(F.count("*").alias("_n"))
    for x in (silhouette(points), calinski_harabasz(points), s_dbw(points)):
        out = out.join(x.withColumn("g", F.col("g").cast(points.schema["g"].dataType)), "g", "left")
    ok = (F.col("k") > 1) & (F.col("k") < F.col("_n"))
    return out.join(n, "g").withColumns({c: F.when(ok, F.col(c)) for c in ("sw", "ch", "s_dbw")}).drop("_n")


def contingency(pairs: DataFrame) -> DataFrame:
    """(g, a, b, n) of rows (g, a, b) with the labels of two partitions; absent combinations have no row."""
    return pairs.groupBy("g", "a", "b").agg(F.count("*").alias("n"))


def dense_contingency(pairs: DataFrame) -> DataFrame:
    """contingency() with a zero for each absent combination of labels that occur."""
    table = contingency(pairs)
    grid = pairs.select("g", "a").distinct().join(pairs.select("g", "b").distinct(), "g")
    return grid.join(table, ["g", "a", "b"], "left").fillna(0, ["n"])


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """(g, ari); 1 for equal partitions, also trivial ones."""
    table = contingency(pairs)
    two = lambda n: n.cast("double") * (n.cast("double") - 1) / 2
    cells = table.groupBy("g").agg(F.sum(two(F.col("n"))).alias("nij"), F.sum("n").alias("n"))
    side = lambda c: table.groupBy("g", c).agg(F.sum("n").alias("n")).groupBy("g").agg(F.sum(two(F.col("n"))).alias(f"s{c}"))
    x = cells.join(side("a"), "g").join(side("b"), "g")
    expected = F.coalesce(safe(F.col("sa") * F.col("sb"), two(F.col("n"))), F.lit(0.0))
    return x.select("g", F.coalesce(safe(F.col("nij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def best_jaccard(pairs: DataFrame) -> DataFrame:
    """(g, a, jaccard): for each cluster of the first partition the largest Jaccard similarity with one of the second."""
    table = contingency(pairs)
    na = table.groupBy("g", "a").agg(F.sum("n").alias("na"))
    nb = table.groupBy("g", "b").agg(F.sum("n").alias("nb"))
    both = table.join(na, ["g", "a"]).join(nb, ["g", "b"])
    return both.groupBy("g", "a").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def verdict(jaccard: Column) -> Column:
    return F.when(jaccard >= 0.75, "stable").when(jaccard >= 0.6, "membership unsure").otherwise("unstable")


def kruskal(rows: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(g, n, k, h, epsilon2, share) of rows (g, grp, x): the Kruskal-Wallis statistic corrected for ties and its effect size.

    A null value or group is missing; h and epsilon2 are null below ``least_share`` of values or with fewer than two groups. Ranks come
    from counts of distinct values, so what is ordered in one place is the distinct values of a variable.
    """
    every = rows.groupBy("g").agg(F.count("*").alias("of"))
    d = rows.filter(F.col("x").isNotNull() & F.col("grp").isNotNull())
    values = d.groupBy("g", "x").agg(F.count("*").alias("t"))
    upto = Window.partitionBy("g").orderBy("x")
    rank = values.withColumn("r", F.sum("t").over(upto) - (F.col("t") - 1) / 2)
    sums = d.join(rank, ["g", "x"]).groupBy("g", "grp").agg(F.sum("r").alias("r"), F.count("*").alias("n"))
    main = sums.groupBy("g").agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = values.groupBy("g").agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    x = every.join(main.join(ties, "g"), "g", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0))})
    n = F.col("n").cast("double")
    h = safe(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (F.pow(n, 3) - n))
    ok = (n / F.col("of") >= least_share) & (F.col("k") >= 2)
    x = x.withColumn("h", F.when(ok, h))
    return x.select("g", "n", "k", "h", safe(F.col("h") - F.col("k") + 1, (F.col("n") - F.col("k")).cast("double")).alias("epsilon2"), (F.col("n") / F.col("of")).alias("share"))


def chi2_tail(h: float, df: int) -> float:
    """P(X > h) for the chi-squared distribution, by its recurrence in the degrees of freedom."""
    import math

    if h <= 0:
        return 1.0
    if df % 2:
        tail, term, k = math.erfc(math.sqrt(h / 2)), math.sqrt(2 * h / math.pi) * math.exp(-h / 2), 1
    else:
        tail, term, k = math.exp(-h / 2), math.exp(-h / 2) * h / 2, 2
    while k < df:
        tail += term
        k += 2
        term *= h / k
    return min(1.0, tail)


def strength(effect: Column) -> Column:
    return F.when(effect >= 0.14, "strong").when(effect < 0.06, "weak").when(effect.isNotNull(), "medium")


def shown_p(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "< 0.001").otherwise(F.format_string("%.3f", p))
