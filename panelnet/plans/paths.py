"""Evolutionary clustering of scenarios: networks, smoothing, spectral types, handed-on names; stability by rerunning it.

A scenario (s) is a variant of the input or the parameters. All scenarios and periods run as keys of the same
DataFrames, so a hundred reruns are one job with many groups.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.operators import clustering as clu
from panelnet.operators import labels as lab
from panelnet.operators import network as net
from panelnet.operators import validity as val
from panelnet.storage import collected, saved

SPAN = 4096
#: Vectors of the subsamples that run at once, about; neighbours that lists are longer by than twice what a subsample needs on average.
ROWS = 1 << 20
SPARE = 12


def knn(vecs: DataFrame, k: int) -> DataFrame:
    """(s, t, src, dst, w) from (s, t, id, v): scenarios are numbered for the network operators."""
    s = vecs.select("s").distinct().agg(F.array_sort(F.collect_set("s")).alias("all"))
    coded = vecs.crossJoin(s).withColumn("t", ((F.array_position("all", F.col("s")) - 1) * SPAN + F.col("t")).cast("int"))
    edges = net.knn_edges(coded.select("t", "id", "v"), k).crossJoin(s)
    return edges.select(F.element_at("all", F.floor(F.col("t") / SPAN).cast("int") + 1).alias("s"), F.pmod("t", F.lit(SPAN)).cast("int").alias("t"), "src", "dst", "w")


def smoothed(edges: DataFrame, alpha: Column, n_periods: int) -> DataFrame:
    """As network.smoothed() for (s, t, src, dst, w) with a column for alpha. Edges meet before they are spread over the later periods, so no shuffle has them spread."""
    seen = edges.groupBy("s", "src", "dst").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("u"), "w", alpha.cast("double").alias("alpha")))).alias("seen"))
    spread = seen.withColumn("t", F.explode(F.sequence(F.col("seen")[0]["u"], F.lit(n_periods - 1))))
    t = F.col("t")
    weight = lambda x: F.when(x["u"] == 0, F.pow(x["alpha"], t)).otherwise((1 - x["alpha"]) * F.pow(x["alpha"], t - x["u"]))
    w = F.aggregate("seen", F.lit(0.0), lambda total, x: total + F.when(x["u"] <= t, weight(x) * x["w"]).otherwise(0.0))
    return spread.select("s", "t", "src", "dst", w.alias("w")).filter("w > 0")


def _key() -> Column:
    return F.concat_ws("|", "s", F.col("t").cast("string"))


def _split(labels: DataFrame) -> DataFrame:
    parts = F.split("g", r"\|")
    return labels.select(parts[0].alias("s"), parts[1].cast("int").alias("t"), "id", "label")


def path(vecs: DataFrame, edges: DataFrame, k: int, alpha: Column, n_periods: int, seed: int = 42, assign: str = "kmeans") -> DataFrame:
    """(s, t, id, type): smooth, cluster every period, hand names on."""
    s = smoothed(edges, alpha, n_periods).withColumn("g", _key())
    nodes = vecs.withColumn("g", _key()).select("g", "id", "v")
    return clu.handed_on(saved(_split(clu.spectral(nodes, s, k, seed, assign))), k)


def modal_types(types: DataFrame) -> DataFrame:
    """(s, id, modal), ties to the latest."""
    return lab.modal_latest(types.select(F.struct("s", "id").alias("entity"), "t", "type")).select("entity.s", "entity.id", "modal")


def against(types: DataFrame, base: DataFrame) -> DataFrame:
    """(g, a, b): modal types of each scenario beside those of the base (id, base)."""
    return modal_types(types).join(base, "id").select(F.col("s").alias("g"), F.col("base").alias("a"), F.col("modal").alias("b"))


def retention(types: DataFrame) -> DataFrame:
    """(s, retention): share of steps that keep the type."""
    steps = lab.steps(types.select(F.struct("s", "id").alias("entity"), "t", "type"))
    return steps.groupBy(F.col("entity.s").alias("s")).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("retention"))


def subsamples(vecs: DataFrame, share: float, repeats: int, seed: int = 42) -> DataFrame:
    """(s, t, id, v): in each repeat the same share of the entities, those whose hash with the repeat is smallest."""
    ids = vecs.select("id").distinct()
    n = ids.agg(F.round(F.count("*") * share).alias("m"))
    drawn = ids.crossJoin(n).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("id", "s", F.lit(seed)), "id"))
    drawn = drawn.withColumn("r", rank).filter("r <= m").select("id", F.format_string("%03d", "s").alias("s"))
    return vecs.drop("s").join(drawn, "id").select("s", "t", "id", "v")


def _drawn(vecs: DataFrame, share: float, repeats: int, seed: int = 42) -> list[tuple[int, int, int]]:
    """(repeat, hash, id) of the last entity that subsamples() draws in each repeat: one is drawn if its hash and id are no larger."""
    ids = vecs.select("id").distinct()
    n = ids.agg(F.round(F.count("*") * share).alias("m"))
    drawn = ids.crossJoin(n).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("h", F.xxhash64("id", "s", F.lit(seed)))
    last = drawn.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("h", "id"))).filter("r = m")
    return sorted((r["s"], r["h"], r["id"]) for r in last.select("s", "h", "id").collect())


def _each(rows: DataFrame, repeats: list[tuple[int, int, int]]) -> DataFrame:
    """``rows`` once for each repeat x (s, h, id)."""
    x = (F.struct(F.lit(s).cast("int").alias("s"), F.lit(h).cast("long").alias("h"), F.lit(i).cast("long").alias("id")) for s, h, i in repeats)
    return rows.withColumn("x", F.explode(F.array(*x)))


def _inside(i: Column, seed: int = 42) -> Column:
    h = F.xxhash64(i, F.col("x.s"), F.lit(seed))
    return (h < F.col("x.h")) | ((h == F.col("x.h")) & (i <= F.col("x.id")))


def _name() -> Column:
    return F.format_string("%03d", "x.s").alias("s")


class Neighbours:
    """The nearest neighbours of all entities, longer lists than k: those within a subsample are the first k of each list that are drawn.

    Where a list cut off at its length holds fewer, its period of its repeat is sought anew, so the edges are those of knn() on the subsample.
    """

    def __init__(self, vecs: DataFrame, k: int, share: float) -> None:
        self.vecs, self.k, self.n = vecs, k, k + math.ceil((2 / share - 1) * k) + SPARE
        best = net.nearest(vecs.select("t", "id", "v"), self.n)
        self.lists = saved(best.groupBy("t", "i").agg(F.array_sort(F.collect_list(F.struct("rank", "j", "s"))).alias("near")))

    def part(self, repeats: list[tuple[int, int, int]]) -> DataFrame:
        """(s, t, id, v) of the subsamples."""
        return _each(self.vecs.drop("s"), repeats).filter(_inside(F.col("id"))).select(_name(), F.col("t").cast("int").alias("t"), "id", "v")

    def edges(self, repeats: list[tuple[int, int, int]]) -> DataFrame:
        """(s, t, src, dst, w) of the subsamples' networks."""
        lists = _each(self.lists, repeats).filter(_inside(F.col("i")))
        lists = lists.select(_name(), "t", "i", F.size("near").alias("n"), F.filter("near", lambda y: _inside(y["j"])).alias("near"))
        short = lists.filter((F.size("near") < self.k) & (F.col("n") >= self.n)).select("s", "t").distinct().collect()
        best = lists.select(F.struct("s", "t").alias("t"), "i", F.explode(F.slice("near", 1, self.k)).alias("y")).select("t", "i", "y.j", "y.s")
        edges = net.symmetric(best).select("t.s", "t.t", "src", "dst", "w")
        if not short:
            return edges
        again = self.vecs.sparkSession.createDataFrame([(r["s"], r["t"]) for r in short], "s string, t int")
        return edges.join(again, ["s", "t"], "left_anti").unionByName(knn(self.part(repeats).join(again, ["s", "t"], "left_semi"), self.k))


def subsample_stability(vecs: DataFrame, base: DataFrame, k: int, knn_k: int, alpha: float, n_periods: int, share: float = 0.8, repeats: int = 20) -> tuple[DataFrame, DataFrame]:
    """ARI of each repeat with the base types, and a summary of the best Jaccard similarities of each base type.

    As many repeats run at once as have about ROWS vectors, one at least; what they shuffled is given up before the next ones.
    """
    collected(vecs.sparkSession)
    near = Neighbours(vecs, knn_k, share)
    drawn = _drawn(vecs, share, repeats)
    collected(vecs.sparkSession)
    at_once = max(1, int(ROWS / max(1.0, vecs.count() * share)))
    parts = []
    for i in range(0, len(drawn), at_once):
        some = drawn[i : i + at_once]
        types = path(near.part(some), near.edges(some), k, F.lit(alpha), n_periods)
        parts.append(saved(against(types, base)))
        if i + at_once < len(drawn):
            del types
            collected(vecs.sparkSession)
    pairs = reduce(DataFrame.unionByName, parts) if parts else base.sparkSession.createDataFrame([], "g string, a int, b int")
    j = val.best_jaccard(pairs).groupBy(F.col("a").alias("type")).agg(F.avg("jaccard").alias("mean"), F.min("jaccard").alias("least"), F.avg((F.col("jaccard") >= 0.75).cast("double")).alias("often"))
    return val.adjusted_rand(pairs), j.withColumn("verdict", val.verdict(F.col("mean")))


def k_choice(vecs: DataFrame, mean_edges: DataFrame, ks: list[int], share: float = 0.8, repeats: int = 30) -> DataFrame:
    """(k, ari_mean, ari_least, worst_jaccard, min_size): agreement of the clusters of subgraphs of the mean graph with those of the whole."""
    nodes = vecs.select("id").distinct().withColumn("v", F.array(F.lit(0.0)))
    drawn = saved(subsamples(nodes.select("id", "v", F.lit(0).alias("t")), share, repeats).select("s", "id", "v"))
    inside = saved(mean_edges.join(drawn.select("s", F.col("id").alias("src")), "src").join(drawn.select("s", F.col("id").alias("dst")), ["s", "dst"]))
    full = saved(clu.spectral_each(nodes.withColumn("g", F.lit("all")), mean_edges.withColumn("g", F.lit("all")), ks).select("id", "k", F.col("label").alias("a")))
    part = clu.spectral_each(drawn.withColumn("g", F.col("s")), inside.withColumn("g", F.col("s")), ks)
    pairs = saved(part.join(full, ["id", "k"]).select(F.concat_ws("|", F.col("k").cast("string"), "g").alias("g"), "a", F.col("label").alias("b")))
    of = F.split("g", r"\|")[0].cast("int").alias("k")
    ari = val.adjusted_rand(pairs).groupBy(of).agg(F.avg("ari").alias("ari_mean"), F.min("ari").alias("ari_least"))
    worst = val.best_jaccard(pairs).groupBy("g").agg(F.min("jaccard").alias("j")).groupBy(of).agg(F.avg("j").alias("worst_jaccard"))
    size = full.groupBy("k", "a").count().groupBy("k").agg(F.min("count").alias("min_size"))
    return ari.join(worst, "k").join(size, "k").select("ari_mean", "ari_least", "worst_jaccard", "min_size", "k")


def compared(types: DataFrame, base: DataFrame) -> DataFrame:
    """(s, ari, retention)."""
    return val.adjusted_rand(against(types, base)).withColumnRenamed("g", "s").join(retention(types), "s")
