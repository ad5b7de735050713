"""Queries of clustering, evolution, stability and documents; but for agreement that must be complete they have no oracle: iterative and seeded."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.operators import clustering as clu
from panelnet.operators import labels as lab
from panelnet.operators import network as net
from panelnet.operators import profiles as pro
from panelnet.operators import validity as val
from panelnet.plans import paths
from panelnet.plans import views as v
from panelnet.plans.registry import query, rounded
from panelnet.plans.views import FEATURES, N_PERIODS
from panelnet.storage import saved

ALL = [*FEATURES, "balance"]
K, KNN, ALPHA = 4, 5, 0.5


def _vecs(spark, d):
    """The panel's vectors as scenario ``base``, written once: every rerun reads them."""
    return saved(net.vectors(v.features(spark, d), ALL).select(F.lit("base").alias("s"), "t", "id", "v"))


def _graph(vecs, k=KNN):
    return saved(paths.knn(vecs, k))


def _points(vecs):
    return vecs.select(F.col("t").cast("string").alias("g"), "id", "v")


def _edges(edges):
    return edges.select(F.col("t").cast("string").alias("g"), "src", "dst", "w")


def _base(vecs, edges, assign="kmeans"):
    return saved(paths.path(vecs, edges, K, F.lit(ALPHA), N_PERIODS, assign=assign))


def _base_modal(types):
    return saved(paths.modal_types(types).select("id", F.col("modal").alias("base")))


@query()
def kmeans_labels(spark, d):
    return clu.kmeans(_points(_vecs(spark, d)), K)


@query()
def kmeans_large(spark, d):
    return clu.kmeans_large(v.vectors(spark, d).select("id", "v"), 10)


@query()
def kmeans_scan(spark, d):
    vecs = _vecs(spark, d)
    edges = _edges(_graph(vecs))
    out = []
    for k in range(3, 11):
        points = saved(_points(vecs).join(clu.kmeans(_points(vecs), k), ["g", "id"]))
        b = val.bundle(points, edges)
        out.append(b.agg(*(F.avg(c).alias(c) for c in ("sw", "ch", "s_dbw", "avi", "avu", "q"))).withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, out)


@query()
def spectral_labels(spark, d):
    vecs = _vecs(spark, d)
    return clu.spectral(_points(vecs), _edges(_graph(vecs)), K)


@query()
def louvain_labels(spark, d):
    vecs = _vecs(spark, d)
    return clu.louvain(_points(vecs), _edges(_graph(vecs)))


@query()
def ward_net_labels(spark, d):
    vecs = _vecs(spark, d)
    return clu.ward_net(_points(vecs), _edges(_graph(vecs)), K)


@query()
def run_matrix(spark, d):
    """Mean indices of every method on every graph: (method and graph) x period."""
    vecs = _vecs(spark, d)
    graphs = {"cosine_k5": _edges(_graph(vecs)), "cosine_k10": _edges(_graph(vecs, 10))}
    labels, edges = map(saved, clu.run_matrix(_points(vecs), graphs, list(clu.METHODS), K, "cosine_k5"))
    key = F.concat_ws("#", "config", "g")
    points = labels.join(_points(vecs), ["g", "id"]).select(key.alias("g"), "id", "v", "label")
    b = val.bundle(saved(points), edges.select(key.alias("g"), "src", "dst", "w"))
    numbers = [c for c in b.columns if c != "g"]
    return b.groupBy(F.split("g", "#")[0].alias("config")).agg(*(F.avg(c).alias(c) for c in numbers))


@query()
def evolution_path(spark, d):
    vecs = _vecs(spark, d)
    return _base(vecs, _graph(vecs)).select(F.col("id").alias("entity"), "t", "type")


@query()
def alpha_grid(spark, d):
    """Retention, agreement of neighbouring periods, silhouette and modularity for each weight of history."""
    vecs, grid = _vecs(spark, d), [0.0, 0.3, 0.5, 0.7, 0.85]
    edges = _graph(vecs)
    names = F.explode(F.array(*(F.struct(F.format_string("%.2f", F.lit(a)).alias("s"), F.lit(a).alias("alpha")) for a in grid)))
    many = vecs.drop("s").withColumn("x", names).select("x.s", "t", "id", "v")
    many = saved(many)
    each = saved(edges.drop("s").withColumn("x", names).select("x.s", "t", "src", "dst", "w"))
    types = saved(paths.path(many, each, K, F.col("s").cast("double"), N_PERIODS))
    steps = lab.steps(types.select(F.struct("s", "id").alias("entity"), "t", "type"))
    ari = val.adjusted_rand(steps.select(F.concat_ws("|", "entity.s", F.col("t").cast("string")).alias("g"), "a", "b")).groupBy(F.split("g", r"\|")[0].alias("s")).agg(F.avg("ari").alias("ari"))
    g = F.concat_ws("|", "s", F.col("t").cast("string")).alias("g")
    points = many.join(types, ["s", "t", "id"]).select(g, "id", "v", F.col("type").alias("label"))
    sw = val.silhouette(points).groupBy(F.split("g", r"\|")[0].alias("s")).agg(F.avg("sw").alias("sw"))
    q = val.network_indices(each.select(g, "src", "dst", "w"), points.select("g", "id", "label")).groupBy(F.split("g", r"\|")[0].alias("s")).agg(F.avg("q").alias("q"))
    return paths.retention(types).join(ari, "s").join(sw, "s").join(q, "s")


@query()
def variant_compare(spark, d):
    """The three ways of assigning labels in the spectral embedding: retention, largest jump, its period, agreement with the base."""
    vecs = _vecs(spark, d)
    edges = _graph(vecs)
    runs = {a: _base(vecs, edges, a) for a in ("kmeans", "discretize", "cluster_qr")}
    base, out = _base_modal(runs["kmeans"]), []
    for name, types in runs.items():
        rate = lab.change_rate(types.select(F.col("id").alias("entity"), "t", "type"))
        jump = rate.agg((1 - F.avg("rate")).alias("retention"), F.max("rate").alias("largest"), F.max_by("t", F.struct("rate", -F.col("t"))).alias("at"))
        out.append(jump.crossJoin(val.adjusted_rand(paths.against(types, base)).select("ari")).withColumn("variant", F.lit(name)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def jump_report(spark, d):
    """The largest jump's flows with the margins of movers and stayers."""
    vecs = _vecs(spark, d)
    types = _base(vecs, _graph(vecs)).select(F.col("id").alias("entity"), "t", "type")
    t = lab.top_jumps(types, 1).first()["t"]
    return lab.margins(v.features(spark, d), types, ALL, t)


@query()
def surrogate_tree(spark, d):
    """Accuracy of a shallow tree on the types: trained on 70 % of the entities, tested on the others."""
    vecs = _vecs(spark, d)
    types = _base(vecs, _graph(vecs)).select(F.col("id").alias("entity"), "t", F.col("type").cast("double").alias("type"))
    rows = v.features(spark, d).join(types, ["entity", "t"])
    rows = rows.withColumn("test", F.pmod(F.xxhash64("entity", F.lit(42)), F.lit(10)) < 3)
    rows = saved(rows.select("type", "test", *ALL))
    rows = VectorAssembler(inputCols=ALL, outputCol="x").transform(rows)
    model = DecisionTreeClassifier(labelCol="type", featuresCol="x", maxDepth=3, minInstancesPerNode=5, seed=42).fit(rows.filter("not test"))
    right = model.transform(rows).groupBy("test").agg(F.avg((F.col("prediction") == F.col("type")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    importance = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(float(x)).alias("importance")) for c, x in zip(ALL, model.featureImportances.toArray(), strict=True)))
    return right.withColumns({"importance": F.to_json(importance), "rules": F.lit(model.toDebugString)})


@query()
def subsample_stability(spark, d):
    vecs = _vecs(spark, d)
    base = _base_modal(_base(vecs, _graph(vecs)))
    ari, jaccard = paths.subsample_stability(vecs, base, K, KNN, ALPHA, N_PERIODS)
    return jaccard.crossJoin(ari.agg(F.avg("ari").alias("ari_mean"), F.min("ari").alias("ari_least")))


@query()
def k_choice(spark, d):
    vecs = _vecs(spark, d)
    mean = saved(net.mean_graph(_graph(vecs), F.lit(N_PERIODS)))
    return paths.k_choice(vecs, mean, list(range(3, 11)), repeats=30)


@query()
def sensitivity(spark, d):
    """Agreement with the base types for other numbers of neighbours, weights of history and seeds."""
    vecs = _vecs(spark, d)
    edges = _graph(vecs)
    base = _base_modal(_base(vecs, edges))
    named = lambda name: vecs.withColumn("s", F.lit(name))
    runs = [paths.path(named(f"k={k}"), paths.knn(named(f"k={k}"), k), K, F.lit(ALPHA), N_PERIODS) for k in (10, 15, 20)]
    runs += [paths.path(named(f"alpha={a}"), edges.withColumn("s", F.lit(f"alpha={a}")), K, F.lit(a), N_PERIODS) for a in (0.3, 0.5, 0.7)]
    runs += [paths.path(named(f"seed={s}"), edges.withColumn("s", F.lit(f"seed={s}")), K, F.lit(ALPHA), N_PERIODS, seed=s) for s in range(1, 6)]
    return paths.compared(saved(reduce(DataFrame.unionByName, runs)), base)


@query()
def drop_feature(spark, d):
    """Agreement with the base types when one feature is left out."""
    vecs = _vecs(spark, d)
    base = _base_modal(_base(vecs, _graph(vecs)))
    without = F.explode(F.array(*(F.struct(F.lit(c).alias("s"), F.lit(i).alias("i")) for i, c in enumerate(ALL))))
    part = vecs.drop("s").withColumn("x", without).select("x.s", "t", "id", F.filter("v", lambda _, i: i != F.col("x.i")).alias("v"))
    part = saved(part)
    types = saved(paths.path(part, paths.knn(part, KNN), K, F.lit(ALPHA), N_PERIODS))
    pairs = paths.against(types, base)
    worst = val.best_jaccard(pairs).groupBy("g").agg(F.min_by("a", F.struct("jaccard", "a")).alias("worst_type"), F.min("jaccard").alias("worst_jaccard"))
    return val.adjusted_rand(pairs).join(worst, "g").withColumnRenamed("g", "feature")


@query()
def half_period(spark, d):
    """Agreement of the types of the two halves of the period with each other and with the base."""
    vecs = _vecs(spark, d)
    base = _base_modal(_base(vecs, _graph(vecs)))
    half = N_PERIODS // 2
    part = saved(vecs.withColumn("s", F.when(F.col("t") < half, "first").otherwise("second")).withColumn("t", F.pmod("t", F.lit(half))))
    types = saved(paths.path(part, paths.knn(part, KNN), K, F.lit(ALPHA), half))
    own = paths.modal_types(types)
    both = own.filter("s = 'first'").select("id", F.col("modal").alias("a")).join(own.filter("s = 'second'").select("id", F.col("modal").alias("b")), "id").select(F.lit("between").alias("g"), "a", "b")
    return val.adjusted_rand(paths.against(types, base).unionByName(both)).withColumnRenamed("g", "pair")


@query("SELECT 1.0::DOUBLE AS ari")
def self_check(spark, d):
    """The base types, computed twice: agreement is 1."""
    vecs = _vecs(spark, d)
    edges = _graph(vecs)
    return val.adjusted_rand(paths.against(_base(vecs, edges), _base_modal(_base(vecs, edges)))).select("ari")


@query()
def json_document(spark, d):
    """The nested document of types and entities."""
    vecs = _vecs(spark, d)
    types = _base(vecs, _graph(vecs)).select(F.col("id").alias("entity"), "t", "type")
    summary = lab.entity_summary(types).join(lab.label_paths(types), "entity").select(F.col("entity").alias("id"), "modal", F.round("share", 3).alias("share"), "n_changes", "path")
    kinds = lab.core_table(lab.entity_summary(types)).select(F.col("modal").alias("id"), "n", F.round("mean_share", 3).alias("share"))
    months = [f"{1996 + m // 12}-{m % 12 + 1:02d}" for m in range(N_PERIODS)]
    return pro.document(summary, kinds, "Types of suppliers", months, ALL)


@query()
def type_lift_found(spark, d):
    """Lifts of the found types over raw features."""
    vecs = _vecs(spark, d)
    types = _base(vecs, _graph(vecs)).select(F.col("id").alias("entity"), "t", "type")
    return rounded(pro.lift(v.features(spark, d).join(types, ["entity", "t"]).withColumn("share_up", F.col("a_share") + 10), ["share_up"]), ["lift"])
