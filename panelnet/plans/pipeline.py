"""The steps in order over one session: panel, network, clusters, types, dynamics, profiles, stability. Each step's tables are written before the next begins.

    python -m panelnet.plans.pipeline config.yaml --from network --to dynamics
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelnet import config
from panelnet.functions.columns import month_of
from panelnet.operators import clustering as clu
from panelnet.operators import labels as lab
from panelnet.operators import network as net
from panelnet.operators import panel as pan
from panelnet.operators import profiles as pro
from panelnet.operators import validity as val
from panelnet.plans import export, paths
from panelnet.sources.tables import load_table, without_nan
from panelnet.storage import saved


def panel(spark: SparkSession, c: config.Pipeline) -> dict[str, DataFrame]:
    p = c.panel
    raw = without_nan(load_table(spark, c.facts))
    if p.format == "long":
        facts = pan.bind(raw, entity=p.entity, month=p.month, category=p.category, value=p.value).withColumn("month", month_of(F.col("month"), p.month_kind))
        facts = pan.exclude(facts, p.exclude_categories)
        names = sorted(r[0] for r in export.small(facts.select("category").distinct()))
        wide = pan.pivot_sum(facts, names)
    else:
        names = [x for x in p.wide_categories if x not in p.exclude_categories]
        facts = raw.withColumns({"entity": F.col(p.entity), "month": month_of(F.col(p.month), p.month_kind)})
        wide = pan.sum_wide(pan.bind(facts, entity="entity", month="month", **{x: x for x in names}), names)
    columns = [x.lower() for x in names] if p.format == "long" else names
    total = p.total_category.lower() if p.total_category else None
    if total and total not in columns:
        raise ValueError(f"no category {p.total_category} among {names}")
    full = pan.interpolate(pan.blank_empty(pan.complete_grid(wide, p.min_month_coverage), columns), columns, p.max_interp_gap)
    feat = pan.shares(pan.drop_incomplete(full, columns), columns, total)
    if c.static and p.static_columns:
        feat = pan.attach_static(feat, load_table(spark, c.static).withColumnRenamed(p.entity, "entity"), p.static_columns, p.static_log)
    own = [x for x in feat.columns if x not in ("entity", "month", "t")]
    feat = pan.without_missing(feat, own)
    return {"audit": pan.audit(facts, wide, columns, p.min_month_coverage), "features": pan.standardise(feat, own) if p.standardize == "per_month" else feat}


def _features(spark: SparkSession, c: config.Pipeline) -> tuple[DataFrame, list[str], int]:
    feat = spark.read.parquet(f"{c.out}/features")
    columns = [x for x in feat.columns if x not in ("entity", "month", "t")]
    return feat, columns, feat.agg(F.max("t")).first()[0] + 1


def network(spark: SparkSession, c: config.Pipeline) -> dict[str, DataFrame]:
    feat, columns, n = _features(spark, c)
    ks = sorted({c.network.k, c.network.k_alt})
    moving = [r["feature"] for r in export.small(net.time_varying(feat, columns).filter("varies"))]
    out = []
    if "cosine" in c.network.rules:
        out.append(net.knn_sweep(net.vectors(feat, columns), ks, "cosine"))
    if "corr" in c.network.rules:
        out.append(net.knn_sweep(net.change_windows(net.changes(feat, moving), moving, c.network.window, n), ks, "corr", centre=True))
    if "lag" in c.network.rules:
        best = saved(net.lag_nearest(net.lagged_series(net.changes(feat, moving), moving), c.network.max_lag, max(ks)))
        out += [net.symmetric(best, k).select(F.lit("lag").alias("rule"), F.lit(k).alias("k"), "*") for k in ks]
    if "geo" in c.network.rules:
        members = feat.select(F.col("entity").cast("long").alias("entity")).distinct()
        dist = saved(net.distances(load_table(spark, c.connection), c.network.geo_type, members))
        out += [net.symmetric(net.ranked(net.geo_similarity(dist, k), k)).select(F.lit("geo").alias("rule"), F.lit(k).alias("k"), "*") for k in ks]
    while len(out) > 1:
        out[:2] = [out[0].unionByName(out[1])]
    return {"edges": out[0]}


def clusters(spark: SparkSession, c: config.Pipeline) -> dict[str, DataFrame]:
    """Labels of every method on the cosine graph of every period, and their indices; the edges' rule decides the graph."""
    feat, columns, _ = _features(spark, c)
    points = saved(net.vectors(feat, columns).select(F.col("t").cast("string").alias("g"), "id", "v"))
    all_edges = spark.read.parquet(f"{c.out}/edges").filter("rule = 'cosine'")
    graphs = {f"cosine_k{k}": all_edges.filter(F.col("k") == k).select(F.col("t").cast("string").alias("g"), "src", "dst", "w") for k in sorted({c.network.k, c.network.k_alt})}
    labels, edges = map(saved, clu.run_matrix(points, graphs, list(c.dynamics.methods), c.dynamics.n_clusters, f"cosine_k{c.network.k}", c.dynamics.seed))
    key = F.concat_ws("#", "config", "g").alias("g")
    scored = val.bundle(saved(labels.join(points, ["g", "id"]).select(key, "id", "v", "label")), edges.select(key, "src", "dst", "w"))
    parts = F.split("g", "#")
    return {"cluster_labels": labels, "indices": scored.select(parts[0].alias("config"), parts[1].cast("int").alias("t"), *(x for x in scored.columns if x != "g"))}


def types(spark: SparkSession, c: config.Pipeline) -> dict[str, DataFrame]:
    feat, columns, n = _features(spark, c)
    vecs = net.vectors(feat, columns).select(F.lit("base").alias("s"), "t", "id", "v")
    edges = spark.read.parquet(f"{c.out}/edges").filter((F.col("rule") == "cosine") & (F.col("k") == c.network.k)).select(F.lit("base").alias("s"), "t", "src", "dst", "w")
    d = c.dynamics
    raw = paths.path(vecs, edges, d.n_clusters, F.lit(d.alpha), n, d.seed).select(F.col("id").alias("entity"), "t", "type")
    order = lab.relabel_by_size(raw)
    return {"labels": raw.withColumnRenamed("type", "label").join(order, "label").select("entity", "t", "type")}


def dynamics(spark: SparkSession, c: config.Pipeline) -> dict[str, DataFrame]:
    labels, kinds = spark.read.parquet(f"{c.out}/labels"), list(range(1, c.dynamics.n_clusters + 1))
    events = lab.splits(labels, c.dynamics.event_share).unionByName(lab.merges(labels, c.dynamics.event_share))
    return {"summary": lab.entity_summary(labels), "transitions": lab.transitions(labels, kinds), "sizes": lab.type_sizes(labels, kinds), "changes": lab.change_rate(labels), "events": events}


def profiles(spark: SparkSession, c: config.Pipeline) -> dict[str, DataFrame]:
    feat, columns, _ = _features(spark, c)
    typed = feat.join(spark.read.parquet(f"{c.out}/labels"), ["entity", "t"])
    measured = pro.centre_distance(typed, spark.read.parquet(f"{c.out}/summary").drop("n_types"), columns)
    return {"type_profiles": pro.type_profiles(typed, columns), "exemplars": pro.exemplars(measured), "boundary_cases": pro.boundary_cases(measured)}


def stability(spark: SparkSession, c: config.Pipeline) -> dict[str, DataFrame]:
    feat, columns, n = _features(spark, c)
    vecs = saved(net.vectors(feat, columns).select(F.lit("base").alias("s"), "t", "id", "v"))
    base = saved(lab.modal_latest(spark.read.parquet(f"{c.out}/labels")).select(F.col("entity").cast("long").alias("id"), F.col("modal").alias("base")))
    d = c.dynamics
    ari, jaccard = paths.subsample_stability(vecs, base, d.n_clusters, c.network.k, d.alpha, n, d.subsample_share, d.subsample_repeats)
    return {"stability_ari": ari, "stability_types": jaccard}


STEPS = {"panel": panel, "network": network, "clusters": clusters, "types": types, "dynamics": dynamics, "profiles": profiles, "stability": stability}


def run(spark: SparkSession, c: config.Pipeline, first: str | None = None, last: str | None = None) -> list[str]:
    """Runs the steps from ``first`` to ``last``; the first failure ends the run."""
    names = list(STEPS)
    chosen = names[names.index(first or names[0]) : names.index(last or names[-1]) + 1]
    for name in chosen:
        began = time.time()
        for table, df in STEPS[name](spark, c).items():
            if table == "edges":
                export.write_edges(df, f"{c.out}/edges")
            else:
                df.write.mode("overwrite").parquet(f"{c.out}/{table}")
        print(f"{name}: {time.time() - began:.1f} s", flush=True)
    return chosen


def main() -> None:
    import yaml

    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("config")
    args.add_argument("--from", dest="first", choices=list(STEPS))
    args.add_argument("--to", dest="last", choices=list(STEPS))
    a = args.parse_args()
    with open(a.config, encoding="utf-8") as file:
        c = config.Pipeline.of(yaml.safe_load(file))
    run(SparkSession.builder.appName("panelnet").getOrCreate(), c, a.first, a.last)


if __name__ == "__main__":
    main()
