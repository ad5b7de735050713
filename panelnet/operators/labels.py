"""Types over time: modal types, transitions, events, jumps, margins. A label panel is (entity, t, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _best(counts: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def dominant(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Of each key the most frequent ``kind``, the smallest at a tie, with its count n."""
    return _best(rows.groupBy(*by, kind).agg(F.count("*").alias("n")), by, F.desc("n"), F.col(kind))


def modal(labels: DataFrame) -> DataFrame:
    """(entity, modal): the most frequent type; the smallest at a tie."""
    return dominant(labels, ["entity"], "type").select("entity", F.col("type").alias("modal"))


def modal_latest(labels: DataFrame) -> DataFrame:
    """(entity, modal): the most frequent type; at a tie the one that occurs latest."""
    counts = labels.groupBy("entity", "type").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    return _best(counts, ["entity"], F.desc("n"), F.desc("last")).select("entity", F.col("type").alias("modal"))


def steps(labels: DataFrame) -> DataFrame:
    """(entity, t, a, b): types of an entity in t and t + 1; a gap gives no step."""
    order = Window.partitionBy("entity").orderBy("t")
    nxt = F.lead(F.struct("t", "type")).over(order)
    return labels.withColumn("next", nxt).filter(F.col("next.t") == F.col("t") + 1).select("entity", "t", F.col("type").alias("a"), F.col("next.type").alias("b"))


def entity_summary(labels: DataFrame) -> DataFrame:
    """(entity, modal, share, n_changes, n_types)."""
    share = labels.join(modal(labels), "entity").groupBy("entity", "modal").agg(F.avg((F.col("type") == F.col("modal")).cast("double")).alias("share"), F.count_distinct("type").alias("n_types"))
    moved = steps(labels).groupBy("entity").agg(F.count_if(F.col("a") != F.col("b")).alias("n_changes"))
    return share.join(moved, "entity", "left").select("entity", "modal", "share", F.coalesce("n_changes", F.lit(0)).alias("n_changes"), "n_types")


def core_table(summary: DataFrame) -> DataFrame:
    """(modal, n, mean_share, never_changed)."""
    return summary.groupBy("modal").agg(F.count("*").alias("n"), F.avg("share").alias("mean_share"), F.avg((F.col("n_changes") == 0).cast("double")).alias("never_changed"))


def transitions(labels: DataFrame, types: list[int]) -> DataFrame:
    """(a, b, share): pooled over all steps, rows of the matrix adding to 1; every pair of ``types``; null in a row without members."""
    spark = labels.sparkSession
    grid = spark.createDataFrame([(a, b) for a in types for b in types], "a int, b int")
    n = steps(labels).groupBy("a", "b").agg(F.count("*").alias("n"))
    full = grid.join(n, ["a", "b"], "left").fillna(0, ["n"])
    return full.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("a")), F.lit(0))).select("a", "b", "share")


def type_sizes(labels: DataFrame, types: list[int]) -> DataFrame:
    """(t, n_<type> ...): members of each type, 0 where there are none."""
    return labels.groupBy("t").agg(*(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in types))


def change_rate(labels: DataFrame) -> DataFrame:
    """(t, rate): share of entities whose type in t differs from that in t - 1."""
    return steps(labels).groupBy((F.col("t") + 1).alias("t")).agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("rate"))


def _events(labels: DataFrame, of: str, other: str, share: float, name: str) -> DataFrame:
    n = steps(labels).groupBy("t", "a", "b").agg(F.count("*").alias("n"))
    whole = n.withColumn("whole", F.sum("n").over(Window.partitionBy("t", of)))
    big = whole.filter(F.col("n") >= share * F.col("whole")).groupBy((F.col("t") + 1).alias("t"), F.col(of).alias("type")).agg(F.array_sort(F.collect_list(other)).alias("related"))
    return big.filter(F.size("related") > 1).select("t", F.lit(name).alias("event"), "type", "related")


def splits(labels: DataFrame, share: float = 0.3) -> DataFrame:
    """(t, event, type, related): types of which two or more destinations, staying included, took at least ``share`` each."""
    return _events(labels, "a", "b", share, "split")


def merges(labels: DataFrame, share: float = 0.3) -> DataFrame:
    return _events(labels, "b", "a", share, "merge")


def relabel_by_size(labels: DataFrame) -> DataFrame:
    """(label, type): numbers from 1 by decreasing size; the smaller label first at a tie."""
    n = labels.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n"))
    return n.select("label", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "label")).alias("type"))


def top_jumps(labels: DataFrame, n: int = 3) -> DataFrame:
    """The periods with the largest change rates, the earlier first at a tie."""
    return change_rate(labels).orderBy(F.desc("rate"), "t").limit(n)


def flows(labels: DataFrame, t: int | Column) -> DataFrame:
    """(a, b, n): the cross table of types in t - 1 and t."""
    return steps(labels).filter(F.col("t") == F.lit(t) - 1).groupBy("a", "b").agg(F.count("*").alias("n"))


def top_flows(labels: DataFrame, t: int | Column, n: int = 3) -> DataFrame:
    return flows(labels, t).filter("a <> b").orderBy(F.desc("n"), "a", "b").limit(n)


def feature_change(panel: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """(t, all_entities, movers, stayers): mean absolute change of the features from t - 1 to t."""
    order = Window.partitionBy("entity").orderBy("t")
    gone = sum((F.abs(F.col(c) - F.lag(c).over(order)) for c in columns[1:]), F.abs(F.col(columns[0]) - F.lag(columns[0]).over(order))) / len(columns)
    dz = panel.select("entity", "t", F.lag("t").over(order).alias("was"), gone.alias("dz")).filter("was = t - 1")
    moved = steps(labels).select("entity", (F.col("t") + 1).alias("t"), (F.col("a") != F.col("b")).alias("moved"))
    x = dz.join(moved, ["entity", "t"])
    return x.groupBy("t").agg(F.avg("dz").alias("all_entities"), F.avg(F.when(F.col("moved"), F.col("dz"))).alias("movers"), F.avg(F.when(~F.col("moved"), F.col("dz"))).alias("stayers"))


def margins(panel: DataFrame, labels: DataFrame, columns: list[str], t: int, n: int = 3) -> DataFrame:
    """(a, b, n, movers, stayers) of the largest flows into t: medians of the distance to the centre of b less that to the centre of a, in t - 1."""
    before = panel.filter(F.col("t") == t - 1).select("entity", F.array(*columns).alias("v"))
    moved = steps(labels).filter(F.col("t") == t - 1).select("entity", "a", "b")
    point = before.join(moved, "entity")
    typed = before.join(labels.filter(F.col("t") == t - 1).select("entity", "type"), "entity")
    centre = typed.select("type", F.posexplode("v").alias("f", "x")).groupBy("type", "f").agg(F.avg("x").alias("m"))
    centre = centre.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("c")).select("type", F.transform("c", lambda x: x["m"]).alias("c"))
    big = top_flows(labels, t, n)
    flow = big.join(centre.select(F.col("type").alias("a"), F.col("c").alias("ca")), "a").join(centre.select(F.col("type").alias("b"), F.col("c").alias("cb")), "b")
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    x = point.select("entity", "v", "a", F.col("b").alias("to")).join(flow, "a").withColumn("gap", gap("cb") - gap("ca"))
    return x.groupBy("a", "b", "n").agg(F.median(F.when(F.col("to") == F.col("b"), F.col("gap"))).alias("movers"), F.median(F.when(F.col("to") == F.col("a"), F.col("gap"))).alias("stayers"))


def label_paths(labels: DataFrame) -> DataFrame:
    """(entity, path): the digits of an entity's types in order of time."""
    return labels.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "type"))), lambda x: x["type"].cast("string")), "").alias("path"))


def wide_labels(labels: DataFrame, n_periods: int) -> DataFrame:
    return labels.groupBy("entity").agg(*(F.max(F.when(F.col("t") == t, F.col("type"))).alias(f"t{t}") for t in range(n_periods)))
