"""Profiles of types: means, lifts, composition, exemplars, boundary cases, regions, twins, documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.functions.columns import safe


def type_profiles(rows: DataFrame, columns: list[str], by: str = "type") -> DataFrame:
    """(type, columns): means by type, and over all rows in the row whose type is null."""
    return rows.rollup(by).agg(*(F.avg(c).alias(c) for c in columns))


def lift(rows: DataFrame, columns: list[str], by: str = "type") -> DataFrame:
    """(type, feature, lift): a type's mean over the mean of all rows."""
    p = type_profiles(rows.filter(F.col(by).isNotNull()), columns, by)
    long = p.unpivot([by], columns, "feature", "m")
    everyone = long.filter(F.col(by).isNull()).select("feature", F.col("m").alias("all"))
    return long.filter(F.col(by).isNotNull()).join(everyone, "feature").select(by, "feature", safe(F.col("m"), F.col("all")).alias("lift"))


def lift_extremes(lifts: DataFrame, n: int = 3, above: float = 1.02, below: float = 0.98, by: str = "type") -> DataFrame:
    """(type, side, rank, feature, lift): the n largest lifts over ``above`` and smallest under ``below``."""
    out = []
    for side, keep, order in (("high", F.col("lift") > above, F.desc("lift")), ("low", F.col("lift") < below, F.asc("lift"))):
        rank = F.row_number().over(Window.partitionBy(by).orderBy(order, "feature"))
        out.append(lifts.filter(keep).withColumn("rank", rank).filter(F.col("rank") <= n).select(by, F.lit(side).alias("side"), "rank", "feature", "lift"))
    return out[0].unionByName(out[1])


def composition(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, percent): the cross table, normalised by a."""
    n = rows.filter(F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def top_values(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """(by, value, n, rank): the n most frequent values, by name at a tie."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def global_z(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores over all rows by the sample standard deviation."""
    stats = rows.agg(*(x for c in columns for x in (F.avg(c).alias(f"_{c}m"), F.stddev_samp(c).alias(f"_{c}s"))))
    return rows.crossJoin(stats).withColumns({c: safe(F.col(c) - F.col(f"_{c}m"), F.col(f"_{c}s")) for c in columns}).drop(*(f"_{c}{x}" for c in columns for x in "ms"))


def centre_distance(rows: DataFrame, summary: DataFrame, columns: list[str]) -> DataFrame:
    """summary (entity, modal, ...) with ``distance`` from the entity's mean z-vector to that of its modal type; rows are (entity, type, columns)."""
    z = global_z(rows, columns)
    own = z.groupBy("entity").agg(*(F.avg(c).alias(f"e_{c}") for c in columns))
    centre = z.groupBy(F.col("type").alias("modal")).agg(*(F.avg(c).alias(f"t_{c}") for c in columns))
    gap = sum((F.pow(F.col(f"e_{c}") - F.col(f"t_{c}"), 2) for c in columns), F.lit(0.0))
    return summary.join(own, "entity").join(centre, "modal").withColumn("distance", F.sqrt(gap)).select(*summary.columns, "distance")


def smallest(rows: DataFrame, by: str, n: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def exemplars(measured: DataFrame, n: int = 8, most_changes: int = 0) -> DataFrame:
    """Of each modal type the n entities nearest its centre that never changed type, or at most ``most_changes`` times."""
    return smallest(measured.filter(F.col("n_changes") <= most_changes), "modal", n, "distance", "entity")


def boundary_cases(summary: DataFrame, n: int = 3) -> DataFrame:
    return smallest(summary, "modal", n, "share", "entity")


def in_region(rows: DataFrame, region: str, text: str) -> DataFrame:
    """Rows whose region contains the text; null does not."""
    return rows.filter(F.coalesce(F.contains(F.col(region), F.lit(text)), F.lit(False)))


def _nearest_other(n: int):
    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, own = table["id"].to_numpy(), table["block"].to_numpy() == key[0].as_py()
        region = np.array([x or "" for x in table["region"].to_pylist()])
        x = np.stack(table["v"].to_numpy())
        left, right = np.flatnonzero(own), np.flatnonzero(own if key[0].as_py() == key[1].as_py() else ~own)
        right = right[np.argsort(ids[right], kind="stable")]
        a, b, d = [], [], []
        for lo in range(0, len(left), 64):
            some = left[lo : lo + 64]
            gap = x[some, None, :] - x[right][None, :, :]
            d2 = (gap * gap).sum(axis=2)
            d2[region[some][:, None] == region[right][None, :]] = np.inf
            top = np.argsort(d2, axis=1, kind="stable")[:, :n]
            w = np.take_along_axis(d2, top, 1)
            ok = np.isfinite(w)
            a.append(np.repeat(ids[some], top.shape[1])[ok.ravel()])
            b.append(ids[right][top][ok])
            d.append(w[ok])
        return pa.table({"id": pa.array(np.concatenate(a), pa.int64()), "twin": pa.array(np.concatenate(b), pa.int64()), "d2": pa.array(np.concatenate(d))})

    return cell


def twins(means: DataFrame, n: int = 5, block: int = 2048) -> DataFrame:
    """(id, twin, d2, rank) of (id, region, v): the nearest entities of other regions by squared distance, the smaller id at a tie; a null region is one of its own."""
    blocks = means.agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = means.crossJoin(blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = dealt.select(F.col("block").alias("a"), F.col("o").alias("b"), "block", F.col("id").cast("long").alias("id"), F.col("region").cast("string").alias("region"), "v")
    theirs = dealt.filter("o <> block").select(F.col("o").alias("a"), F.col("block").alias("b"), "block", F.col("id").cast("long").alias("id"), F.col("region").cast("string").alias("region"), "v")
    near = mine.unionByName(theirs).groupBy("a", "b").applyInArrow(_nearest_other(n), "id long, twin long, d2 double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "twin"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= n)


def shared_scale(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """x and y moved to 0 and divided by the span of x, so that shapes keep their proportions."""
    ends = points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"))
    span = F.col("_x1") - F.col("_x0")
    return points.crossJoin(ends).withColumns({x: safe(F.col(x) - F.col("_x0"), span), y: safe(F.col(y) - F.col("_y0"), span)}).drop("_x0", "_x1", "_y0")


def document(entities: DataFrame, types: DataFrame, title: str, months: list[str], features: list[str]) -> DataFrame:
    """One row, one column ``json``: the nested document of the title, months, features, types and entities, both in order of id."""
    e = entities.agg(F.array_sort(F.collect_list(F.struct(*entities.columns))).alias("entities"))
    t = types.agg(F.array_sort(F.collect_list(F.struct(*types.columns))).alias("types"))
    head = F.struct(F.lit(title).alias("title"), F.array(*map(F.lit, months)).alias("months"), F.array(*map(F.lit, features)).alias("features"), "types", "entities")
    return e.crossJoin(t).select(F.to_json(head).alias("json"))
