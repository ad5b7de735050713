"""From facts to a standardised panel: pivot, completeness, grid, interpolation, shares, attributes, z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.functions.columns import safe, total


def bind(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under the keys' names; a missing one fails with the columns there are."""
    missing = [c for c in columns.values() if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    return df.select(*(F.col(c).alias(k) for k, c in columns.items()))


def exclude(df: DataFrame, categories: Sequence[str], category: str = "category") -> DataFrame:
    return df.filter(~F.col(category).isin(*categories)) if categories else df


def _each(categories: Sequence[str], category: str, value: Column) -> dict[str, Column]:
    return {c.lower(): F.when(F.col(category) == c, value) for c in categories}


def pivot_sum(facts: DataFrame, categories: Sequence[str], entity: str = "entity", time: str = "month") -> DataFrame:
    """A row for each entity and period, a column for each category: the sum; 0 if all its values are null, null if it has no row."""
    sums = [F.sum(x).alias(c) for c, x in _each(categories, "category", F.coalesce("value", F.lit(0.0))).items()]
    return facts.groupBy(entity, time).agg(*sums)


def pivot_mean(facts: DataFrame, categories: Sequence[str], entity: str = "entity", time: str = "month") -> DataFrame:
    """As pivot_sum with means; null if all values are null."""
    return facts.groupBy(entity, time).agg(*(F.avg(x).alias(c) for c, x in _each(categories, "category", F.col("value")).items()))


def sum_wide(df: DataFrame, columns: Sequence[str], entity: str = "entity", time: str = "month") -> DataFrame:
    """Sums of facts that are wide already; null if all values are null."""
    return df.groupBy(entity, time).agg(*(F.sum(c).alias(c) for c in columns))


def unpivot(panel: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("entity", "month")) -> DataFrame:
    return panel.unpivot([*keys], [*columns], "category", "value")


def periods(panel: DataFrame, time: str = "month") -> DataFrame:
    """(time, t): the periods that occur, numbered from 0. Gathered into one array first: there are as many as periods, not as rows."""
    return panel.agg(F.array_sort(F.collect_set(time)).alias("p")).select(F.posexplode("p").alias("t", time))


def coverage(panel: DataFrame, entity: str = "entity", time: str = "month") -> DataFrame:
    return panel.groupBy(entity).agg(F.count("*").alias("n_periods"))


def covered(panel: DataFrame, least: float = 1.0, entity: str = "entity", time: str = "month") -> DataFrame:
    """Entities with rows in at least that share of the periods."""
    of = panel.agg(F.count_distinct(time).alias("n_all"))
    return coverage(panel, entity, time).crossJoin(of).filter(F.col("n_periods") >= least * F.col("n_all")).select(entity)


def complete_grid(panel: DataFrame, least: float = 1.0, entity: str = "entity", time: str = "month") -> DataFrame:
    """Every covered entity in every period, with t; null where the panel has no row."""
    grid = covered(panel, least, entity, time).crossJoin(periods(panel, time))
    return grid.join(panel, [entity, time], "left")


def blank_empty(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose total is not positive become null."""
    ok = total(*map(F.col, columns)) > 0
    return panel.withColumns({c: F.when(ok, F.col(c)) for c in columns})


def interpolate(panel: DataFrame, columns: Sequence[str], limit: int = 2, entity: str = "entity", t: str = "t") -> DataFrame:
    """Fills the first ``limit`` cells of each inner gap on the line between its neighbours; ends stay null."""
    past = Window.partitionBy(entity).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(entity).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    ends = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col(t).alias("t"), F.col(c).alias("v")))
        ends |= {f"_{c}0": F.last(at, True).over(past), f"_{c}1": F.first(at, True).over(future)}
    panel = panel.withColumns(ends)
    filled = {}
    for c in columns:
        a, b = F.col(f"_{c}0"), F.col(f"_{c}1")
        line = a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"])
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNotNull() & (F.col(t) - a["t"] <= limit), line)
    return panel.withColumns(filled).drop(*ends)


def drop_incomplete(panel: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """Without the entities that have a null in any of the columns in any row."""
    hole = F.lit(False)
    for c in columns:
        hole = hole | F.col(c).isNull()
    return panel.join(panel.filter(hole).select(entity).distinct(), entity, "left_anti")


def shares(panel: DataFrame, columns: Sequence[str], total_column: str | None = None) -> DataFrame:
    """Adds c_share for each column, log_total and, with a total column, other_share = max(0, 1 - sum of shares); drops the amounts."""
    parts = [c for c in columns if c != total_column]
    whole = F.col(total_column) if total_column else total(*map(F.col, columns))
    out = panel.withColumns({f"{c}_share": safe(F.col(c), whole) for c in parts} | {"log_total": F.log1p(whole)})
    if total_column:
        out = out.withColumn("other_share", F.greatest(1 - total(*(F.col(f"{c}_share") for c in parts)), F.lit(0.0)))
    return out.drop(*columns)


def percent_shares(panel: DataFrame, columns: Sequence[str], total_column: str) -> DataFrame:
    """Adds c_pct for each column and other_pct = 100 - their sum, which may be negative; keeps the total."""
    parts = [c for c in columns if c != total_column]
    out = panel.withColumns({f"{c}_pct": 100 * safe(F.col(c), F.col(total_column)) for c in parts})
    return out.withColumn("other_pct", 100 - total(*(F.col(f"{c}_pct") for c in parts))).drop(*parts)


def attach_monthly(panel: DataFrame, extra: DataFrame, columns: Sequence[str], limit: int = 2, entity: str = "entity", time: str = "month") -> DataFrame:
    """Adds monthly attributes, repeated rows averaged, short inner gaps interpolated. The panel needs t."""
    mean = extra.groupBy(entity, time).agg(*(F.avg(c).alias(c) for c in columns))
    return interpolate(panel.join(mean, [entity, time], "left"), columns, limit, entity)


def attach_static(panel: DataFrame, static: DataFrame, columns: Sequence[str], log: bool = False, entity: str = "entity") -> DataFrame:
    """Adds attributes of the entities; with ``log`` their natural logarithm, null where not positive."""
    told = static.select(entity, *((F.when(F.col(c) > 0, F.log(c)) if log else F.col(c)).alias(c) for c in columns))
    return panel.join(told, entity, "left")


def without_missing(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the rows that have a null or NaN in any of the columns."""
    return panel.dropna("any", subset=[*columns])


def standardise(panel: DataFrame, columns: Sequence[str], time: str = "month") -> DataFrame:
    """z-scores within each period by the sample standard deviation; 0 where it is 0 or missing.

    Means and deviations come from an aggregate joined back, so that no period's rows meet in one task.
    """
    stats = panel.groupBy(time).agg(*(x for c in columns for x in (F.avg(c).alias(f"_{c}m"), F.stddev_samp(c).alias(f"_{c}s"))))
    z = {c: F.coalesce(safe(F.col(c) - F.col(f"_{c}m"), F.col(f"_{c}s")), F.lit(0.0)) for c in columns}
    return panel.join(stats, time).withColumns(z).drop(*(f"_{c}{x}" for c in columns for x in "ms"))


def ratio_to_median(panel: DataFrame, column: str, out: str, time: str = "month") -> DataFrame:
    """Each value over its period's median."""
    return panel.join(panel.groupBy(time).agg(F.median(column).alias("_median")), time).withColumn(out, safe(F.col(column), F.col("_median"))).drop("_median")


def audit(facts: DataFrame, wide: DataFrame, columns: Sequence[str], least: float = 1.0, entity: str = "entity", time: str = "month") -> DataFrame:
    """(metric, value): rows, entities, periods, covered entities and the share of nulls in each column."""
    counts = {"rows": F.count("*"), "entities": F.count_distinct(entity), "periods": F.count_distinct(time)}
    first = facts.agg(*(x.cast("double").alias(k) for k, x in counts.items()))
    holes = {f"missing_{c}": F.avg(F.col(c).isNull().cast("double")) for c in columns}
    second = wide.agg(F.count("*").cast("double").alias("panel_rows"), *(x.alias(k) for k, x in holes.items()))
    third = covered(wide, least, entity, time).agg(F.count("*").cast("double").alias("covered"))
    row = first.crossJoin(second).crossJoin(third)
    return row.unpivot([], row.columns, "metric", "value")


def latest_version(versions: DataFrame, key: str, until: str, tie: str) -> DataFrame:
    """Of each key the row that is valid longest; a null date is open and wins; ties go to the largest ``tie``."""
    order = Window.partitionBy(key).orderBy(F.col(until).desc_nulls_first(), F.col(tie).desc())
    return versions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
