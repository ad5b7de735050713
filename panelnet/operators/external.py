"""External indicators: matching territory codes, indicators by entity, comparison of groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.functions.columns import code8, safe
from panelnet.operators import validity


def read_values(rows: DataFrame) -> DataFrame:
    """All-string indicator rows with ``value`` as a number and ``year`` as an integer; rows whose value is no number go."""
    return rows.withColumns({"value": F.expr("try_cast(indicator_value as double)"), "year": F.expr("try_cast(year as int)")}).filter("value is not null and not isnan(value)")


def code_table(dictionary: DataFrame, members: DataFrame) -> DataFrame:
    """(code8, entity) from dictionary (entity, code): codes of members that belong to one entity only."""
    codes = dictionary.join(members.select("entity").distinct(), "entity", "left_semi").select(code8(F.col("code")).alias("code8"), "entity").distinct()
    return codes.withColumn("_n", F.count("*").over(Window.partitionBy("code8"))).filter("_n = 1").drop("_n")


def ambiguous_codes(dictionary: DataFrame, members: DataFrame) -> DataFrame:
    codes = dictionary.join(members.select("entity").distinct(), "entity", "left_semi").select(code8(F.col("code")).alias("code8"), "entity").distinct()
    return codes.groupBy("code8").agg(F.count("*").alias("n")).filter("n > 1")


def attach(rows: DataFrame, codes: DataFrame, code: str = "code", stable: str = "stable") -> DataFrame:
    """Rows with the entity of their code, else of their stable code; unmatched rows go."""
    a = codes.select(F.col("code8").alias(code), F.col("entity").alias("_a"))
    b = codes.select(F.col("code8").alias(stable), F.col("entity").alias("_b"))
    out = rows.join(a, code, "left").join(b, stable, "left").withColumn("entity", F.coalesce("_a", "_b"))
    return out.filter("entity is not null").drop("_a", "_b")


def of_period(rows: DataFrame, year: int, period: str | None = None, period_col: str = "indicator_period") -> DataFrame:
    """Rows of one year and, if given, of one period in it; a null year or period is of none."""
    rows = rows.filter(F.col("year") == year)
    return rows if period is None else rows.filter(F.col(period_col) == period)


def jobs_per_100(jobs: DataFrame, population: DataFrame) -> DataFrame:
    """(entity, jobs_per_100) from (entity, jobs) and (entity, population): null without either or without residents."""
    both = population.select("entity", "population").join(jobs.select("entity", "jobs"), "entity", "left")
    return both.select("entity", (100 * safe(F.col("jobs"), F.col("population"))).alias("jobs_per_100"))


def urban_share(population: DataFrame, members: DataFrame, everyone: str, urban: str) -> DataFrame:
    """(entity, population, urban_share) from rows (entity, place, value): percent; no urban row counts as 0 where the population is known."""
    p = population.groupBy("entity").agg(F.sum(F.when(F.col("place") == everyone, F.col("value"))).alias("population"), F.sum(F.when(F.col("place") == urban, F.col("value"))).alias("urban"))
    return members.select("entity").join(p, "entity", "left").select("entity", "population", F.when(F.col("population").isNotNull(), 100 * safe(F.coalesce("urban", F.lit(0.0)), F.col("population"))).alias("urban_share"))


def section_shares(jobs: DataFrame, sections: list[str]) -> DataFrame:
    """(entity, jobs, s_<section> ...) from rows (entity, section, value): percent of the section ALL; null without rows."""
    of = lambda s: F.sum(F.when(F.col("section") == s, F.col("value")))
    whole = jobs.groupBy("entity").agg(of("ALL").alias("jobs"), *(of(s).alias(f"s_{s}") for s in sections))
    return whole.select("entity", "jobs", *((100 * safe(F.col(f"s_{s}"), F.col("jobs"))).alias(f"s_{s}") for s in sections))


def weighted_mean(rows: DataFrame, weights: DataFrame, key: str = "code") -> DataFrame:
    """(entity, mean) of rows (entity, key, value) by weights (key, n); a missing weight is 1."""
    x = rows.join(weights.select(key, "n"), key, "left").withColumn("n", F.coalesce("n", F.lit(1.0)))
    return x.groupBy("entity").agg(safe(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("mean"))


def medians(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, columns): exact medians by group, and over all rows in the row whose group is null."""
    grouped = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(*(F.median(c).alias(c) for c in columns))
    return grouped.unionByName(rows.agg(*(F.median(c).alias(c) for c in columns)).withColumn(by, F.lit(None).cast(rows.schema[by].dataType)))


def compare(table: DataFrame, group: str, columns: list[str], least_share: float = 0.5) -> DataFrame:
    """validity.kruskal() of each column by the group."""
    return validity.kruskal(table.unpivot([group], columns, "g", "x").select("g", F.col(group).alias("grp"), "x"), least_share)


def side_by_side(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(g, n, and for each of the two tables of effects its k, h and epsilon2, suffixed by its name): indicators that both have."""
    told = lambda df, name: df.select("g", *(F.col(c).alias(f"{c}_{name}") for c in ("k", "h", "epsilon2")))
    return first.select("g", "n").join(told(first, names[0]), "g").join(told(second, names[1]), "g")


def two_levels(table: DataFrame, level: str, macro: str, columns: list[str], least_share: float = 0.5) -> DataFrame:
    """compare() of each column by the groups of a level and by the groups of groups, side by side."""
    return side_by_side(compare(table, level, columns, least_share), compare(table, macro, columns, least_share), (level, macro))


def with_p(effects: DataFrame) -> DataFrame:
    """Effects (one row an indicator) with the p value of H, by a pandas UDF over this small table."""
    @F.pandas_udf("double")
    def tail(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else validity.chi2_tail(float(x), int(n) - 1) for x, n in zip(h, k, strict=True)], dtype="float64")

    return effects.withColumn("p", tail("h", "k"))
