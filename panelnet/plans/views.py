"""The roles of the data model, taken from the star schema: facts, attributes, label panels, vectors, distances.

Each view has a DataFrame form and the same rows as SQL common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelnet.functions.columns import month_of
from panelnet.operators import labels as lab
from panelnet.operators import panel as pan

FLAGS = ["A", "N", "R"]
CATS = ["a", "n", "r"]
FEATURES = ["a_share", "n_share", "r_share", "log_total"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
EVENTS = ["click", "error", "purchase", "signup", "view"]
N_PERIODS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1998-01-01'")


def facts(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(F.col("l_suppkey").alias("entity"), month_of(F.col("l_shipdate"), "date").alias("month"), F.col("l_returnflag").alias("category"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))


def wide(spark: SparkSession, d: str) -> DataFrame:
    return pan.pivot_sum(facts(spark, d), FLAGS)


def filled(spark: SparkSession, d: str) -> DataFrame:
    return pan.interpolate(pan.blank_empty(pan.complete_grid(wide(spark, d)), CATS), CATS, 2)


def whole(spark: SparkSession, d: str) -> DataFrame:
    return pan.drop_incomplete(filled(spark, d), CATS)


def supplier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """The standardised panel: shares, log of the total, log of a static attribute."""
    raw = pan.attach_static(pan.shares(whole(spark, d), CATS), supplier(spark, d), ["balance"], log=True)
    return pan.standardise(pan.without_missing(raw, [*FEATURES, "balance"]), [*FEATURES, "balance"])


def user_labels(spark: SparkSession, d: str) -> DataFrame:
    """entity: user, t: day of the month, type: 1 + place of the day's most frequent event."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("t"), "event_type")
    top = lab.dominant(rows, ["entity", "t"], "event_type")
    return top.select("entity", "t", F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event_type")).cast("int").alias("type"))


def supplier_labels(spark: SparkSession, d: str) -> DataFrame:
    """entity: supplier of the panel, t: month, type: 1 + place of the month's most frequent kind of part."""
    lines = _lines(spark, d).select(F.col("l_suppkey").alias("entity"), month_of(F.col("l_shipdate"), "date").alias("month"), F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    top = lab.dominant(rows, ["entity", "month"], "p_type")
    kept = features(spark, d).select("entity", "month", "t")
    return top.join(kept, ["entity", "month"]).select("entity", "t", F.array_position(F.array(*map(F.lit, TYPES)), F.col("p_type")).cast("int").alias("type"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lit(0).alias("t"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.lit("all").alias("g"), "id", "v", "label")


def relation(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic distances between suppliers of neighbouring keys: (x, y, type, distance)."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x"))
    near = s.withColumn("y", F.explode(F.sequence(F.col("x") + 1, F.col("x") + 40))).join(s.select(F.col("x").alias("y")), "y", "left_semi")
    return near.select("x", "y", F.when((F.col("x") + F.col("y")) % 7 == 0, "rail").otherwise("highway").alias("type"), (10 + (F.col("x") * 37 + F.col("y") * 91) % 997 / 4.0).alias("distance"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderdate").cast("date")).alias("until"), F.col("o_orderpriority").alias("kind"))


#: Oracle: common table expressions, each building on those before.
_BASE = {
    "lines": "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'",
    "facts": "SELECT l_suppkey AS entity, date_trunc('month', l_shipdate)::DATE AS month, l_returnflag AS category, l_extendedprice * (1 - l_discount) AS value FROM lines",
    "wide": "SELECT entity, month, " + ", ".join(f"sum(value) FILTER (category = '{f}') AS {f.lower()}" for f in FLAGS) + " FROM facts GROUP BY entity, month",
    "months": "SELECT month, (row_number() OVER (ORDER BY month) - 1)::INT AS t FROM (SELECT DISTINCT month FROM wide)",
    "covered": "SELECT entity FROM wide GROUP BY entity HAVING count(*) >= (SELECT count(*) FROM months)",
    "grid": "SELECT c.entity, m.month, m.t, w.a, w.n, w.r FROM covered c CROSS JOIN months m LEFT JOIN wide w ON w.entity = c.entity AND w.month = m.month",
    "blank": "SELECT entity, month, t, " + ", ".join(f"CASE WHEN coalesce(a,0)+coalesce(n,0)+coalesce(r,0) > 0 THEN {c} END AS {c}" for c in CATS) + " FROM grid",
    "ends": "SELECT *, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER p AS {c}0, last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER p AS {c}t0, first_value({c} IGNORE NULLS) OVER f AS {c}1, first_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER f AS {c}t1" for c in CATS)
    + " FROM blank WINDOW p AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "filled": "SELECT entity, month, t, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}t1 IS NOT NULL AND t - {c}t0 <= 2 THEN {c}0 + ({c}1 - {c}0) * (t - {c}t0) / ({c}t1 - {c}t0) END AS {c}" for c in CATS) + " FROM ends",
    "whole": "SELECT * FROM filled WHERE entity NOT IN (SELECT entity FROM filled WHERE a IS NULL OR n IS NULL OR r IS NULL)",
    "raw": "SELECT w.entity, w.month, w.t, a/(a+n+r) AS a_share, n/(a+n+r) AS n_share, r/(a+n+r) AS r_share, ln(1+a+n+r) AS log_total, CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END AS balance FROM whole w LEFT JOIN supplier s ON s.s_suppkey = w.entity",
    "kept": "SELECT * FROM raw WHERE balance IS NOT NULL",
    "z": "SELECT entity, month, t, " + ", ".join(f"coalesce(({c} - avg({c}) OVER (PARTITION BY month)) / nullif(stddev_samp({c}) OVER (PARTITION BY month), 0), 0) AS {c}" for c in [*FEATURES, "balance"]) + " FROM kept",
    "user_counts": "SELECT user_id AS entity, day(ts)::INT AS t, event_type, count(*) AS n FROM events GROUP BY ALL",
    "user_labels": f"SELECT entity, t, list_position({EVENTS}, event_type)::INT AS type FROM user_counts QUALIFY row_number() OVER (PARTITION BY entity, t ORDER BY n DESC, event_type) = 1",
    "supp_counts": "SELECT l_suppkey AS entity, date_trunc('month', l_shipdate)::DATE AS month, p_type, count(*) AS n FROM lines JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "supp_labels": f"SELECT c.entity, z.t, list_position({TYPES}, p_type)::INT AS type FROM supp_counts c JOIN z ON z.entity = c.entity AND z.month = c.month QUALIFY row_number() OVER (PARTITION BY c.entity, c.month ORDER BY n DESC, p_type) = 1",
    "vecs": "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings",
    "relation": "SELECT x.s_suppkey AS x, y.s_suppkey AS y, CASE WHEN (x.s_suppkey + y.s_suppkey) % 7 = 0 THEN 'rail' ELSE 'highway' END AS type, 10 + (x.s_suppkey * 37 + y.s_suppkey * 91) % 997 / 4.0 AS distance FROM supplier x JOIN supplier y ON y.s_suppkey > x.s_suppkey AND y.s_suppkey <= x.s_suppkey + 40",
    "versions": "SELECT o_custkey AS key, o_orderkey AS version, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate::DATE END AS until, o_orderpriority AS kind FROM orders",
    "user_steps": "SELECT entity, t, type AS a, b FROM (SELECT *, lead(type) OVER w AS b, lead(t) OVER w AS nt FROM user_labels WINDOW w AS (PARTITION BY entity ORDER BY t)) WHERE nt = t + 1",
    "supp_steps": "SELECT entity, t, type AS a, b FROM (SELECT *, lead(type) OVER w AS b, lead(t) OVER w AS nt FROM supp_labels WINDOW w AS (PARTITION BY entity ORDER BY t)) WHERE nt = t + 1",
}
_NEEDS = {
    "facts": ["lines"], "wide": ["facts"], "months": ["wide"], "covered": ["months"], "grid": ["covered"], "blank": ["grid"], "ends": ["blank"], "filled": ["ends"], "whole": ["filled"], "raw": ["whole"], "kept": ["raw"], "z": ["kept"],
    "user_labels": ["user_counts"], "supp_counts": ["lines"], "supp_labels": ["z", "supp_counts"], "user_steps": ["user_labels"], "supp_steps": ["supp_labels"],
}


def with_views(names: str, sql: str, **more: str) -> str:
    """``sql`` after the named views, those that they need, and ``more``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({_BASE[n]})" for n in order] + [f"{n} AS MATERIALIZED ({q})" for n, q in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql
