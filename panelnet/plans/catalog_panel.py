"""Queries of panel construction and of types over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelnet.functions.columns import albers, code8, mapped, section, total
from panelnet.operators import labels as lab
from panelnet.operators import panel as pan
from panelnet.plans import views as v
from panelnet.plans.registry import query, rounded
from panelnet.plans.views import CATS, EVENTS, FEATURES, FLAGS, N_PERIODS, with_views

KINDS = list(range(1, len(EVENTS) + 1))


def _r(columns: list[str], digits: int = 6, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, {digits}) AS {c}" for c in columns)


@query(with_views("wide", f"SELECT entity, month, {_r(CATS, 5)} FROM wide"))
def panel_pivot_sum(spark, d):
    return rounded(v.wide(spark, d), CATS, 5)


@query(with_views("facts", "SELECT entity, month, " + ", ".join(f"round(avg(value) FILTER (category = '{f}'), 8) AS {f.lower()}" for f in FLAGS[:2]) + " FROM facts WHERE category NOT IN ('R') GROUP BY entity, month"))
def panel_pivot_mean(spark, d):
    return rounded(pan.pivot_mean(pan.exclude(v.facts(spark, d), ["R"]), FLAGS[:2]), CATS[:2], 8)


@query(with_views("lines", "SELECT l_suppkey AS entity, date_trunc('month', l_shipdate)::DATE AS month, round(sum(l_quantity), 3) AS quantity, round(sum(l_tax), 6) AS tax FROM lines GROUP BY ALL"))
def panel_sum_wide(spark, d):
    lines = v.table(spark, d, "lineitem").filter("l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1998-01-01'")
    rows = lines.select(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "MM").alias("month"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return rounded(rounded(pan.sum_wide(rows, ["quantity", "tax"]), ["quantity"], 3), ["tax"], 6)


@query(with_views("filled", "SELECT entity, month, category, round(value, 6) AS value FROM (UNPIVOT (SELECT entity, month, a, n, r FROM filled) ON a, n, r INTO NAME category VALUE value)"))
def panel_unpivot_roundtrip(spark, d):
    long = pan.unpivot(v.filled(spark, d).select("entity", "month", *CATS), CATS)
    back = long.groupBy("entity", "month").pivot("category", CATS).agg(F.first("value"))
    return rounded(pan.unpivot(back, CATS), ["value"], 6).filter("value is not null")


@query(with_views("covered wide", "SELECT entity, count(*)::BIGINT AS n_periods FROM wide WHERE entity IN (SELECT entity FROM covered) GROUP BY entity"))
def panel_coverage(spark, d):
    wide = v.wide(spark, d)
    return pan.coverage(wide.join(pan.covered(wide), "entity", "left_semi"))


@query(with_views("whole", f"SELECT entity, month, t, {_r(CATS, 6)} FROM whole"))
def panel_interpolated(spark, d):
    return rounded(v.whole(spark, d).select("entity", "month", "t", *CATS), CATS, 6)


@query(with_views("whole", f"SELECT entity, month, round(a/tot,6) AS a_share, round(n/tot,6) AS n_share, round(r/tot,6) AS r_share, round(ln(1+tot),6) AS log_total, round(greatest(1-(a/tot+n/tot+r/tot),0),6) AS other_share FROM (SELECT *, (a+n+r)*1.25 AS tot FROM whole)"))
def panel_shares(spark, d):
    panel = v.whole(spark, d).withColumn("tot", total(*map(F.col, CATS)) * 1.25)
    return rounded(pan.shares(panel, [*CATS, "tot"], "tot").drop("t"), [*FEATURES, "other_share"])


@query(with_views("whole", "SELECT entity, month, round(100*a/tot,5) AS a_pct, round(100*n/tot,5) AS n_pct, round(100*r/tot,5) AS r_pct, round(100-(100*a/tot+100*n/tot+100*r/tot),5) AS other_pct FROM (SELECT *, (a+n+r)*0.9 AS tot FROM whole)"))
def panel_percent_shares(spark, d):
    panel = v.whole(spark, d).withColumn("tot", total(*map(F.col, CATS)) * 0.9)
    return rounded(pan.percent_shares(panel, [*CATS, "tot"], "tot").drop("t", "tot"), ["a_pct", "n_pct", "r_pct", "other_pct"], 5)


@query(with_views("z", f"SELECT entity, month, t, {_r([*FEATURES, 'balance'])} FROM z"))
def panel_zscore(spark, d):
    return rounded(v.features(spark, d).select("entity", "month", "t", *FEATURES, "balance"), [*FEATURES, "balance"])


@query(with_views("z", "SELECT z.entity, z.month, round(log_total, 6) AS log_total, round(q, 6) AS quantity FROM z LEFT JOIN (SELECT l_suppkey AS entity, date_trunc('month', l_shipdate)::DATE AS month, avg(l_quantity) AS q FROM lines GROUP BY ALL) e ON e.entity = z.entity AND e.month = z.month"))
def panel_extra_monthly(spark, d):
    extra = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "MM").alias("month"), F.col("l_quantity").alias("quantity"))
    panel = pan.attach_monthly(v.features(spark, d), extra, ["quantity"])
    return rounded(panel.select("entity", "month", "log_total", "quantity"), ["log_total", "quantity"])


@query(
    with_views(
        "facts covered",
        "SELECT * FROM (SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM facts UNION ALL SELECT 'entities', count(DISTINCT entity) FROM facts UNION ALL SELECT 'periods', count(DISTINCT month) FROM facts UNION ALL SELECT 'panel_rows', count(*) FROM wide UNION ALL SELECT 'covered', count(*) FROM covered"
        + "".join(f" UNION ALL SELECT 'missing_{c}', round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM wide" for c in CATS)
        + ")",
    )
)
def panel_audit(spark, d):
    return rounded(pan.audit(v.facts(spark, d), v.wide(spark, d), CATS), ["value"])


@query(with_views("whole", "SELECT entity, month, round((a+n+r) / median(a+n+r) OVER (PARTITION BY month), 6) AS ratio FROM whole"))
def ratio_to_median(spark, d):
    panel = v.whole(spark, d).select("entity", "month", total(*map(F.col, CATS)).alias("tot"))
    return rounded(pan.ratio_to_median(panel, "tot", "ratio").select("entity", "month", "ratio"), ["ratio"])


@query(with_views("versions", "SELECT key, version, until, kind FROM versions QUALIFY row_number() OVER (PARTITION BY key ORDER BY until DESC NULLS FIRST, version DESC) = 1"))
def dictionary_latest(spark, d):
    return pan.latest_version(v.versions(spark, d), "key", "until", "version")


@query(with_views("", "SELECT s_suppkey AS id, round(rho*sin(th), 6) AS x, round(rho*cos(th)-rho0, 6) AS y FROM (SELECT s_suppkey, sqrt(c-2*n*sin(radians(lat)))/n AS rho, sqrt(c-2*n*sin(radians(56)))/n AS rho0, n*radians(CASE WHEN lon<0 THEN lon+360 ELSE lon END-100) AS th FROM (SELECT s_suppkey, (s_suppkey*13)%360-180.0 AS lon, 42+(s_suppkey*7)%30*1.0 AS lat, (sin(radians(52))+sin(radians(64)))/2 AS n, power(cos(radians(52)),2)+2*((sin(radians(52))+sin(radians(64)))/2)*sin(radians(52)) AS c FROM supplier))"))
def albers_xy(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 13 % 360 - 180.0).alias("lon"), (42 + F.col("s_suppkey") * 7 % 30 * 1.0).alias("lat"))
    x, y = albers(F.col("lon"), F.col("lat"))
    return rounded(s.select("id", x.alias("x"), y.alias("y")), ["x", "y"])


@query(with_views("user_labels", "SELECT entity, type AS modal FROM (SELECT entity, type, count(*) AS n FROM user_labels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, type) = 1"))
def label_modal(spark, d):
    return lab.modal(v.user_labels(spark, d))


@query(with_views("user_labels", "SELECT entity, type AS modal FROM (SELECT entity, type, count(*) AS n, max(t) AS l FROM user_labels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, l DESC) = 1"))
def label_modal_latest(spark, d):
    return lab.modal_latest(v.user_labels(spark, d))


_MODAL = "SELECT entity, type AS modal FROM (SELECT entity, type, count(*) AS n FROM user_labels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, type) = 1"
_SUMMARY = "SELECT l.entity, m.modal, avg(CASE WHEN type = modal THEN 1.0 ELSE 0.0 END) AS share, coalesce(any_value(c), 0)::BIGINT AS n_changes, count(DISTINCT type)::BIGINT AS n_types FROM user_labels l JOIN modal m ON m.entity = l.entity LEFT JOIN (SELECT entity, count(*) FILTER (a <> b) AS c FROM user_steps GROUP BY entity) s ON s.entity = l.entity GROUP BY l.entity, m.modal"


@query(with_views("user_steps", "SELECT entity, modal, round(share, 6) AS share, n_changes, n_types FROM summary", modal=_MODAL, summary=_SUMMARY))
def entity_summary(spark, d):
    return rounded(lab.entity_summary(v.user_labels(spark, d)), ["share"])


@query(with_views("user_steps", "SELECT modal, count(*)::BIGINT AS n, round(avg(share), 6) AS mean_share, round(avg(CASE WHEN n_changes = 0 THEN 1.0 ELSE 0.0 END), 6) AS never_changed FROM summary GROUP BY modal", modal=_MODAL, summary=_SUMMARY))
def core_table(spark, d):
    return rounded(lab.core_table(lab.entity_summary(v.user_labels(spark, d))), ["mean_share", "never_changed"])


@query(with_views("user_steps", f"SELECT x.a::INT AS a, y.b::INT AS b, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY x.a), 0), 6) AS share FROM (SELECT unnest({KINDS}) AS a) x CROSS JOIN (SELECT unnest({KINDS}) AS b) y LEFT JOIN (SELECT a, b, count(*) AS n FROM user_steps GROUP BY ALL) s ON s.a = x.a AND s.b = y.b"))
def transition_matrix(spark, d):
    return rounded(lab.transitions(v.user_labels(spark, d), KINDS), ["share"])


@query(with_views("user_labels", "SELECT t, " + ", ".join(f"(count(*) FILTER (type = {k}))::BIGINT AS n_{k}" for k in KINDS) + " FROM user_labels GROUP BY t"))
def type_sizes(spark, d):
    return lab.type_sizes(v.user_labels(spark, d), KINDS)


@query(with_views("user_steps", "SELECT (t + 1)::INT AS t, round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS rate FROM user_steps GROUP BY t"))
def change_rate(spark, d):
    return rounded(lab.change_rate(v.user_labels(spark, d)), ["rate"])


def _event_sql(of: str, other: str, name: str) -> str:
    return with_views("user_steps", f"SELECT (t + 1)::INT AS t, '{name}' AS event, {of} AS type, string_agg({other}::VARCHAR, ',' ORDER BY {other}) AS related FROM (SELECT *, sum(n) OVER (PARTITION BY t, {of}) AS m FROM (SELECT t, a, b, count(*) AS n FROM user_steps GROUP BY ALL)) WHERE n >= 0.3 * m GROUP BY t, {of} HAVING count(*) > 1")


@query(_event_sql("a", "b", "split"))
def events_split(spark, d):
    return lab.splits(v.user_labels(spark, d)).withColumn("related", F.array_join("related", ","))


@query(_event_sql("b", "a", "merge"))
def events_merge(spark, d):
    return lab.merges(v.user_labels(spark, d)).withColumn("related", F.array_join("related", ","))


@query(with_views("user_labels", "SELECT type AS label, row_number() OVER (ORDER BY count(*) DESC, type)::INT AS type FROM user_labels GROUP BY type"))
def relabel_by_size(spark, d):
    return lab.relabel_by_size(v.user_labels(spark, d))


@query(with_views("user_labels", "SELECT entity, string_agg(type::VARCHAR, '' ORDER BY t) AS path FROM user_labels GROUP BY entity"))
def label_paths(spark, d):
    return lab.label_paths(v.user_labels(spark, d))


@query(with_views("supp_labels", "SELECT entity, " + ", ".join(f"max(CASE WHEN t = {t} THEN type END) AS t{t}" for t in range(N_PERIODS)) + " FROM supp_labels GROUP BY entity"))
def label_wide(spark, d):
    return lab.wide_labels(v.supplier_labels(spark, d), N_PERIODS)


@query(with_views("user_steps", "SELECT (t + 1)::INT AS t, round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS rate FROM user_steps GROUP BY t ORDER BY avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END) DESC, t LIMIT 3"))
def jump_top_months(spark, d):
    return rounded(lab.top_jumps(v.user_labels(spark, d)), ["rate"])


@query(with_views("user_steps", "SELECT a, b, count(*)::BIGINT AS n FROM user_steps WHERE t = 14 AND a <> b GROUP BY a, b ORDER BY n DESC, a, b LIMIT 3"))
def jump_flows(spark, d):
    return lab.top_flows(v.user_labels(spark, d), 15)


_F = FEATURES


@query(
    with_views(
        "z supp_steps",
        "SELECT f.a, f.b, f.n::BIGINT AS n, round(median(CASE WHEN s.b = f.b THEN gap END), 6) AS movers, round(median(CASE WHEN s.b = f.a THEN gap END), 6) AS stayers FROM (SELECT f.a, f.b, f.n, x.entity, sqrt("
        + " + ".join(f"power(x.{c} - cb.{c}, 2)" for c in _F)
        + ") - sqrt("
        + " + ".join(f"power(x.{c} - ca.{c}, 2)" for c in _F)
        + ") AS gap FROM big f JOIN supp_steps s0 ON s0.t = 11 AND s0.a = f.a JOIN z x ON x.entity = s0.entity AND x.t = 11 JOIN cent ca ON ca.type = f.a JOIN cent cb ON cb.type = f.b) f JOIN supp_steps s ON s.t = 11 AND s.entity = f.entity GROUP BY f.a, f.b, f.n",
        cent="SELECT type, " + ", ".join(f"avg(z.{c}) AS {c}" for c in _F) + " FROM z JOIN supp_labels l ON l.entity = z.entity AND l.t = z.t WHERE z.t = 11 GROUP BY type",
        big="SELECT a, b, count(*) AS n FROM supp_steps WHERE t = 11 AND a <> b GROUP BY a, b ORDER BY n DESC, a, b LIMIT 3",
    )
)
def jump_margins(spark, d):
    return rounded(lab.margins(v.features(spark, d), v.supplier_labels(spark, d), _F, 12), ["movers", "stayers"])


@query(
    with_views(
        "z supp_steps",
        "SELECT (s.t + 1)::INT AS t, round(avg(dz), 6) AS all_entities, round(avg(CASE WHEN a <> b THEN dz END), 6) AS movers, round(avg(CASE WHEN a = b THEN dz END), 6) AS stayers FROM (SELECT y.entity, y.t, ("
        + " + ".join(f"abs(y.{c} - x.{c})" for c in _F)
        + ") / 4 AS dz FROM z x JOIN z y ON y.entity = x.entity AND y.t = x.t + 1) q JOIN supp_steps s ON s.entity = q.entity AND s.t + 1 = q.t GROUP BY s.t",
    )
)
def feature_change(spark, d):
    return rounded(lab.feature_change(v.features(spark, d), v.supplier_labels(spark, d), _F), ["all_entities", "movers", "stayers"])


@query("SELECT s_suppkey AS id, left(replace(code, '-', ''), 8) AS code8, CASE WHEN s_suppkey % 3 = 0 THEN translate('А', 'АВСЕНКМОРТХ', 'ABCEHKMOPTX') ELSE 'ALL' END AS section FROM (SELECT s_suppkey, '12-' || lpad(s_suppkey::VARCHAR, 6, '0') || '-77' AS code FROM supplier)")
def section_parse(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("12-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("-77")).alias("code"), F.when(F.col("s_suppkey") % 3 == 0, "Раздел А прочее").otherwise("Всего").alias("name"))
    return s.select("id", code8(F.col("code")).alias("code8"), section(F.col("name")).alias("section"))


@query(with_views("user_labels", "SELECT entity, t, type, CASE type WHEN 1 THEN 'reading' WHEN 5 THEN 'reading' WHEN 3 THEN 'buying' END AS macro FROM user_labels"))
def macro_types(spark, d):
    return v.user_labels(spark, d).withColumn("macro", mapped(F.col("type"), {1: "reading", 5: "reading", 3: "buying"}))
