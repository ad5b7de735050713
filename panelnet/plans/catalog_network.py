"""Queries of similarity networks, validity, profiles and external comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelnet.functions.columns import mapped
from panelnet.operators import external as ext
from panelnet.operators import labels as lab
from panelnet.operators import network as net
from panelnet.operators import profiles as pro
from panelnet.operators import validity as val
from panelnet.plans import views as v
from panelnet.plans.registry import query, rounded
from panelnet.plans.views import FEATURES, N_PERIODS, with_views

DYN = FEATURES
ALL = [*FEATURES, "balance"]


def _knn_sql(pairs: str, k: int) -> dict[str, str]:
    """Views best and edges from SQL for (t, i, j, s) over ordered pairs."""
    return {
        "best": f"SELECT * FROM ({pairs}) QUALIFY row_number() OVER (PARTITION BY t, i ORDER BY s DESC, j) <= {k}",
        "edges": "SELECT t, least(i, j) AS src, greatest(i, j) AS dst, max(s) AS w FROM best WHERE s > 0 GROUP BY ALL",
    }


_VEC = "SELECT 0 AS t, a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS s FROM vecs a JOIN vecs b ON a.id <> b.id"
_ZV = f"SELECT entity AS id, t, [{', '.join(ALL)}] AS v FROM z"
_ZPAIR = "SELECT a.t, a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS s FROM zv a JOIN zv b ON a.t = b.t AND a.id <> b.id"


def panel_edges(spark, d, k=5):
    return net.knn_edges(net.vectors(v.features(spark, d), ALL), k)


def vector_edges(spark, d, k=10):
    return net.knn_edges(v.vectors(spark, d).select("t", "id", "v"), k)


@query(with_views("vecs", "SELECT src, dst, round(w, 6) AS w FROM edges", **_knn_sql(_VEC, 10)))
def cosine_knn(spark, d):
    return rounded(vector_edges(spark, d).select("src", "dst", "w"), ["w"])


@query(with_views("z", "SELECT t::INT AS t, src, dst, round(w, 6) AS w FROM edges", zv=_ZV, **_knn_sql(_ZPAIR, 5)))
def panel_knn(spark, d):
    return rounded(panel_edges(spark, d), ["w"])


@query(with_views("vecs", "SELECT 'cosine' AS rule, 10 AS k, count(*)::BIGINT AS n FROM edges UNION ALL SELECT 'cosine', 4, count(*) FROM (SELECT DISTINCT least(i, j), greatest(i, j) FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 4) WHERE s > 0)", **_knn_sql(_VEC, 10)))
def knn_rule_sweep(spark, d):
    return net.knn_sweep(v.vectors(spark, d).select("t", "id", "v"), [10, 4], "cosine").groupBy("rule", "k").agg(F.count("*").alias("n"))


_DIFF = "SELECT x.entity, x.t, " + ", ".join(f"y.{c} - x.{c} AS {c}" for c in DYN) + " FROM z x JOIN z y ON y.entity = x.entity AND y.t = x.t + 1"
_LONG = "SELECT entity, t, f, x FROM (UNPIVOT (SELECT entity, t, " + ", ".join(DYN) + " FROM diff) ON " + ", ".join(DYN) + " INTO NAME f VALUE x)"


@query(with_views("z", "SELECT entity, t::INT AS t, " + ", ".join(f"round({c}, 6) AS {c}" for c in DYN) + " FROM diff", diff=_DIFF))
def feature_differences(spark, d):
    return rounded(net.changes(v.features(spark, d), DYN), DYN)


@query(with_views("z", "SELECT feature, round(spread, 6) AS spread, spread > 1e-9 AS varies FROM (UNPIVOT (SELECT " + ", ".join(f"max({c}) AS {c}" for c in DYN) + " FROM (SELECT entity, " + ", ".join(f"stddev_pop({c}) AS {c}" for c in DYN) + " FROM z GROUP BY entity)) ON " + ", ".join(DYN) + " INTO NAME feature VALUE spread)"))
def time_varying_features(spark, d):
    return rounded(net.time_varying(v.features(spark, d), DYN), ["spread"])


_WINDOWS = "SELECT p AS t, entity AS id, l.t AS lt, f, x FROM (SELECT unnest(range(24)) AS p) w JOIN long l ON l.t >= greatest(0, least(greatest(0, p - 6), 11)) AND l.t < greatest(0, least(greatest(0, p - 6), 11)) + 12"
_CORR = "SELECT a.t, a.id AS i, b.id AS j, coalesce(corr(a.x, b.x), 0) AS s FROM win a JOIN win b ON a.t = b.t AND a.lt = b.lt AND a.f = b.f AND a.id <> b.id GROUP BY ALL"


@query(with_views("z", "SELECT t::INT AS t, src, dst, round(w, 6) AS w FROM edges", diff=_DIFF, long=_LONG, win=_WINDOWS, **_knn_sql(_CORR, 5)))
def corr_window_knn(spark, d):
    windows = net.change_windows(net.changes(v.features(spark, d), DYN), DYN, 12, N_PERIODS)
    return rounded(net.knn_edges(windows, 5, centre=True), ["w"])


_LAGS = "SELECT l, a.entity AS i, b.entity AS j, corr(a.x, b.x) AS s FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS l) g JOIN long a ON true JOIN long b ON b.t = a.t + l AND b.f = a.f AND b.entity <> a.entity GROUP BY ALL"
_LAGBEST = "SELECT i, j, s, l AS lag, zero FROM (SELECT *, max(CASE WHEN l = 0 THEN s END) OVER (PARTITION BY i, j) AS zero FROM lags) QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY round(s, 10) DESC, l) = 1"


def lag_series(spark, d):
    return net.lagged_series(net.changes(v.features(spark, d), DYN), DYN)


@query(with_views("z", "SELECT i, j, round(s, 6) AS s, lag::INT AS lag, round(zero, 6) AS zero FROM lagbest", diff=_DIFF, long=_LONG, lags=_LAGS, lagbest=_LAGBEST))
def lag_corr_best(spark, d):
    return rounded(net.lag_similarity(lag_series(spark, d), 2), ["s", "zero"])


@query(with_views("z", "SELECT round(avg(CASE WHEN abs(lag) = 0 THEN 1.0 ELSE 0 END), 6) AS lag0, round(avg(CASE WHEN abs(lag) = 1 THEN 1.0 ELSE 0 END), 6) AS lag1, round(avg(CASE WHEN abs(lag) >= 2 THEN 1.0 ELSE 0 END), 6) AS lag2, round(avg(zero), 6) AS zero, round(avg(w), 6) AS best FROM edges e JOIN lagbest l ON l.i = e.src AND l.j = e.dst", diff=_DIFF, long=_LONG, lags=_LAGS, lagbest=_LAGBEST, **_knn_sql("SELECT 0 AS t, a.i, a.j, greatest(a.s, b.s) AS s FROM lagbest a JOIN lagbest b ON b.i = a.j AND b.j = a.i", 5)))
def lag_edge_stats(spark, d):
    out = net.lag_statistics(net.lag_nearest(lag_series(spark, d), 2, 5))
    return rounded(out, out.columns)


_DIST = {
    "rel": "SELECT x AS i, y AS j, distance AS d FROM relation WHERE type = 'highway'",
    "dist": "SELECT i, j, d FROM rel UNION ALL SELECT j, i, d FROM rel",
    "scale": "SELECT median(d) AS scale FROM (SELECT i, d FROM dist QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 6)",
}
_GEO = "SELECT 0 AS t, i, j, exp(-round_even(d, 1) / scale) AS s FROM dist, scale"


def supplier_distances(spark, d):
    return net.distances(v.relation(spark, d), "highway")


@query(with_views("relation", "SELECT src, dst, round(w, 6) AS w FROM edges", **_DIST, **_knn_sql(_GEO, 5)))
def geo_decay_knn(spark, d):
    return rounded(net.symmetric(net.ranked(net.geo_similarity(supplier_distances(spark, d), 5), 5)).select("src", "dst", "w"), ["w"])


@query(with_views("relation", "SELECT e.t::INT AS t, round(median(d), 6) AS median_length FROM edges e JOIN dist x ON x.i = e.src AND x.j = e.dst GROUP BY e.t", **_DIST, **_knn_sql(_GEO, 5)))
def graph_edge_length(spark, d):
    dist = supplier_distances(spark, d)
    edges = net.symmetric(net.ranked(net.geo_similarity(dist, 5), 5))
    return rounded(net.edge_lengths(edges, dist), ["median_length"])


_E10 = _knn_sql(_ZPAIR, 5) | {"e2": "SELECT t, least(i, j) AS src, greatest(i, j) AS dst FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY t, i ORDER BY s DESC, j) <= 2) WHERE s > 0 GROUP BY ALL"}


@query(with_views("z", "SELECT coalesce(a.t, b.t)::INT AS t, round(count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) / count(*), 6) AS jaccard FROM edges a FULL JOIN e2 b ON a.t = b.t AND a.src = b.src AND a.dst = b.dst GROUP BY 1", zv=_ZV, **_E10))
def edge_overlap(spark, d):
    both = net.knn_sweep(net.vectors(v.features(spark, d), ALL), [5, 2], "cosine")
    return rounded(net.overlap(both.filter("k = 5"), both.filter("k = 2")), ["jaccard"])


@query(with_views("z", "SELECT coalesce(a.t, b.t - 1)::INT AS t, round(count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) / count(*), 6) AS jaccard FROM (SELECT * FROM edges WHERE t < (SELECT max(t) FROM edges)) a FULL JOIN (SELECT * FROM edges WHERE t > 0) b ON a.t = b.t - 1 AND a.src = b.src AND a.dst = b.dst GROUP BY 1", zv=_ZV, **_knn_sql(_ZPAIR, 5)))
def edge_stability(spark, d):
    return rounded(net.stability(panel_edges(spark, d)), ["jaccard"])


@query(with_views("z", "SELECT t::INT AS t, count(*)::BIGINT AS n_edges, round(2 * count(*) / (SELECT count(DISTINCT entity) FROM z), 6) AS mean_degree FROM edges GROUP BY t", zv=_ZV, **_knn_sql(_ZPAIR, 5)))
def graph_degree(spark, d):
    panel = v.features(spark, d)
    nodes = panel.groupBy("t").agg(F.count("*").alias("n"))
    return rounded(net.degrees(panel_edges(spark, d), nodes), ["mean_degree"])


_COMP = _knn_sql(_VEC, 2)


@query(
    "WITH RECURSIVE vecs AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), best AS MATERIALIZED ("
    + _COMP["best"]
    + "), edges AS MATERIALIZED ("
    + _COMP["edges"]
    + "), ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), reach(id, c) AS (SELECT id, id FROM vecs UNION SELECT b.b, r.c FROM reach r JOIN ways b ON b.a = r.id WHERE r.c < b.b) SELECT id, min(c) AS component FROM reach GROUP BY id"
)
def graph_components(spark, d):
    vecs = v.vectors(spark, d).select("t", "id", "v")
    return net.component_labels(vecs.select("t", "id"), net.knn_edges(vecs, 2)).select("id", "component")


_REACH = {
    "ways": "SELECT t, src AS a, dst AS b FROM edges UNION ALL SELECT t, dst, src FROM edges",
    "reach(t, id, c)": "SELECT t, id, id FROM zv UNION SELECT r.t, b.b, r.c FROM reach r JOIN ways b ON b.t = r.t AND b.a = r.id WHERE r.c < b.b",
}


@query(with_views("z", "SELECT t::INT AS t, count(*)::BIGINT AS n_components, round(max(n) / sum(n), 6) AS giant_share FROM (SELECT t, c, count(*) AS n FROM (SELECT t, id, min(c) AS c FROM reach GROUP BY t, id) GROUP BY t, c) GROUP BY t", zv=_ZV, **_knn_sql(_ZPAIR, 2), **_REACH))
def graph_component_summary(spark, d):
    vecs = net.vectors(v.features(spark, d), ALL)
    return rounded(net.component_summary(net.component_labels(vecs.select("t", "id"), net.knn_edges(vecs, 2))), ["giant_share"])


@query(with_views("z", "SELECT src, dst, round(sum(w) / 24, 6) AS w FROM edges GROUP BY ALL", zv=_ZV, **_knn_sql(_ZPAIR, 5)))
def graph_mean(spark, d):
    return rounded(net.mean_graph(panel_edges(spark, d), F.lit(N_PERIODS)), ["w"])


@query(with_views("z", "SELECT u.t::INT AS t, src, dst, round(sum(CASE WHEN e.t = 0 THEN power(0.5, u.t) ELSE 0.5 * power(0.5, u.t - e.t) END * w), 6) AS w FROM (SELECT unnest(range(24)) AS t) u JOIN edges e ON e.t <= u.t GROUP BY ALL", zv=_ZV, **_knn_sql(_ZPAIR, 5)))
def graph_smoothed(spark, d):
    return rounded(net.smoothed(panel_edges(spark, d), 0.5, N_PERIODS), ["w"])


# validity on given labels
_BW = _knn_sql(_VEC, 10) | {
    "bw": "SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, sum(w) AS w FROM edges e JOIN vecs x ON x.id = e.src JOIN vecs y ON y.id = e.dst GROUP BY ALL",
    "cl": "SELECT c.label, coalesce(sum(CASE WHEN a = b THEN w END), 0) AS inn, coalesce(sum(CASE WHEN a <> b THEN w END), 0) AS cut FROM (SELECT DISTINCT label FROM vecs) c LEFT JOIN bw ON bw.a = c.label OR bw.b = c.label GROUP BY c.label",
    "tot": "SELECT sum(inn) + sum(cut) / 2 AS m, count(*) AS k FROM cl",
}


def labelled_edges(spark, d):
    return vector_edges(spark, d).select(F.lit("all").alias("g"), "src", "dst", "w")


@query(with_views("vecs", "SELECT a, b, round(w, 6) AS w FROM bw", **_BW))
def block_weights(spark, d):
    return rounded(val.block_weights(labelled_edges(spark, d), v.points(spark, d).select("g", "id", "label")).select("a", "b", "w"), ["w"])


_NI = "SELECT round(avg(iso), 6) AS avi, round((SELECT sum(2 * w / (x.cut + y.cut - w)) FROM bw JOIN cl x ON x.label = a JOIN cl y ON y.label = b WHERE a < b AND x.cut + y.cut - w > 0) / any_value(k), 6) AS avu, round(sum(iso), 6) AS mq, round(sum(inn / m - power((2 * inn + cut) / (2 * m), 2)), 6) AS q FROM (SELECT *, coalesce(2 * inn / nullif(2 * inn + cut, 0), 0) AS iso FROM cl, tot)"


@query(with_views("vecs", _NI, **_BW))
def network_indices(spark, d):
    out = val.network_indices(labelled_edges(spark, d), v.points(spark, d).select("g", "id", "label")).drop("g")
    return rounded(out, out.columns)


_SIL = "SELECT id, label, CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM (SELECT x.id, x.label, max(CASE WHEN c.label = x.label THEN c.n END) AS n, max(CASE WHEN c.label = x.label THEN d / nullif(c.n - 1, 0) END) AS a, min(CASE WHEN c.label <> x.label THEN d / c.n END) AS b FROM (SELECT p.id, p.label, q.label AS o, sum(list_distance(p.v, q.v)) AS d FROM vecs p, vecs q GROUP BY ALL) x JOIN (SELECT label, count(*) AS n FROM vecs GROUP BY label) c ON c.label = x.o GROUP BY ALL)"


@query(with_views("vecs", "SELECT id, label, round(s, 6) AS s FROM sil", sil=_SIL))
def silhouette_points(spark, d):
    return rounded(val.silhouette_points(v.points(spark, d)).drop("g"), ["s"])


@query(with_views("vecs", "SELECT round(avg(s), 6) AS sw FROM sil", sil=_SIL))
def silhouette(spark, d):
    return rounded(val.silhouette(v.points(spark, d)).drop("g"), ["sw"])


_FLAT = "SELECT id, label, unnest(range(len(v))) AS f, unnest(v) AS x FROM vecs"
_CH = "SELECT ((total - within) / (k - 1)) / (within / (n - k)) AS ch FROM (SELECT sum(v * n) AS total, max(n) AS n FROM (SELECT f, var_pop(x) AS v, count(*) AS n FROM flat GROUP BY f)), (SELECT sum(v * n) AS within, count(DISTINCT label) AS k FROM (SELECT label, f, var_pop(x) AS v, count(*) AS n FROM flat GROUP BY label, f))"


@query(with_views("vecs", "SELECT round(ch, 6) AS ch FROM chq", flat=_FLAT, chq=_CH))
def calinski_harabasz(spark, d):
    return rounded(val.calinski_harabasz(v.points(spark, d)).drop("g"), ["ch"])


_SDBW = {
    "flat": _FLAT,
    "cen": "SELECT label, list(m ORDER BY f) AS c, sqrt(sum(vv * vv)) AS sigma FROM (SELECT label, f, avg(x) AS m, var_pop(x) AS vv FROM flat GROUP BY label, f) GROUP BY label",
    "sc": "SELECT avg(sigma) / any_value(w) AS scat, sqrt(sum(sigma)) / count(*) AS radius, count(*) AS k FROM cen, (SELECT sqrt(sum(vv * vv)) AS w FROM (SELECT f, var_pop(x) AS vv FROM flat GROUP BY f))",
    "own": "SELECT c.label, count(*) FILTER (list_distance(p.v, c.c) <= radius) AS n FROM cen c JOIN vecs p ON p.label = c.label, sc GROUP BY c.label",
    "mid": "SELECT a.label AS a, b.label AS b, (SELECT count(*) FROM vecs p, sc WHERE p.label IN (a.label, b.label) AND list_distance(p.v, list_transform(list_zip(a.c, b.c), lambda z: (z[1] + z[2]) / 2)) <= radius) AS n FROM cen a JOIN cen b ON a.label < b.label",
}
_SDBWQ = "SELECT scat + coalesce((SELECT sum(2 * coalesce(m.n / nullif(greatest(x.n, y.n), 0), 0)) FROM mid m JOIN own x ON x.label = a JOIN own y ON y.label = b), 0) / (k * (k - 1)) AS s_dbw FROM sc"


@query(with_views("vecs", "SELECT round(s_dbw, 6) AS s_dbw FROM sd", **_SDBW, sd=_SDBWQ))
def s_dbw(spark, d):
    return rounded(val.s_dbw(v.points(spark, d)).drop("g"), ["s_dbw"])


@query(with_views("vecs", "SELECT k::BIGINT AS k, mn::BIGINT AS min_size, round(mx, 6) AS max_share, avi, avu, mq, q, sw, round(ch, 6) AS ch, round(s_dbw, 6) AS s_dbw FROM (SELECT count(*) AS k, min(n) AS mn, max(n) / sum(n) AS mx FROM (SELECT label, count(*) AS n FROM vecs GROUP BY label)), ni, (SELECT round(avg(s), 6) AS sw FROM sil), chq, sd", **_BW, **_SDBW, sd=_SDBWQ, sil=_SIL, chq=_CH, ni=_NI))
def validity_bundle(spark, d):
    out = val.bundle(v.points(spark, d), labelled_edges(spark, d)).drop("g")
    return rounded(out, [c for c in out.columns if c not in ("k", "min_size")])


_PAIR = "SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY ALL"


def part_pairs(spark, d):
    return v.table(spark, d, "part").select(F.lit("all").alias("g"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"))


@query(with_views("", "SELECT a, b, n FROM (SELECT x.a, y.b, coalesce(p.n, 0)::BIGINT AS n FROM (SELECT DISTINCT a FROM pair) x CROSS JOIN (SELECT DISTINCT b FROM pair) y LEFT JOIN pair p ON p.a = x.a AND p.b = y.b)", pair=_PAIR))
def contingency(spark, d):
    return val.dense_contingency(part_pairs(spark, d)).select("a", "b", "n")


_ARI = "SELECT (nij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) AS ari FROM (SELECT sum(n * (n - 1) / 2) AS nij, sum(n) AS n FROM pair), (SELECT sum(m * (m - 1) / 2) AS sa FROM (SELECT sum(n) AS m FROM pair GROUP BY a)), (SELECT sum(m * (m - 1) / 2) AS sb FROM (SELECT sum(n) AS m FROM pair GROUP BY b))"


@query(with_views("", f"SELECT round(ari, 9) AS ari FROM ({_ARI})", pair=_PAIR))
def ari_pair(spark, d):
    return rounded(val.adjusted_rand(part_pairs(spark, d)).select("ari"), ["ari"], 9)


_JAC = "SELECT a, max(n / (na + nb - n)) AS jaccard FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM pair) GROUP BY a"


@query(with_views("", f"SELECT a, round(jaccard, 6) AS jaccard FROM ({_JAC})", pair=_PAIR))
def jaccard_best(spark, d):
    return rounded(val.best_jaccard(part_pairs(spark, d)).select("a", "jaccard"), ["jaccard"])


@query(with_views("user_steps", "SELECT a, CASE WHEN jaccard >= 0.75 THEN 'stable' WHEN jaccard >= 0.6 THEN 'membership unsure' ELSE 'unstable' END AS verdict FROM (" + _JAC + ")", pair="SELECT a, b, count(*) AS n FROM user_steps GROUP BY ALL"))
def stability_verdict(spark, d):
    pairs = lab.steps(v.user_labels(spark, d)).select(F.lit("all").alias("g"), "a", "b")
    return val.best_jaccard(pairs).select("a", val.verdict(F.col("jaccard")).alias("verdict"))


# profiles
_TYPED = {"typed": "SELECT z.*, l.type, s.s_nationkey AS nation FROM z JOIN supp_labels l ON l.entity = z.entity AND l.t = z.t JOIN supplier s ON s.s_suppkey = z.entity", "shown": "SELECT w.entity, w.t, l.type, a/(a+n+r) AS a_share, n/(a+n+r) AS n_share, r/(a+n+r) AS r_share, ln(1+a+n+r) AS log_total FROM whole w JOIN supp_labels l ON l.entity = w.entity AND l.t = w.t"}
_SHOWN = ["a_share", "n_share", "r_share", "log_total"]
_SM = {
    "smod": "SELECT entity, type AS modal FROM (SELECT entity, type, count(*) AS n FROM supp_labels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, type) = 1",
    "ssum": "SELECT l.entity, m.modal, avg(CASE WHEN type = modal THEN 1.0 ELSE 0.0 END) AS share, any_value(c) AS n_changes FROM supp_labels l JOIN smod m ON m.entity = l.entity JOIN (SELECT entity, count(*) FILTER (a <> b) AS c FROM supp_steps GROUP BY entity) s ON s.entity = l.entity GROUP BY l.entity, m.modal",
}


def shown_rows(spark, d):
    from panelnet.operators import panel as pan

    raw = pan.shares(v.whole(spark, d), v.CATS)
    return raw.join(v.supplier_labels(spark, d), ["entity", "t"])


@query(with_views("whole supp_labels", "SELECT type, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _SHOWN) + " FROM shown GROUP BY ROLLUP (type)", **{"shown": _TYPED["shown"]}))
def type_profiles(spark, d):
    return rounded(pro.type_profiles(shown_rows(spark, d), _SHOWN), _SHOWN)


_LIFT = "SELECT type, feature, m / al AS lift FROM (UNPIVOT (SELECT type, " + ", ".join(f"avg({c}) AS {c}" for c in _SHOWN) + " FROM shown GROUP BY type) ON " + ", ".join(_SHOWN) + " INTO NAME feature VALUE m) JOIN (UNPIVOT (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in _SHOWN) + " FROM shown) ON " + ", ".join(_SHOWN) + " INTO NAME feature VALUE al) USING (feature)"


@query(with_views("whole supp_labels", "SELECT type, feature, round(lift, 6) AS lift FROM lf", **{"shown": _TYPED["shown"]}, lf=_LIFT))
def type_lift(spark, d):
    return rounded(pro.lift(shown_rows(spark, d), _SHOWN), ["lift"])


@query(with_views("whole supp_labels", "SELECT type, 'high' AS side, row_number() OVER (PARTITION BY type ORDER BY lift DESC, feature)::INT AS rank, feature, round(lift, 6) AS lift FROM lf WHERE lift > 1.02 QUALIFY rank <= 3 UNION ALL SELECT type, 'low', row_number() OVER (PARTITION BY type ORDER BY lift, feature)::INT AS rank, feature, round(lift, 6) FROM lf WHERE lift < 0.98 QUALIFY rank <= 3", **{"shown": _TYPED["shown"]}, lf=_LIFT))
def lift_extremes(spark, d):
    return rounded(pro.lift_extremes(pro.lift(shown_rows(spark, d), _SHOWN)), ["lift"])


def supplier_summary(spark, d):
    return lab.entity_summary(v.supplier_labels(spark, d)).drop("n_types")


@query(with_views("supp_steps", "SELECT modal, region, n, round(100.0 * n / sum(n) OVER (PARTITION BY modal), 6) AS percent FROM (SELECT modal, r_name AS region, count(*)::BIGINT AS n FROM ssum JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY modal, r_name)", **_SM))
def composition(spark, d):
    return rounded(pro.composition(_placed(spark, d), "modal", "region"), ["percent"])


def _placed(spark, d):
    nation = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"), F.col("r_name").alias("region"))
    return supplier_summary(spark, d).join(v.supplier(spark, d), "entity").join(nation, "nation")


@query(with_views("supp_steps", "SELECT *, row_number() OVER (PARTITION BY modal ORDER BY n DESC, nation_name)::INT AS rank FROM (SELECT modal, n_name AS nation_name, count(*)::BIGINT AS n FROM ssum JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey GROUP BY modal, n_name) QUALIFY rank <= 5", **_SM))
def region_top(spark, d):
    return pro.top_values(_placed(spark, d), "modal", "nation_name", 5)


@query(with_views("supp_steps", "SELECT entity, modal, n_changes::BIGINT AS n_changes FROM ssum JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE contains(r_name, 'A') AND r_name LIKE '%AS%'", **_SM))
def focus_region(spark, d):
    return pro.in_region(pro.in_region(_placed(spark, d), "region", "AS"), "region", "A").select("entity", "modal", "n_changes")


_DISTQ = {
    "gz": "SELECT entity, type, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in _SHOWN) + " FROM shown",
    "far": "SELECT s.*, sqrt(" + " + ".join(f"power(e.{c} - c.{c}, 2)" for c in _SHOWN) + ") AS distance FROM ssum s JOIN (SELECT entity, " + ", ".join(f"avg({c}) AS {c}" for c in _SHOWN) + " FROM gz GROUP BY entity) e ON e.entity = s.entity JOIN (SELECT type, " + ", ".join(f"avg({c}) AS {c}" for c in _SHOWN) + " FROM gz GROUP BY type) c ON c.type = s.modal",
}


def _far(spark, d):
    return pro.centre_distance(shown_rows(spark, d), supplier_summary(spark, d), _SHOWN)


@query(with_views("whole supp_steps", "SELECT entity, modal, round(distance, 6) AS distance FROM far", **_SM, **{"shown": _TYPED["shown"]}, **_DISTQ))
def centre_distance(spark, d):
    return rounded(_far(spark, d).select("entity", "modal", "distance"), ["distance"])


@query(with_views("whole supp_steps", "SELECT entity, modal, round(distance, 6) AS distance, row_number() OVER (PARTITION BY modal ORDER BY distance, entity)::INT AS rank FROM far WHERE n_changes <= 15 QUALIFY rank <= 8", **_SM, **{"shown": _TYPED["shown"]}, **_DISTQ))
def exemplars(spark, d):
    return rounded(pro.exemplars(_far(spark, d), 8, most_changes=15).select("entity", "modal", "distance", "rank"), ["distance"])


@query(with_views("supp_steps", "SELECT entity, modal, round(share, 6) AS share, row_number() OVER (PARTITION BY modal ORDER BY round(share, 9), entity)::INT AS rank FROM ssum QUALIFY rank <= 3", **_SM))
def boundary_cases(spark, d):
    return rounded(pro.boundary_cases(supplier_summary(spark, d)).select("entity", "modal", "share", "rank"), ["share"])


@query(with_views("z", "SELECT a.id, b.id AS twin, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: power(p[1] - p[2], 2))), 6) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda p: power(p[1] - p[2], 2))), b.id)::INT AS rank FROM mv a JOIN mv b ON a.nation <> b.nation QUALIFY rank <= 5", mv="SELECT entity AS id, any_value(s_nationkey) AS nation, [" + ", ".join(f"avg({c})" for c in ALL) + "] AS v FROM z JOIN supplier ON s_suppkey = entity GROUP BY entity"))
def twins(spark, d):
    means = v.features(spark, d).groupBy("entity").agg(*(F.avg(c).alias(c) for c in ALL))
    means = means.join(v.supplier(spark, d).select("entity", "nation"), "entity").select(F.col("entity").alias("id"), F.col("nation").alias("region"), F.array(*ALL).alias("v"))
    return rounded(pro.twins(means, 5), ["d2"])


# external validation
_EXT = {
    "dict": "SELECT s_suppkey AS entity, lpad((s_suppkey // 2 * 2 + CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 2 END)::VARCHAR, 8, '0') AS code8 FROM supplier",
    "codes": "SELECT code8, any_value(entity) AS entity FROM dict GROUP BY code8 HAVING count(*) = 1",
    "ind": "SELECT c_custkey AS id, lpad((c_custkey % 120)::VARCHAR, 8, '0') AS code, lpad((c_custkey % 90)::VARCHAR, 8, '0') AS stable, c_mktsegment AS place, c_acctbal AS value FROM customer",
    "att": "SELECT i.*, coalesce(a.entity, b.entity) AS entity FROM ind i LEFT JOIN codes a ON a.code8 = i.code LEFT JOIN codes b ON b.code8 = i.stable WHERE coalesce(a.entity, b.entity) IS NOT NULL",
}


def indicators(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    code = F.lpad((F.floor(F.col("entity") / 2) * 2 + F.when(F.col("entity") % 5 == 0, 0).otherwise(F.col("entity") % 2)).cast("string"), 8, "0")
    dictionary = s.withColumn("code", F.concat(F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 6), F.lit("-000")))
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") % 120).cast("string"), 8, "0").alias("code"), F.lpad((F.col("c_custkey") % 90).cast("string"), 8, "0").alias("stable"), F.col("c_mktsegment").alias("place"), F.col("c_acctbal").alias("value"))
    return s, dictionary, ext.attach(rows, ext.code_table(dictionary, s))


@query(with_views("", "SELECT id, entity FROM att", **_EXT))
def code_match(spark, d):
    return indicators(spark, d)[2].select("id", "entity")


@query(with_views("", "SELECT code8, count(*)::BIGINT AS n FROM dict GROUP BY code8 HAVING count(*) > 1", **_EXT))
def ambiguous_codes(spark, d):
    members, dictionary, _ = indicators(spark, d)
    return ext.ambiguous_codes(dictionary, members)


@query(with_views("", "SELECT s_suppkey AS entity, round(p, 4) AS population, CASE WHEN p IS NOT NULL THEN round(100 * coalesce(u, 0) / nullif(p, 0), 4) END AS urban_share FROM supplier LEFT JOIN (SELECT entity, sum(value) FILTER (place = 'BUILDING') AS p, sum(value) FILTER (place = 'MACHINERY') AS u FROM att GROUP BY entity) x ON x.entity = s_suppkey", **_EXT))
def urban_share(spark, d):
    members, _, rows = indicators(spark, d)
    return rounded(ext.urban_share(rows, members, "BUILDING", "MACHINERY"), ["population", "urban_share"], 4)


@query(with_views("", "SELECT entity, round(j, 4) AS jobs, round(100 * a / nullif(j, 0), 4) AS s_A, round(100 * b / nullif(j, 0), 4) AS s_B FROM (SELECT entity, sum(value) FILTER (place = 'BUILDING') AS j, sum(value) FILTER (place = 'MACHINERY') AS a, sum(value) FILTER (place = 'HOUSEHOLD') AS b FROM att GROUP BY entity)", **_EXT))
def section_shares(spark, d):
    rows = indicators(spark, d)[2].withColumn("section", mapped(F.col("place"), {"BUILDING": "ALL", "MACHINERY": "A", "HOUSEHOLD": "B"}))
    return rounded(ext.section_shares(rows, ["A", "B"]), ["jobs", "s_A", "s_B"], 4)


@query(with_views("", "SELECT entity, round(sum(value * coalesce(n, 1)) / nullif(sum(coalesce(n, 1)), 0), 6) AS mean FROM (SELECT * FROM att WHERE place = 'BUILDING') a LEFT JOIN (SELECT code, count(*)::DOUBLE AS n FROM att WHERE place = 'MACHINERY' GROUP BY code) w ON w.code = a.code GROUP BY entity", **_EXT))
def weighted_mean(spark, d):
    rows = indicators(spark, d)[2]
    weights = rows.filter("place = 'MACHINERY'").groupBy("code").agg(F.count("*").cast("double").alias("n"))
    return rounded(ext.weighted_mean(rows.filter("place = 'BUILDING'"), weights), ["mean"])


@query(with_views("", "SELECT o_custkey AS entity, o_totalprice AS value FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'O'"))
def indicator_period(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("indicator_period"), F.col("o_totalprice").alias("value"))
    return ext.of_period(o, 1996, "O").select("entity", "value")


@query(with_views("", "SELECT s_suppkey AS entity, round(100 * j / nullif(p, 0), 4) AS jobs_per_100 FROM supplier LEFT JOIN (SELECT entity, sum(value) FILTER (place = 'BUILDING') AS p, sum(value) FILTER (place = 'MACHINERY') AS j FROM att GROUP BY entity) x ON x.entity = s_suppkey", **_EXT))
def jobs_per_100(spark, d):
    members, _, rows = indicators(spark, d)
    jobs = ext.section_shares(rows.withColumn("section", mapped(F.col("place"), {"MACHINERY": "ALL"})), [])
    return rounded(ext.jobs_per_100(jobs, ext.urban_share(rows, members, "BUILDING", "MACHINERY")), ["jobs_per_100"], 4)


_LEVELS = {
    "lv": "SELECT c_mktsegment AS kind, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'goods' ELSE 'other' END AS macro, c_acctbal AS x, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS r FROM customer WHERE c_acctbal IS NOT NULL",
    "lt": "SELECT sum(t * t * t - t) AS ties, sum(t) AS n FROM (SELECT count(*)::DOUBLE AS t FROM lv GROUP BY x)",
    "l1": "SELECT count(*) AS k, sum(s * s / c) AS q FROM (SELECT kind, sum(r) AS s, count(*) AS c FROM lv GROUP BY kind)",
    "l2": "SELECT count(*) AS k, sum(s * s / c) AS q FROM (SELECT macro, sum(r) AS s, count(*) AS c FROM lv GROUP BY macro)",
    "lh": "SELECT n, l1.k AS k1, l2.k AS k2, (12 / (n * (n + 1)) * l1.q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h1, (12 / (n * (n + 1)) * l2.q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h2 FROM lt, l1, l2",
}


@query(with_views("", "SELECT 'balance' AS g, n::BIGINT AS n, k1::BIGINT AS k_kind, round(h1, 5) AS h_kind, round((h1 - k1 + 1) / (n - k1), 8) AS epsilon2_kind, k2::BIGINT AS k_macro, round(h2, 5) AS h_macro, round((h2 - k2 + 1) / (n - k2), 8) AS epsilon2_macro FROM lh", **_LEVELS))
def two_levels(spark, d):
    goods = mapped(F.col("c_mktsegment"), {"BUILDING": "goods", "MACHINERY": "goods"})
    rows = v.table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), F.coalesce(goods, F.lit("other")).alias("macro"), F.col("c_acctbal").alias("balance"))
    out = ext.two_levels(rows, "kind", "macro", ["balance"])
    return rounded(rounded(out, ["h_kind", "h_macro"], 5), ["epsilon2_kind", "epsilon2_macro"], 8)


_KW = {
    "kw": "SELECT 'price' AS g, o_orderpriority AS grp, o_totalprice AS x FROM orders UNION ALL SELECT 'quantity', l_returnflag, l_quantity FROM lineitem UNION ALL SELECT 'tax', l_returnflag, CASE WHEN l_orderkey % 3 = 0 THEN l_tax END FROM lineitem",
    "rk": "SELECT g, grp, x, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS r FROM kw WHERE x IS NOT NULL",
    "tie": "SELECT g, sum(t * t * t - t) AS ties FROM (SELECT g, x, count(*)::DOUBLE AS t FROM kw WHERE x IS NOT NULL GROUP BY ALL) GROUP BY g",
    "res": "SELECT k.g, n, k, share, CASE WHEN share >= 0.5 AND k >= 2 THEN (12 / (n::DOUBLE * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (power(n::DOUBLE, 3) - n)) END AS h FROM (SELECT g, sum(rs * rs / c) AS s, sum(c) AS n, count(*) AS k FROM (SELECT g, grp, sum(r) AS rs, count(*) AS c FROM rk GROUP BY ALL) GROUP BY g) k JOIN tie ON tie.g = k.g JOIN (SELECT g, count(x) / count(*) AS share FROM kw GROUP BY g) c ON c.g = k.g",
}


def kruskal_rows(spark, d):
    o = v.table(spark, d, "orders").select(F.lit("price").alias("g"), F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"))
    line = v.table(spark, d, "lineitem")
    q = line.select(F.lit("quantity").alias("g"), F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"))
    t = line.select(F.lit("tax").alias("g"), F.col("l_returnflag").alias("grp"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax")).alias("x"))
    return o.unionByName(q).unionByName(t)


@query(with_views("", "SELECT g, n::BIGINT AS n, k::BIGINT AS k, round(h, 5) AS h, round((h - k + 1) / (n - k), 8) AS epsilon2, round(share, 6) AS share FROM res", **_KW))
def kruskal_effect(spark, d):
    return rounded(rounded(rounded(val.kruskal(kruskal_rows(spark, d)), ["h"], 5), ["epsilon2"], 8), ["share"])


_P = "SELECT g, k, CASE k WHEN 3 THEN exp(-h / 2) WHEN 5 THEN exp(-h / 2) * (1 + h / 2) END AS p FROM res"  # the tail at 2 and 4 degrees of freedom


@query(with_views("", "SELECT g, k::BIGINT AS k, CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', p) END AS p FROM tail", **_KW, tail=_P))
def kruskal_p(spark, d):
    return ext.with_p(val.kruskal(kruskal_rows(spark, d))).select("g", "k", val.shown_p(F.col("p")).alias("p"))


@query(with_views("", "SELECT g, CASE WHEN e >= 0.14 THEN 'strong' WHEN e < 0.06 THEN 'weak' WHEN e IS NOT NULL THEN 'medium' END AS strength FROM (SELECT g, (h - k + 1) / (n - k) AS e FROM res)", **_KW))
def effect_strength(spark, d):
    return val.kruskal(kruskal_rows(spark, d)).select("g", val.strength(F.col("epsilon2")).alias("strength"))


@query("SELECT o_orderpriority AS kind, round(median(o_totalprice), 4) AS price FROM orders GROUP BY 1 UNION ALL SELECT NULL, round(median(o_totalprice), 4) FROM orders")
def group_medians(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"))
    return rounded(ext.medians(o, "kind", ["price"]), ["price"], 4)
