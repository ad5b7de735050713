import json
import random
import threading
import zipfile
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelnet import config
from panelnet.operators import external as ext
from panelnet.plans import export, paths, pipeline
from panelnet.sources import tables
from panelnet.sources.ziprange import open_archive, open_ranges, register
from panelnet.streaming.panel import daily_sums

SF = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_zip_members_are_read_by_ranges_with_pushed_filters(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/data_Y1.csv", "﻿year;level;value;note\n" + "".join(f"{2020 + i % 4};level {i % 2};{i};x\n" for i in range(1000)))
        z.writestr("d/readme.txt", "no")
    register(spark)
    df = spark.read.format("zip_range").option("urls", f"/nowhere.zip {path}").option("member", "Y1").schema("year string, level string, value double").load()
    got = df.filter("year in ('2021', '2023') and contains(level, '1')").collect()
    assert len(got) == 500 and {r.year for r in got} == {"2021", "2023"}
    file, archive = open_archive([str(path)])
    assert archive.namelist()[0] == "d/data_Y1.csv" and 0 < file.fetched <= file.size == open_ranges(str(path)).size
    with pytest.raises(OSError, match="no mirror"):
        open_archive(["/nowhere.zip"])


class Ranged(BaseHTTPRequestHandler):
    """Serves ``data`` by ranges, and breaks off every other response after ``most`` bytes."""

    data, most, asked = b"", 1 << 30, []

    def do_GET(self):  # noqa: N802
        lo, _, hi = self.headers["Range"].removeprefix("bytes=").partition("-")
        size = len(self.data)
        lo, hi = (max(0, size - int(hi)), size) if not lo else (int(lo), int(hi) + 1)
        self.asked.append((lo, hi))
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {lo}-{hi - 1}/{size}")
        self.send_header("Content-Length", str(hi - lo))
        self.end_headers()
        self.wfile.write(self.data[lo:hi][: self.most if len(self.asked) % 2 else None])

    def log_message(self, *_):
        pass


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_members_are_streamed_over_http_and_taken_up_again(tmp_path, method):
    rng, path = random.Random(2), tmp_path / "x.zip"
    body = "a;b\n" + "".join(f"{rng.random()};ж\r\n" for _ in range(40000))
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("big.bin", rng.randbytes(300_000))
        with z.open("d/data_Y1.csv", "w", force_zip64=True) as member:
            member.write(b"\xef\xbb\xbf" + body.encode())
        z.writestr("last.txt", rng.randbytes(100_000))
    Ranged.data, Ranged.most, Ranged.asked = path.read_bytes(), 70_000, []
    server = HTTPServer(("127.0.0.1", 0), Ranged)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        remote, archive = open_archive([f"http://127.0.0.1:{server.server_port}/x.zip"])
        assert "".join(archive.lines("d/data_Y1.csv")) == body
        assert remote.size == len(Ranged.data) and all(lo >= 300_000 for lo, _ in Ranged.asked) and len(Ranged.asked) > 3
    finally:
        server.shutdown()


def test_delimiters_are_found_and_bad_numbers_go(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    assert tables.load_table(spark, str(tmp_path / "a.csv")).columns == ["a", "b"]
    (tmp_path / "i.csv").write_text("year;indicator_value\n2023;1.5\n2023;-\n2022;\n")
    assert [(r.year, r.value) for r in tables.load_indicator(spark, str(tmp_path / "i.csv")).collect()] == [(2023, 1.5)]
    with pytest.raises(ValueError, match="lacks"):
        tables.require(spark.range(1), ["x"], "the table")


def test_codes_fall_back_and_ambiguous_ones_are_not_used(spark):
    members = spark.createDataFrame([(1,), (2,), (3,)], "entity int")
    codes = spark.createDataFrame([(1, "11-111-111-11"), (2, "22222222"), (3, "22222222"), (9, "99999999")], "entity int, code string")
    rows = spark.createDataFrame([("11111111", None, 1.0), ("00000000", "11111111", 2.0), ("22222222", None, 3.0)], "code string, stable string, value double")
    assert sorted((r.entity, r.value) for r in ext.attach(rows, ext.code_table(codes, members)).collect()) == [(1, 1.0), (1, 2.0)]


def test_configuration_is_checked():
    with pytest.raises(ValueError, match="has no"):
        config.Pipeline.of({"panel": {"colour": 1}})
    with pytest.raises(ValueError, match="geo rule"):
        config.Pipeline.of({"network": {"rules": ["geo"]}})
    with pytest.raises(ValueError, match="long or wide"):
        config.Panel(format="tall")


def test_pipeline_from_facts_to_events(spark, tmp_path):
    rows = [(e, date(2023, m, 1), c, float((e * 7 + m * (3 if e % 2 else 1) + k) % 11 + 1)) for e in range(1, 25) for m in range(1, 7) for k, c in enumerate(("food", "home", "all"))]
    rows = [(e, m, c, v + (40 if c == "all" else 0)) for e, m, c, v in rows]
    spark.createDataFrame(rows, "entity long, month date, category string, value double").write.parquet(str(tmp_path / "facts.parquet"))
    c = config.Pipeline.of({"facts": str(tmp_path / "facts.parquet"), "out": str(tmp_path / "out"), "panel": {"total_category": "all"}, "connection": str(tmp_path / "roads.parquet"), "network": {"k": 4, "k_alt": 6, "window": 3, "max_lag": 1, "rules": ["cosine", "corr", "geo", "lag"]}, "dynamics": {"n_clusters": 3, "subsample_repeats": 2}})
    roads = [(a, b, "highway", float(abs(a - b))) for a in range(1, 25) for b in range(a + 1, 25)]
    spark.createDataFrame(roads, "x long, y long, type string, distance double").write.parquet(str(tmp_path / "roads.parquet"))
    assert pipeline.run(spark, c) == ["panel", "network", "clusters", "types", "dynamics", "profiles", "stability"]
    assert spark.read.parquet(f"{c.out}/indices").count() == 7 * 6 and spark.read.parquet(f"{c.out}/stability_types").count() >= 1
    labels = spark.read.parquet(f"{c.out}/labels")
    assert labels.count() == 24 * 6 and {r.type for r in labels.collect()} <= {1, 2, 3}
    assert {r.rule for r in spark.read.parquet(f"{c.out}/edges").select("rule").distinct().collect()} == {"cosine", "corr", "geo", "lag"}
    text = export.report("Types", [("Sizes", spark.read.parquet(f"{c.out}/sizes")), ("Note", "none")])
    assert text.startswith("# Types\n\n## Sizes\n\n| t | n_1") and "none" in text
    export.export_csv(labels, str(tmp_path / "l.csv"))
    assert (tmp_path / "l.csv").read_bytes().startswith(b"\xef\xbb\xbfentity,t,type")


def test_page_holds_the_document(spark):
    page = export.html(spark.createDataFrame([(json.dumps({"title": "</script>", "types": []}),)], "json string"))
    assert export.MARK not in page and "<\\/script>" in page


def test_daily_sums_of_a_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 1, d, 12), "a" if d % 2 else "b", float(d)) for d in (1, 1, 2, 5)]
    spark.createDataFrame(rows, "entity int, ts timestamp, category string, value double").write.parquet(str(tmp_path / "in"))
    stream = daily_sums(spark.readStream.schema("entity int, ts timestamp, category string, value double").parquet(str(tmp_path / "in")), ["a", "b"])
    q = stream.writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.day.day, r.a, r.b) for r in spark.table("daily").collect()} == {(1, 2.0, None), (2, None, 2.0)}


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() >= 1


def _random_vectors(spark, n=40, periods=3):
    rng = random.Random(8)
    return spark.createDataFrame([("base", t, i, [rng.gauss(0, 1) for _ in range(4)]) for t in range(periods) for i in range(n) if (i + t) % 9], "s string, t int, id long, v array<double>")


@pytest.mark.parametrize("spare", [12, -7])
def test_networks_of_subsamples_are_those_sought_anew(spark, monkeypatch, spare):
    """From one search over all entities; with lists that are too short for many, periods are sought anew."""
    monkeypatch.setattr(paths, "SPARE", spare)
    vecs = _random_vectors(spark)
    near, drawn = paths.Neighbours(vecs, 5, 0.8), paths._drawn(vecs, 0.8, 4)
    part = paths.subsamples(vecs, 0.8, 4)
    rows = lambda df: {(r.s, r.t, r.id, tuple(r.v)) for r in df.collect()}
    assert rows(near.part(drawn)) == rows(part)
    edges = lambda df: {(r.s, r.t, r.src, r.dst, round(r.w, 9)) for r in df.collect()}
    assert edges(near.edges(drawn)) == edges(paths.knn(part, 5))


def test_subsamples_in_parts_give_what_all_at_once_give(spark, monkeypatch):
    vecs = _random_vectors(spark)
    base = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, base int")
    got = lambda: [sorted(tuple(round(y, 9) if isinstance(y, float) else y for y in r) for r in x.collect()) for x in paths.subsample_stability(vecs, base, 3, 4, 0.5, 3, repeats=4)]
    whole = got()
    monkeypatch.setattr(paths, "ROWS", 1)
    assert got() == whole and len(whole[0]) == 4


def test_smoothing_shuffles_edges_before_they_are_spread(spark):
    rng = random.Random(2)
    rows = [(f"s{s}", t, a, b, rng.random()) for s in range(2) for t in range(6) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.4]
    edges = spark.createDataFrame(rows, "s string, t int, src long, dst long, w double")
    alpha = F.when(F.col("s") == "s0", 0.3).otherwise(0.0)
    got = paths.smoothed(edges, alpha, 6)
    want = {}
    for s, a in (("s0", 0.3), ("s1", 0.0)):
        now = {}
        for t in range(6):
            new = {(r[2], r[3]): r[4] for r in rows if r[:2] == (s, t)}
            now = {e: (a * now.get(e, 0) + (1 - a) * new.get(e, 0)) if t else new[e] for e in {*now, *new}}
            want |= {(s, t, *e): w for e, w in now.items() if w > 0}
    have = {(r.s, r.t, r.src, r.dst): r.w for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")
