import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelnet.functions.columns import albers, code8, month_of, section
from panelnet.operators import panel as pan

M1, M2 = date(2023, 1, 1), date(2023, 2, 1)


def test_interpolation_fills_the_first_cells_of_inner_gaps(spark):
    rows = [(1, t, x) for t, x in enumerate([None, 1.0, None, None, None, 5.0, None, 7.0, None])]
    out = pan.interpolate(spark.createDataFrame(rows, "entity int, t int, x double"), ["x"], 2).orderBy("t").collect()
    assert [r.x for r in out] == [None, 1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, None]


def test_pivots_treat_missing_values_apart(spark):
    rows = spark.createDataFrame([(1, M1, "a", None), (1, M1, "b", 2.0), (1, M2, "a", 3.0)], "entity int, month date, category string, value double")
    total = {r.month: (r.a, r.b) for r in pan.pivot_sum(rows, ["a", "b"]).collect()}
    mean = {r.month: (r.a, r.b) for r in pan.pivot_mean(rows, ["a", "b"]).collect()}
    assert total == {M1: (0.0, 2.0), M2: (3.0, None)}
    assert mean == {M1: (None, 2.0), M2: (3.0, None)}


def test_grid_keeps_covered_entities_and_every_period(spark):
    wide = spark.createDataFrame([(1, M1, 1.0), (1, M2, 2.0), (2, M1, 3.0)], "entity int, month date, a double")
    assert [(r.entity, r.t) for r in pan.complete_grid(wide, 1.0).orderBy("entity", "t").collect()] == [(1, 0), (1, 1)]
    assert pan.complete_grid(wide, 0.5).count() == 4


def test_constant_feature_has_z_score_zero(spark):
    rows = spark.createDataFrame([(1, M1, 5.0), (2, M1, 5.0)], "entity int, month date, x double")
    assert {r.x for r in pan.standardise(rows, ["x"]).collect()} == {0.0}


def test_open_version_is_the_latest(spark):
    rows = spark.createDataFrame([(1, 2020, 1), (1, None, 2), (1, 2021, 3)], "key int, until int, id int")
    assert pan.latest_version(rows, "key", "until", "id").first().id == 2


def test_residual_share_is_clipped_and_percentages_are_not(spark):
    rows = spark.createDataFrame([(1, M1, 8.0, 4.0, 10.0)], "entity int, month date, a double, b double, tot double")
    assert pan.shares(rows, ["a", "b", "tot"], "tot").first().other_share == 0.0
    assert math.isclose(pan.percent_shares(rows, ["a", "b", "tot"], "tot").first().other_pct, -20.0)


def test_log_of_a_static_attribute_that_is_not_positive_is_missing(spark):
    rows = spark.createDataFrame([(1,), (2,)], "entity int")
    dim = spark.createDataFrame([(1, 0.0), (2, 1.0)], "entity int, x double")
    out = pan.attach_static(rows, dim, ["x"], log=True)
    assert {r.entity: r.x for r in out.collect()} == {1: None, 2: 0.0}
    assert pan.without_missing(out, ["x"]).count() == 1


def test_binding_a_missing_column_fails(spark):
    with pytest.raises(ValueError, match="no column"):
        pan.bind(spark.range(1), entity="nobody")


def test_codes_sections_months_and_projection(spark):
    row = spark.createDataFrame([("12-345-678-90", "Раздел А прочее", "Всего", 202301, "2023-05", 100.0, 56.0)], "c string, s string, o string, m int, t string, lon double, lat double")
    x, y = albers(F.col("lon"), F.col("lat"))
    r = row.select(code8(F.col("c")), section(F.col("s")), section(F.col("o")), month_of(F.col("m"), "number"), month_of(F.col("t"), "text"), x, y).first()
    assert tuple(r)[:5] == ("12345678", "A", "ALL", date(2023, 1, 1), date(2023, 5, 1))
    assert abs(r[5]) < 1e-12 and abs(r[6]) < 1e-12
