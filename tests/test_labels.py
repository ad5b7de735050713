from pyspark.sql import functions as F

from panelnet.operators import labels as lab


def panel(spark, rows):
    return spark.createDataFrame(rows, "entity int, t int, type int")


def test_ties_of_the_modal_type(spark):
    p = panel(spark, [(1, t, k) for t, k in enumerate((2, 1, 1, 2))])
    assert lab.modal(p).first().modal == 1 and lab.modal_latest(p).first().modal == 2


def test_events_count_staying_as_a_destination(spark):
    rows = [(i, 0, 1) for i in range(10)] + [(i, 1, 1 if i < 6 else 2) for i in range(10)] + [(i, t, 2) for i in range(10, 20) for t in (0, 1)]
    assert [(r.t, r.type, r.related) for r in lab.splits(panel(spark, rows)).collect()] == [(1, 1, [1, 2])]
    assert lab.merges(panel(spark, rows)).count() == 0
    moved = panel(spark, [(i, t, 1 + t) for i in range(10) for t in (0, 1)])
    assert lab.splits(moved).count() == 0 and lab.merges(moved).count() == 0


def test_a_gap_gives_no_step(spark):
    assert lab.steps(panel(spark, [(1, 0, 1), (1, 2, 2)])).count() == 0


def test_transition_rows_add_to_one_or_are_missing(spark):
    p = panel(spark, [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 1)])
    got = {(r.a, r.b): r.share for r in lab.transitions(p, [1, 2, 3]).collect()}
    assert got[1, 1] == got[1, 2] == 0.5 and got[1, 3] == 0 and got[3, 1] is None


def test_relabelling_by_size(spark):
    assert {r.label: r.type for r in lab.relabel_by_size(panel(spark, [(i, 0, k) for i, k in enumerate((5, 5, 3, 7))])).collect()} == {5: 1, 3: 2, 7: 3}


def test_paths_and_summary(spark):
    p = panel(spark, [(1, 1, 2), (1, 0, 1), (1, 2, 2)])
    assert lab.label_paths(p).first().path == "122"
    r = lab.entity_summary(p).first()
    assert (r.modal, round(r.share, 3), r.n_changes, r.n_types) == (2, 0.667, 1, 2)
    assert lab.core_table(lab.entity_summary(p)).select(F.col("never_changed")).first()[0] == 0.0
