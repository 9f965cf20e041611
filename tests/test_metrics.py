import math

import pytest
from pyspark.sql import functions as F

from conftest import sorted_rows
from corpusloom.operators import classes as C
from corpusloom.operators import metrics as M

PAIR = "label_true string, label_pred string"


def metrics(df):
    return tuple(M.classification_metrics(df).first())


def test_hand_computed(make):
    df = make([("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], PAIR)
    balanced, f1, accuracy = metrics(df)
    assert balanced == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert f1 == pytest.approx((4 / 6 + 2 / 3 + 0) / 3)
    assert accuracy == pytest.approx(3 / 5)


def test_class_absent_from_truth_counts_for_f1_only(make):
    balanced, f1, _ = metrics(make([("a", "a"), ("a", "z")], PAIR))
    assert balanced == pytest.approx(0.5)
    assert f1 == pytest.approx((2 / 3 + 0) / 2)


def test_empty_input_gives_nulls(make):
    assert metrics(make([], PAIR)) == (None, None, None)


def test_metrics_ignore_row_order_and_partitioning(make):
    rows = [(f"c{i % 4}", f"c{(i * i) % 4}") for i in range(200)]
    assert metrics(make(rows, PAIR)) == pytest.approx(metrics(make(rows[::-1], PAIR).repartition(9)))


def test_confusion_fills_empty_cells(make):
    df = make([("a", "b"), ("a", "b"), ("c", "c")], PAIR)
    got = {(r.label_true, r.label_pred): r.n for r in M.confusion(df).collect()}
    assert len(got) == 9 and got["a", "b"] == 2 and got["c", "c"] == 1 and sum(got.values()) == 3


def test_confusion_restricted_to_labels(make):
    df = make([("a", "a"), ("a", "x"), ("x", "b"), ("b", "a")], PAIR)
    got = {(r.label_true, r.label_pred): r.n for r in M.confusion(df, labels=["a", "b"]).collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}


def test_valid_rows_only(make):
    rows = [("a", "a", True), ("b", "INVALID LABEL: 1", False), ("b", "INVALID LABEL: 2", False), ("b", "a", True)]
    got = M.eval_few_shots(make(rows, PAIR + ", status boolean")).first()
    assert (got.n_valid, got.n_invalid) == (2, 2)
    assert got.balanced_accuracy == pytest.approx(0.5) and got.accuracy == pytest.approx(0.5)
    none = M.eval_few_shots(make(rows[1:3], PAIR + ", status boolean")).first()
    assert (none.n_valid, none.n_invalid, none.f1_score_macro) == (0, 2, None)


def test_metrics_per_run(make):
    df = make([(1, "a", "a"), (1, "b", "b"), (2, "a", "b"), (2, "b", "b")], "n_samples int, " + PAIR)
    got = {r.n_samples: r.accuracy for r in M.metrics_by(df, "n_samples").collect()}
    assert got == {1: 1.0, 2: 0.5}


def test_report_per_model_and_project(make):
    rows = [("m", "p", "a", "a", True), ("m", "q", "a", "b", True), ("m", "q", "a", "?", False)]
    got = M.metrics_table(make(rows, "model string, project string, " + PAIR + ", status boolean"))
    assert {(r.model, r.project): (r.n_valid, r.n_invalid, r.accuracy) for r in got.collect()} == {
        ("m", "p"): (1, 0, 1.0), ("m", "q"): (1, 1, 0.0),
    }


def test_first_rows(spark):
    assert [r.doc_id for r in M.first_rows(spark.range(99, -1, -1).withColumnRenamed("id", "doc_id")).collect()] == [0, 1, 2, 3, 4]


def test_best_run_takes_the_first_on_ties(make):
    df = make([(3, 0.7), (1, 0.5), (2, 0.7)], "n_samples bigint, f1_score_macro double")
    assert tuple(M.best_run(df).first()) == (2, 0.7)


def agreement(make, rows, labels=("x", "y")):
    return tuple(M.agreement(make(rows, "a string, b string"), "a", "b", labels).first())


def test_kappa_by_hand(make):
    rows = [("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15 + [("x", "other")] * 9
    n, kappa, pct = agreement(make, rows)
    assert n == 50 and kappa == pytest.approx(0.4) and pct == pytest.approx(70.0)


def test_kappa_is_undefined_for_one_class_and_for_nothing(make):
    assert agreement(make, [("x", "x")] * 3) == (3, None, 100.0)
    assert agreement(make, []) == (0, None, None)


def test_misclassified(make):
    pred = make([(1, "a", "a"), (2, "a", "b")], "doc_id bigint, " + PAIR)
    corpus = make([(1, "t1"), (2, "t2")], "doc_id bigint, text string")
    assert sorted_rows(M.misclassified(pred, corpus)) == [(2, "t2", "a", "b")]


def test_weighted_cross_entropy(make):
    rows = [([2.0, 0.0], 0, 0.5), ([0.0, 1000.0], 1, 2.0), ([5.0, 5.0], -1, 9.0)]
    got = M.weighted_ce(make(rows, "logits array<double>, label_code bigint, weight double")).first()
    assert got.n == 2
    assert got.weighted_ce == pytest.approx(0.5 * math.log(1 + math.exp(-2)) / 2.5)


def test_weighted_bce(make):
    rows = [([0.0, 800.0], [1.0, 0.0], [1.0, 0.5])]
    got = M.weighted_bce(make(rows, "logits array<double>, targets array<double>, weights array<double>")).first()
    assert got.weighted_bce == pytest.approx((math.log(2) + 400) / 2)


# -- classes -------------------------------------------------------------------

CORPUS = [(5, "b"), (1, "c"), (2, "b"), (3, None), (9, "a"), (4, "c")]


def test_codes_follow_first_appearance(make):
    df = make(CORPUS, "doc_id bigint, label string")
    classes = C.class_table(df)
    assert sorted_rows(classes) == [(0, "c", 2), (1, "b", 2), (2, "a", 1)]
    coded = {r.doc_id: r.label_code for r in C.factorize(df, classes).collect()}
    assert coded == {1: 0, 2: 1, 3: -1, 4: 0, 5: 1, 9: 2}
    back = C.decode_label(C.factorize(df, classes).drop("label"), classes)
    assert {r.doc_id: r.label_text for r in back.collect()} == dict(CORPUS)
    assert C.label_list(df, "doc_id") == ["c", "b", "a"]


def test_many_classes_stay_distributed(make, spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("c"), F.col("id") % 40).alias("label"))
    small, large = C.class_table(df), C.class_table(df, max_local=10)
    assert sorted_rows(small) == sorted_rows(large)


def test_weights_sum_to_the_number_of_classes(make):
    df = make(CORPUS, "doc_id bigint, label string")
    coded = C.factorize(df, C.class_table(df))
    weights = C.class_weights(coded)
    assert weights.agg(F.sum(F.col("n") * F.col("weight"))).first()[0] == pytest.approx(3)
    weighted = C.with_class_weight(coded, weights)
    assert {r.doc_id: r.weight for r in weighted.collect()} == {1: 0.5, 2: 0.5, 4: 0.5, 5: 0.5, 9: 1.0}
    assert C.min_class_support(coded).first()[0] == 1


def test_category_summary(make):
    df = make(CORPUS, "doc_id bigint, label string")
    assert [r.summary for r in sorted(C.category_summary(C.class_table(df)).collect())] == [" c (n=2)", " b (n=2)", " a (n=1)"]
