"""Cases that once went wrong: absent truths, Danish answers, appended metrics, all-pairs loss."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import annotation as A
from corpusloom.operators import head as H
from corpusloom.operators import labelling as L
from corpusloom.operators import metrics as M
from corpusloom.operators import pairs as P
from corpusloom.operators import ranking as R
from corpusloom.sources import corpus as S


def test_absent_truths_are_no_class(make):
    rows = [("a", "a", True), ("b", "b", True), (None, "a", True), (None, "b", True)]
    df = make(rows, "label_true string, label_pred string, status boolean")
    for got in (M.classification_metrics(df).first(), M.eval_few_shots(df).first()):
        assert (got.balanced_accuracy, got.f1_score_macro, got.accuracy) == (1.0, 1.0, 1.0)
    assert M.count_unlabelled(df).first()[0] == 2
    codes = make([(0, 0), (1, 1), (-1, 0)], "label_true int, label_pred int")
    assert M.classification_metrics(codes).first().balanced_accuracy == 1.0


def test_danish_answer_is_read_with_the_danish_mark(make):
    strategy = L.STRATEGIES["inquiry_da"]
    df = make([("<<<\nForespørgsel: x\n>>>", "\nKategori: FCD\n")], "prompt string, answer string")
    label, status = strategy.parser(F.col("prompt"), F.col("answer"), ["FCD"])
    assert tuple(df.select(label, status).first()) == ("FCD", True)


def test_two_models_of_one_sample_size_are_both_kept(spark, make, tmp_path):
    path, schema = f"{tmp_path}/metrics", "model string, n_samples bigint, f1_score_macro double"
    for model in ("m1", "m2", "m2"):
        S.append_metrics(make([(model, 1, 0.5)], schema), path)
    assert sorted(r.model for r in S.read_metrics(spark, path).collect()) == ["m1", "m2"]


def test_unreadable_metadata_names_no_report(make):
    examples = make([(1, "{"), (2, None), (3, '{"pdf_file": "x.pdf"}')], "id long, meta string")
    marks = make([(k, [("A", 1, "l")]) for k in (1, 2, 3)], "example_id long, marks array<struct<project:string,label_id:long,label:string>>")
    assert [r.pdf_file for r in A.labelled_examples(examples, marks).collect()] == ["x.pdf"]
    assert A.unreadable_examples(examples) == 2


def test_loss_over_all_pairs_of_nothing_and_of_odd_vectors(make):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [2.0, 0.0], 0), (2, [0.0, 3.0], 0), (3, [1.0, 1.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, 0.0], None)]
    got = P.embedding_loss_over_all(make(rows, schema)).first()
    # positive: three with themselves (0) and 1-2 (1); negative: 1-3 and 2-3 (0.5 each)
    assert got.embedding_loss == pytest.approx((1 / 4 + 0.5) / 2) and (got.n_pairs, got.n_dropped) == (6, 3)
    assert P.embedding_loss_over_all(make([], schema)).first().embedding_loss is None


def test_a_code_past_the_logits_adds_neither_loss_nor_weight(make):
    schema = "logits array<double>, label_code int, weight double"
    rows = [([1.0, 0.0], 0, 1.0), ([0.0, 1.0], 0, 2.0)]
    want = M.weighted_ce(make(rows, schema)).first()
    got = M.weighted_ce(make([*rows, ([1.0, 0.0], 2, 5.0), ([1.0, 0.0], -1, 5.0)], schema)).first()
    assert got.weighted_ce == pytest.approx(want.weighted_ce) and got.n == want.n == 2


@pytest.mark.parametrize("max_rows", [100, 2])
def test_rows_of_no_group_keep_their_positions_when_cut(make, max_rows):
    rows = [(None if k % 2 else "g", k) for k in range(20)]
    df = make(rows, "g string, id bigint").withColumn("h", F.md5(F.col("id").cast("string")))
    want = {}
    for g in ("g", None):
        ids = sorted((r.h, r.id) for r in df.collect() if r.g == g)
        want |= {i: pos for pos, (_, i) in enumerate(ids)}
    found = R.positions_by_hash(df, "g", "h", "id", max_rows=max_rows)
    assert found.columns == ["g", "id", "h", "pos"] and {r.id: r.pos for r in found.collect()} == want


def test_confusion_has_no_cell_of_a_null_label(make):
    cells = M.confusion(make([("a", "a"), ("a", "b"), (None, "a"), ("b", None)], "label_true string, label_pred string"))
    assert sorted(map(tuple, cells.collect())) == [("a", "a", 1), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)]


def test_no_grid_and_no_rounds_are_errors(make):
    with pytest.raises(ValueError):
        H.search_head(None, None, [])
    with pytest.raises(ValueError):
        L.label_with_retry(None, None, None, None, None, None, max_retry=0)


def test_projection_is_centred_with_a_fixed_sign(make):
    rows = [(k, [3.0 + k, 1.0 - 2.0 * k, float(k % 3)]) for k in range(12)]
    got = H.project_2d(make(rows, "vec_id int, embedding array<double>")).collect()
    assert abs(sum(r.x for r in got)) < 1e-9 and abs(sum(r.y for r in got)) < 1e-9
    # the second entry varies most, so its loading is positive: x falls with vec_id
    assert [r.vec_id for r in sorted(got, key=lambda r: -r.x)] == list(range(12))
