import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import sorted_rows
from corpusloom.operators import classes as C
from corpusloom.operators import labelling as L


@pytest.fixture
def train(spark):
    code = F.col("id") % 2
    return spark.range(40).select(
        F.col("id").alias("doc_id"), code.alias("label_code"),
        F.when(code == 0, "yes").otherwise("no").alias("label_text"), F.concat(F.lit("t"), "id").alias("text"),
    )


@pytest.fixture
def queries(spark):
    return spark.range(100, 130).select(F.col("id").alias("query_id"), F.concat(F.lit("query"), "id").alias("text"))


def run(queries, train, strategy, scorer, **options):
    return L.label_with_retry(queries, train, train, C.coded_classes(train), L.STRATEGIES[strategy], scorer, **options)


def logging_scorer(folder, answer):
    """Answers with ``answer(prompt)`` and leaves one line per request in ``folder``."""
    def factory(**sampling):
        def batch(prompts: pd.Series) -> pd.Series:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.writelines(p.split("query")[-1][:3] + "\n" for p in prompts)
            return prompts.map(answer)

        return batch

    return factory


def requests(folder):
    seen = {}
    for name in os.listdir(folder):
        for line in open(os.path.join(folder, name)):
            seen[int(line)] = seen.get(int(line), 0) + 1
    return seen


def test_valid_rows_are_asked_once(queries, train, tmp_path):
    def answer(prompt):
        return "yes" if int(prompt.split("query")[-1][:3]) < 120 else "never"

    got = run(queries, train, "inst", logging_scorer(str(tmp_path), answer), n=1, max_retry=4).collect()
    assert len(got) == 30
    assert {r.query_id for r in got if r.status} == set(range(100, 120))
    assert all(r.label_pred == "INVALID LABEL: never" and r.attempt == 3 for r in got if not r.status)
    seen = requests(str(tmp_path))
    assert all(seen[q] == (1 if q < 120 else 4) for q in range(100, 130))


def test_stops_when_all_are_valid(queries, train, tmp_path):
    got = run(queries, train, "inst", logging_scorer(str(tmp_path), lambda p: "no"), n=2)
    assert {r.attempt for r in got.collect()} == {0} and set(requests(str(tmp_path)).values()) == {1}


def test_a_changing_scorer_agrees_with_itself(queries, train):
    def factory(**_):
        import random

        return lambda batch: batch.map(lambda p: random.choice(["yes", "no", "other"]))

    got = run(queries, train, "inst", factory, n=1, max_retry=3)
    assert sorted_rows(got) == sorted_rows(got)
    assert got.select("query_id").distinct().count() == got.count() == 30


def test_no_examples(queries, train):
    got = run(queries, train, "im", L.template_scorer("yes"), n=0, max_retry=2)
    assert got.filter("status").count() == 30


def test_a_slow_scorer_gets_small_tasks(queries, train, tmp_path):
    scorer = logging_scorer(str(tmp_path), lambda p: "yes")
    assert run(queries, train, "inst", scorer, n=1, rows_per_task=5).filter("status").count() == 30
    assert len(os.listdir(tmp_path)) > 1 and set(requests(str(tmp_path)).values()) == {1}


def test_category_strategy(queries, train):
    scorer = L.template_scorer("\nCategory: no\n")
    assert {r.label_pred for r in run(queries, train, "inquiry", scorer, n=1).collect()} == {"no"}
    bad = run(queries, train, "inquiry", L.template_scorer("\nCategory: no"), n=1, max_retry=1).first()
    assert bad.label_pred.startswith("INVALID OUTPUT MATCH: You are") and not bad.status
    odd = run(queries, train, "inquiry", L.template_scorer("\nCategory: x\n"), n=1, max_retry=1).first()
    assert odd.label_pred.startswith("INVALID LABEL: You are") and not odd.status


def test_without_a_check_any_readable_answer_is_valid(queries, train):
    got = run(queries, train, "inst", L.template_scorer("free text"), n=1, check=False)
    assert {(r.label_pred, r.status) for r in got.collect()} == {("free text", True)}
    unread = run(queries, train, "inquiry", L.template_scorer("free text"), n=1, max_retry=1, check=False)
    assert unread.filter("status").count() == 0


def test_chat_strategy_passes_its_sampling(queries, train):
    def factory(max_new_tokens, temperature, top_p):
        assert (max_new_tokens, temperature, top_p) == (256, 0.6, 0.9)
        return lambda batch: batch.map(lambda p: "no" if p.startswith("system: ") else "?")

    assert run(queries, train, "messages", factory, n=1, max_retry=1).filter("status").count() == 30


def test_validation_does_not_trim(make):
    classes = make([(0, "a", 1)], "label_code bigint, label_text string, n bigint")
    df = make([(1, "a"), (2, " a"), (3, "a\n"), (4, None)], "id int, label_pred string")
    got = {r.id: (r.label_pred, r.status) for r in L.validate_labels(df, classes).collect()}
    assert got == {1: ("a", True), 2: ("INVALID LABEL:  a", False), 3: ("INVALID LABEL: a\n", False), 4: (None, False)}


def test_map_text_replaces_one_column(make):
    df = make([(1, "hej", "x"), (2, "dag", "y")], "id bigint, text string, label string")
    got = L.map_text(df, L.template_scorer("[{}]"))
    assert got.columns == df.columns and sorted_rows(got) == [(1, "[<2en> hej]", "x"), (2, "[<2en> dag]", "y")]


def test_last_message(make):
    df = make([(1, 0, "user", "q"), (1, 2, "assistant", "b"), (1, 1, "assistant", "a"), (2, 0, "user", "z")],
              "conv_id int, turn int, role string, text string")
    assert sorted_rows(L.last_messages(df)) == [(1, "assistant", "b"), (2, "user", "z")]


def test_a_scorer_is_given_few_bytes_at_once(spark, monkeypatch):
    monkeypatch.setattr(L, "REQUEST_BYTES", 5000)

    def factory(**_):
        # answers keep their rows by index, in whatever order they come
        return lambda asked: asked.map(lambda p: f"{'' if p is None else p[-5:]} {int(asked.fillna('').str.len().sum())} {len(asked)}")[::-1]

    text = F.when(F.col("id") == 7, F.repeat(F.lit("y"), 9000)).when(F.col("id") != 8, F.concat(F.repeat(F.lit("x"), 1000), F.col("id") + 10000))
    asked = spark.range(40, numPartitions=1).select(F.when(F.col("id") != 9, F.col("id") + 2**60).alias("query_id"), text.alias("prompt"))
    for got in (L.generate(asked, factory).select("query_id", "prompt", "completion").collect(),
                [(r.query_id, None, r.prompt) for r in L.map_text(asked, factory, "", text="prompt").collect()]):
        assert [r[0] for r in got] == [None if k == 9 else k + 2**60 for k in range(40)]
        for k, (_, _, told) in enumerate(got):
            end, total, rows = told.split(" ")
            assert end == {7: "yyyyy", 8: ""}.get(k, str(10000 + k))
            assert int(total) <= 5000 or (int(total) == 9000 and int(rows) == 1)
