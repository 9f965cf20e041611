import json

import pytest
from pyspark.sql import functions as F

from conftest import sorted_rows
from corpusloom.sources import corpus as S
from corpusloom.streaming import answers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_reading_a_corpus(spark, tmp_path):
    body = 'text,label\n"two\nlines, ""quoted""",a\nNA,b\n,c\n" spaced ",\n"NaN",a\nlast,null\n"None",x\n'
    rows = S.read_corpus(spark, write(tmp_path / "p.csv", body)).orderBy("doc_id").collect()
    assert [(r.text, r.label) for r in rows] == [('two\nlines, "quoted"', "a"), (" spaced ", None), ("last", None)]
    assert [r.doc_id for r in rows] == [0, 3, 5]


def test_columns_are_found_by_name(spark, tmp_path):
    rows = S.read_corpus(spark, write(tmp_path / "p.csv", "label,extra,text\na,1,t\n")).collect()
    assert [(r.text, r.label) for r in rows] == [("t", "a")]


def test_parts(spark, tmp_path):
    for name in ("clinical_notes", "radiology_reports"):
        for part in (1, 2, 3):
            write(tmp_path / f"anonymized_{name}_part{part}.csv", f'text\n"{name}\n{part}"\nsecond\n')
    both = S.read_parts(spark, ["clinical_notes", "radiology_reports", "other"], str(tmp_path))
    assert both.count() == 12 and both.select("row_id").distinct().count() == 12
    one = S.read_parts(spark, ["radiology_reports"], str(tmp_path))
    assert {r.part for r in one.collect()} == {f"radiology_reports_part{p}" for p in (1, 2, 3)}
    with pytest.raises(ValueError, match="no valid dataset specified"):
        S.read_parts(spark, ["eeg"], str(tmp_path))


def test_texts_survive_a_csv_round_trip(spark, make, tmp_path):
    texts = ['a,"b"\n c\r\n', "  lead and trail  ", "back\\slash \\\" quote", "tab\there", "æøå ​", '"']
    make([(t,) for t in texts], "text string").coalesce(1).write.options(**S.CSV_OPTIONS).csv(f"{tmp_path}/t")
    got = spark.read.options(**S.CSV_OPTIONS).csv(f"{tmp_path}/t")
    assert sorted(r.text for r in got.collect()) == sorted(texts)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_replace_only_their_own_run(spark, make, tmp_path, fmt):
    schema = "n_samples bigint, label_true string, label_pred string, status boolean"
    path = f"{tmp_path}/results"
    S.write_results(make([(1, "a", "INVALID LABEL: x\ny", False), (2, "a", "a", True)], schema), path, fmt)
    S.write_results(make([(2, "a", "b", True)], schema), path, fmt)
    reader = spark.read.options(**S.CSV_OPTIONS) if fmt == "csv" else spark.read
    got = reader.format(fmt).load(path).select("n_samples", "label_pred")
    assert sorted_rows(got) == [(1, "INVALID LABEL: x\ny"), (2, "b")]


def test_metrics_grow_and_pending_runs_shrink(spark, make, tmp_path):
    path = f"{tmp_path}/metrics"
    grid = S.shot_grid(spark, 1, 4)
    assert S.read_metrics(spark, path) is None
    assert S.pending_runs(grid, None).count() == 4
    schema = "n_samples bigint, balanced_accuracy double, f1_score_macro double"
    S.append_metrics(make([(1, 0.5, 0.4)], schema), path)
    S.append_metrics(make([(3, 0.6, 0.5)], schema), path)
    S.append_metrics(make([(3, 0.6, 0.5)], schema), path)  # a repeated run adds nothing
    done = S.read_metrics(spark, path)
    assert done.count() == 2
    assert sorted_rows(S.pending_runs(grid, done)) == [(2,), (4,)]


def test_shot_grid_from_a_list(spark):
    assert sorted_rows(S.shot_grid(spark, listed="1, 5,10")) == [(1,), (5,), (10,)]


def test_best_params(spark, make, tmp_path):
    path = f"{tmp_path}/best"
    S.write_best_params(make([("FCD", 0.003, 50, 8)], "project_name string, head_learning_rate double, num_epochs int, batch_size int"), path)
    assert S.read_best_params(spark, path).first().asDict() == {
        "project_name": "FCD", "head_learning_rate": 0.003, "num_epochs": 50, "batch_size": 8,
    }
    lines = [p for p in (tmp_path / "best").iterdir() if p.suffix == ".json" and p.stat().st_size]
    assert json.loads(lines[0].read_text())["num_epochs"] == 50


def test_saved_splits(spark, make, tmp_path):
    path = f"{tmp_path}/splits"
    S.write_splits(make([("train", "a", 0), ("test", "b", 1)], "split string, text string, label int"), path)
    test = S.read_splits(spark, path, "test")
    assert [(r.text, r.label) for r in test.collect()] == [("b", 1)]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def test_run_names(spark):
    assert spark.range(1).select(S.run_name("rate", F.lit(3), F.lit(0.000123))).first()[0] == "trial-3_rate-1.23e-04"


# -- streams -----------------------------------------------------------------------

def drain(stream, spark, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_corpus_stream(spark, tmp_path):
    write(tmp_path / "a.csv", 'doc_id,text,label\n1,"two\nlines",a\n2,NA,b\n')
    write(tmp_path / "b.csv", "doc_id,text,label\n3,t u v,null\n")
    stream = answers.tokens_stream(answers.corpus_stream(spark, str(tmp_path)), max_length=2)
    got = drain(stream, spark, "corpus_rows")
    assert sorted_rows(got.select("doc_id", "tokens", "label")) == [(1, ["two", "lines"], "a"), (3, ["t", "u"], None)]


def test_answers_on_a_stream_equal_the_batch(spark, make, tmp_path):
    rows = [(1, ">>>\nCategory: a\n"), (2, ">>>\nCategory: b\n"), (3, "none")]
    make(rows, "id int, generated_text string").write.parquet(f"{tmp_path}/g")
    batch = spark.read.parquet(f"{tmp_path}/g")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/g")
    got = drain(answers.checked_answers(stream, ["a"]), spark, "answers")
    assert sorted_rows(got) == sorted_rows(answers.checked_answers(batch, ["a"]))
    assert [r.status for r in got.orderBy("id").collect()] == [True, False, False]


def test_predictions_on_a_stream(spark, make, tmp_path):
    make([([0.0, 2.0],)], "logits array<double>").write.parquet(f"{tmp_path}/l")
    stream = spark.readStream.schema("logits array<double>").parquet(f"{tmp_path}/l")
    row = drain(answers.predicted_classes(stream), spark, "classes").first()
    assert row.pred_code == 1 and row.pred_prob == pytest.approx(0.880797, abs=1e-6)
