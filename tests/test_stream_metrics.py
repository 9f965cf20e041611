"""Streamed metrics against the batch query, in pieces, with repeats and after a restart."""

import datetime as dt
import random

import pytest

from conftest import sorted_rows
from corpusloom.operators import metrics as M
from corpusloom.streaming import metrics as S

SCHEMA = "run string, doc_id bigint, label_true string, label_pred string, status boolean, at timestamp"
START = dt.datetime(2024, 5, 1, 12)


def answers(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        status = r.random() > 0.1
        rows.append((r.choice(["a", "b", None]), k, r.choice(["x", "y", "z", None]),
                     r.choice(["x", "y", "z"]) if status else f"free text {k}", status,
                     START + dt.timedelta(seconds=r.randrange(1800))))
    return rows


def kept(spark, folder, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    cells = S.confusion_stream(stream, ["run"], ["doc_id"])
    query = S.append_cells(cells, f"{tmp_path}/cells", f"{tmp_path}/progress")
    query.awaitTermination(120)
    return S.read_cells(spark, f"{tmp_path}/cells", ["run"])


def test_stream_equals_batch_after_restart(spark, make, tmp_path):
    folder = f"{tmp_path}/in"
    first, second = answers(60, 1), answers(150, 2)[60:]
    make(first, SCHEMA).repartition(2).write.parquet(folder)
    cells = kept(spark, folder, tmp_path)
    batch = lambda rows: sorted_rows(M.eval_few_shots(make(rows, SCHEMA), ["run"]).na.fill("-", ["run"]))
    told = lambda cells: sorted_rows(S.cell_metrics(cells, ["run"]).na.fill("-", ["run"]))
    assert told(cells) == [pytest.approx(row) for row in batch(first)]
    # answers sent again, some of them changed, and new ones
    again = [(*row[:3], "x", True, row[5] + dt.timedelta(minutes=1)) for row in first[:20]]
    make(second + again, SCHEMA).repartition(2).write.mode("append").parquet(folder)
    cells = kept(spark, folder, tmp_path)
    assert told(cells) == [pytest.approx(row) for row in batch(first + second)]
    assert cells.where("not status").select("label_pred").distinct().collect() == [(None,)]
    before = sorted_rows(cells.na.fill("-", ["run", "label_pred"]))
    cells = kept(spark, folder, tmp_path)  # nothing new
    assert sorted_rows(cells.na.fill("-", ["run", "label_pred"])) == before


def test_answers_without_a_time_or_too_late(spark, make, tmp_path):
    folder = f"{tmp_path}/in"
    rows = answers(20, 3)
    make(rows, SCHEMA).coalesce(1).write.parquet(folder)
    kept(spark, folder, tmp_path)
    late = [("a", 900, "x", "x", True, START - dt.timedelta(days=1)), ("a", 901, "x", "x", True, None)]
    make(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    found = S.cell_metrics(kept(spark, folder, tmp_path), ["run"])
    want = M.eval_few_shots(make(rows, SCHEMA), ["run"])
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
