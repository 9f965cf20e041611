import pytest

from conftest import sorted_rows
from corpusloom.functions import templates
from corpusloom.functions import text as X
from corpusloom.operators import annotation as A
from corpusloom.sources.annotations import Annotations, read_annotations
from pyspark.sql import functions as F


@pytest.fixture
def db(make):
    return Annotations(
        make([(1, "p"), (2, "q"), (3, "unused")], "id bigint, name string"),
        make([(11, 1, 'FCD'), (10, 1, 'No FCD'), (12, 1, 'say "hi"'), (20, 2, "FCD"), (21, 2, "No FCD"), (30, 3, "FCD")],
             "id bigint, project_id bigint, text string"),
        # example 100 carries FCD twice; 102 two labels; 200 and 201 belong to q
        make([(100, 11), (100, 11), (101, 10), (102, 11), (102, 10), (103, 12), (200, 20), (201, 20), (202, 21), (300, 30)],
             "example_id bigint, label_id bigint"),
        make([(100, '{"pdf_file": "a.pdf"}'), (101, "{'pdf_file': 'b.pdf'}"), (102, '{"pdf_file": "c.pdf"}'),
              (103, '{"pdf_file": "d.pdf"}'), (200, '{"pdf_file": "a.pdf"}'), (201, '{"pdf_file": "b.pdf"}'),
              (202, '{"pdf_file": "c.pdf"}'), (300, '{"pdf_file": "a.pdf"}')], "id bigint, meta string"),
    )


def test_label_sets(db):
    assert sorted_rows(A.labels_by_pdf(db, ["p"])) == [
        ("p", "a.pdf", "FCD"), ("p", "b.pdf", "No FCD"), ("p", "c.pdf", "No FCD,FCD"), ("p", "d.pdf", "say 'hi'"),
    ]


def test_missing_project_is_an_error(db):
    with pytest.raises(ValueError, match="project nobody could not be found"):
        A.labels_by_pdf(db, ["p", "nobody"])


def test_pairs_and_agreement(db):
    pairs = A.pair_annotators(A.labels_by_pdf(db, ["p", "q"]), "p", "q")
    assert sorted_rows(pairs) == [("a.pdf", "FCD", "FCD"), ("b.pdf", "No FCD", "FCD"), ("c.pdf", "No FCD,FCD", "No FCD")]
    kept = sorted_rows(A.filter_labels(pairs, templates.AGREEMENT_LABELS))
    assert kept[2] == ("c.pdf", templates.NOT_RELEVANT, "No FCD")
    matrix, stats = A.annotator_agreement(db, "p", "q")
    cells = {(r.label_true, r.label_pred): r.n for r in matrix.collect()}
    assert len(cells) == 16 and cells["FCD", "FCD"] == 1 and cells["No FCD", "FCD"] == 1 and sum(cells.values()) == 2
    assert stats.first().pct_agreement == pytest.approx(50.0)


def test_reading_extracts(db, spark, tmp_path):
    names = {"projects": "projects_project", "label_types": "label_types_categorytype",
             "labels": "labels_category", "examples": "examples_example"}
    for member, table in names.items():
        getattr(db, member).write.parquet(f"{tmp_path}/{table}")
    again = read_annotations(spark, str(tmp_path))
    assert sorted_rows(A.labels_by_pdf(again, ["p"])) == sorted_rows(A.labels_by_pdf(db, ["p"]))


def test_meta_never_runs_as_code(make):
    df = make([("__import__('os').getcwd()",), (None,), ('{"other": 1}',)], "meta string")
    assert [r[0] for r in df.select(X.meta_field(F.col("meta"), "pdf_file")).collect()] == [None, None, None]
