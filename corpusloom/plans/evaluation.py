"""Queries on predictions, annotators and generated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import annotation as A
from corpusloom.operators import classes as C
from corpusloom.operators import labelling as L
from corpusloom.operators import metrics as M
from corpusloom.plans.sql import with_ctes
from corpusloom.session import shared_path
from corpusloom.sources import corpus as S
from corpusloom.sources import derived as D
from corpusloom.streaming import metrics as streamed

METRICS = ("balanced_accuracy", "f1_score_macro", "accuracy")


def _rounded(df, columns=METRICS):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _valid(spark, sf_dir):
    return D.predictions(spark, sf_dir).filter("status")


def confusion_matrix(spark, sf_dir):
    return M.confusion(_valid(spark, sf_dir))


def classification_metrics(spark, sf_dir):
    return _rounded(M.classification_metrics(_valid(spark, sf_dir)))


def few_shot_metrics(spark, sf_dir):
    return _rounded(M.eval_few_shots(D.predictions(spark, sf_dir)))


def metrics_by_run(spark, sf_dir):
    return _rounded(M.metrics_by(D.run_predictions(spark, sf_dir).filter("status"), "n_samples"))


def metrics_stream(spark, sf_dir):
    """The metrics of every run, kept up by a stream that gets a tenth of the answers twice."""
    runs = D.run_predictions(spark, sf_dir)
    seconds = F.pmod(F.xxhash64("doc_id", "n_samples"), F.lit(3600))
    runs = runs.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + seconds))
    again = runs.where(seconds % 10 == 0).withColumn("at", F.col("at") + F.expr("interval 1 minute"))
    sent, source = runs.unionByName(again), shared_path(spark, "answers")
    sent.write.parquet(source)
    at_once = spark.conf.get("spark.sql.shuffle.partitions")
    files = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", at_once).parquet(source)
    cells = streamed.confusion_stream(files, ["n_samples"], ["doc_id"], delay="2 hours")
    path = shared_path(spark, "cells")
    streamed.append_cells(cells, path, shared_path(spark, "progress")).awaitTermination()
    found = streamed.cell_metrics(streamed.read_cells(spark, path, ["n_samples"]), ["n_samples"])
    return _rounded(found.drop("n_valid", "n_invalid"))


def metrics_table(spark, sf_dir):
    """A report per model and project: the runs as models, the languages as projects."""
    project = D.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("project"))
    model = F.concat(F.lit("shots-"), F.col("n_samples"))
    runs = D.run_predictions(spark, sf_dir).join(project, "doc_id").withColumn("model", model)
    return _rounded(M.metrics_table(runs))


def best_run(spark, sf_dir):
    runs = M.metrics_by(D.run_predictions(spark, sf_dir).filter("status"), "n_samples")
    return _rounded(M.best_run(runs), ("f1_score_macro",))


def pending_runs(spark, sf_dir):
    ids = D.corpus(spark, sf_dir).select("doc_id")
    grid = ids.withColumn("n_samples", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8))))
    done = D.run_predictions(spark, sf_dir).filter("status")
    return S.pending_runs(grid, done, ("doc_id", "n_samples"))


def misclassified(spark, sf_dir):
    wrong = M.misclassified(_valid(spark, sf_dir), D.corpus(spark, sf_dir))
    return wrong.select("doc_id", F.md5("text").alias("text_md5"), "label_true", "label_pred")


def validate_labels(spark, sf_dir):
    classes = C.class_table(D.corpus(spark, sf_dir))
    answers = D.predictions(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("status"), F.col("label_pred")).otherwise(F.concat(F.lit(" "), "label_true")).alias("label_pred"),
    )
    return L.validate_labels(answers, classes).select("doc_id", "label_pred", "status")


def annotation_labels(spark, sf_dir):
    return A.labels_by_pdf(D.annotations(spark, sf_dir), ["A", "B"])


def _pairs(spark, sf_dir):
    return A.pair_annotators(annotation_labels(spark, sf_dir), "A", "B")


def annotator_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def label_filter(spark, sf_dir):
    return A.filter_labels(_pairs(spark, sf_dir), D.CORPUS_CLASSES)


def agreement_matrix(spark, sf_dir):
    return M.confusion(label_filter(spark, sf_dir), "labels_a", "labels_b", D.CORPUS_CLASSES)


def cohen_kappa(spark, sf_dir):
    stats = M.agreement(label_filter(spark, sf_dir), "labels_a", "labels_b", D.CORPUS_CLASSES)
    return _rounded(stats, ("kappa", "pct_agreement"))


def parse_suffix(spark, sf_dir):
    answers = D.generations(spark, sf_dir)
    return answers.select("doc_id", X.parse_suffix(F.col("prompt"), F.col("generated_text")).alias("suffix"))


def parse_category(spark, sf_dir):
    label, status = L.parse_generated(F.col("generated_text"), D.CORPUS_CLASSES)
    return D.generations(spark, sf_dir).select(
        "doc_id",
        X.parse_category(F.col("generated_text")).alias("category"),
        F.md5(label).alias("label_md5"),
        status.alias("status"),
    )


def parse_last_message(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    last = L.last_messages(turns)
    return last.select("conv_id", "role", F.md5("content").alias("content_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, classification_metrics, few_shot_metrics, metrics_by_run, metrics_stream, metrics_table, best_run, pending_runs,
        misclassified, validate_labels, annotation_labels, annotator_pairs, label_filter, agreement_matrix,
        cohen_kappa, parse_suffix, parse_category, parse_last_message,
    )
}


def _per_class(source: str, by: str = "") -> dict[str, str]:
    """CTEs from a predictions table to per-class counts and metrics per ``by``."""
    return {
        "sides": f"select {by} label_true as c, cast(label_true = label_pred as bigint) as tp, 1 as s, 0 as p from {source}"
                 f" union all select {by} label_pred, 0, 0, 1 from {source}",
        "per_class": f"select {by} c, cast(sum(tp) as double) as tp, sum(s) as s, sum(p) as p from sides group by all",
    }


_METRICS = """round(avg(case when s > 0 then tp / s end), 6) as balanced_accuracy,
  round(avg(2 * tp / (s + p)), 6) as f1_score_macro, round(sum(tp) / sum(s), 6) as accuracy"""
_FOUR = "('good', 'bad', 'good_toxic', 'bad_toxic')"
_LISTED = f"select * from filtered where labels_a in {_FOUR} and labels_b in {_FOUR}"
_CATEGORY = "concat('>>>', chr(10), 'Category: ([^', chr(10), ']*)', chr(10))"

ORACLES = {
    "confusion_matrix": with_ctes(
        "predictions",
        "select t.l as label_true, p.l as label_pred, count(v.doc_id) as n from axis t cross join axis p"
        " left join valid v on v.label_true = t.l and v.label_pred = p.l group by all",
        valid="select * from predictions where status",
        axis="select label_true as l from valid union select label_pred from valid",
    ),
    "classification_metrics": with_ctes(
        "predictions", f"select {_METRICS} from per_class",
        valid="select * from predictions where status", **_per_class("valid"),
    ),
    "few_shot_metrics": with_ctes(
        "predictions",
        f"select (select count(*) from valid) as n_valid, (select count(*) from predictions where not status)"
        f" as n_invalid, {_METRICS} from per_class",
        valid="select * from predictions where status", **_per_class("valid"),
    ),
    "metrics_by_run": with_ctes(
        "run_predictions", f"select n_samples, {_METRICS} from per_class group by n_samples",
        valid="select * from run_predictions where status", **_per_class("valid", "n_samples,"),
    ),
    "metrics_table": with_ctes(
        "run_predictions",
        f"select m.model, m.project, c.n_valid, c.n_invalid, m.balanced_accuracy, m.f1_score_macro, m.accuracy"
        f" from (select model, project, {_METRICS} from per_class group by model, project) m"
        " join (select model, project, count(*) filter (status) as n_valid, count(*) filter (not status) as n_invalid"
        " from runs group by model, project) c on c.model = m.model and c.project = m.project",
        runs="select r.*, concat('shots-', r.n_samples) as model, d.lang as project"
             " from run_predictions r join documents d on d.doc_id = r.doc_id",
        valid="select * from runs where status", **_per_class("valid", "model, project,"),
    ),
    "best_run": with_ctes(
        "run_predictions",
        f"select n_samples, f1_score_macro from (select n_samples, {_METRICS} from per_class group by n_samples)"
        " order by f1_score_macro desc, n_samples limit 1",
        valid="select * from run_predictions where status", **_per_class("valid", "n_samples,"),
    ),
    "pending_runs": with_ctes(
        "run_predictions",
        "select g.doc_id, g.n_samples from (select doc_id, unnest(range(1, 9)) as n_samples from corpus) g"
        " where not exists (select 1 from run_predictions r where r.status"
        " and r.doc_id = g.doc_id and r.n_samples = g.n_samples)",
    ),
    "misclassified": with_ctes(
        "predictions",
        "select c.doc_id, md5(c.text) as text_md5, p.label_true, p.label_pred from predictions p"
        " join corpus c on c.doc_id = p.doc_id where p.status and p.label_true <> p.label_pred",
    ),
    "validate_labels": with_ctes(
        "predictions",
        f"select doc_id, case when a in {_FOUR} then a else concat('INVALID LABEL: ', a) end as label_pred,"
        f" a in {_FOUR} as status from (select doc_id,"
        " case when status then label_pred else concat(' ', label_true) end as a from predictions)",
    ),
    "annotation_labels": with_ctes("label_sets", "select project, pdf_file, labels from label_sets"),
    "annotator_pairs": with_ctes("pairs", "select pdf_file, labels_a, labels_b from pairs"),
    "label_filter": with_ctes("filtered", "select pdf_file, labels_a, labels_b from filtered"),
    "agreement_matrix": with_ctes(
        "filtered",
        "select t.l as label_true, p.l as label_pred, count(f.pdf_file) as n from axis t cross join axis p"
        " left join filtered f on f.labels_a = t.l and f.labels_b = p.l group by all",
        axis="select unnest(['good', 'bad', 'good_toxic', 'bad_toxic']) as l",
    ),
    "cohen_kappa": with_ctes(
        "filtered",
        "select cast(n as bigint) as n, round((po - pe) / (1 - pe), 6) as kappa, round(po * 100, 6) as pct_agreement"
        " from (select max(t.n) as n, max(t.po) as po, sum(cast(a.n as double) * b.n) / max(cast(t.n as double) * t.n) as pe"
        " from (select labels_a as l, count(*) as n from listed group by 1) a"
        " join (select labels_b as l, count(*) as n from listed group by 1) b on a.l = b.l"
        " cross join (select count(*) as n, avg(cast(labels_a = labels_b as double)) as po from listed) t)",
        listed=_LISTED,
    ),
    "parse_suffix": with_ctes(
        "generations", "select doc_id, substr(generated_text, length(prompt) + 1) as suffix from generations"
    ),
    "parse_category": with_ctes(
        "generations",
        f"select doc_id, category, md5(case when category is null then concat('INVALID OUTPUT MATCH: ', generated_text)"
        f" when category in {_FOUR} then category else concat('INVALID LABEL: ', generated_text) end) as label_md5,"
        f" coalesce(category in {_FOUR}, false) as status from (select doc_id, generated_text,"
        f" case when regexp_matches(generated_text, {_CATEGORY})"
        f" then regexp_extract(generated_text, {_CATEGORY}, 1) end as category from generations)",
    ),
    "parse_last_message":
        "select conv_id, max_by(role, turn) as role, md5(max_by(text, turn)) as content_md5"
        " from conversations group by conv_id",
}

#: A stream ends where the batch query does.
ORACLES["metrics_stream"] = ORACLES["metrics_by_run"]
