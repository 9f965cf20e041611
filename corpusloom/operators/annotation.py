"""From annotation tables to label sets per report, and pairs of annotators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import templates
from corpusloom.functions.text import meta_field, norm_quotes, select_single_label
from corpusloom.operators import metrics
from corpusloom.sources.annotations import Annotations


def project_by_name(projects: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named projects; an error when one of them does not exist."""
    chosen = projects.filter(F.col("name").isin(list(names)))
    known = {r["name"] for r in chosen.select("name").distinct().collect()}
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"project {missing[0]} could not be found")
    return chosen


def project_labels(projects: DataFrame, label_types: DataFrame) -> DataFrame:
    """``project, label_id, label`` of the given projects, quotes normalised in the name."""
    types = label_types.select(F.col("id").alias("label_id"), "project_id", norm_quotes(F.col("text")).alias("label"))
    return projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")).join(
        types, "project_id"
    ).select("project", "label_id", "label")


def label_examples(labels: DataFrame, label_types: DataFrame) -> DataFrame:
    """``example_id, marks``: the labels of each example, each label once.

    Repeated marks fall together before the shuffle, and the result is laid out by
    example for the join that follows.
    """
    mark = F.struct("project", "label_id", "label")
    return labels.join(label_types, "label_id").groupBy("example_id").agg(F.collect_set(mark).alias("marks"))


def labelled_examples(examples: DataFrame, marks: DataFrame) -> DataFrame:
    """``pdf_file, project, label_id, label``: each example once per label."""
    files = examples.select(
        F.col("id").alias("example_id"), meta_field(F.col("meta"), "pdf_file").alias("pdf_file")
    )
    # without a report there is nothing to compare; see unreadable_examples
    return marks.join(files.where(F.col("pdf_file").isNotNull()), "example_id").select("pdf_file", F.inline("marks"))


def unreadable_examples(examples: DataFrame) -> int:
    """Examples whose metadata names no report; ``labelled_examples`` leaves them out."""
    return examples.where(meta_field(F.col("meta"), "pdf_file").isNull()).count()


def labels_by_pdf(db: Annotations, projects: Sequence[str]) -> DataFrame:
    """``project, pdf_file, labels``: distinct labels joined by commas in label-type order.

    Label types are a small table and never decide the partitioning, so a label that
    marks most examples is no hot key.
    """
    types = project_labels(project_by_name(db.projects, projects), db.label_types)
    marked = labelled_examples(db.examples, label_examples(db.labels, types))
    sets = marked.groupBy("project", "pdf_file").agg(
        F.array_sort(F.collect_set(F.struct("label_id", "label"))).alias("s")
    )
    names = F.array_distinct(F.transform("s", lambda x: x["label"]))
    return sets.select("project", "pdf_file", F.array_join(names, ",").alias("labels"))


def pair_annotators(df: DataFrame, a: str, b: str, key: str = "pdf_file") -> DataFrame:
    """``key, labels_a, labels_b`` for the keys both projects hold.

    Keys are unique per project, so one conditional aggregate pairs them: a single
    shuffle, and the input is computed once rather than once per side.
    """
    side = {n: F.max(F.when(F.col("project") == p, F.col("labels"))) for n, p in (("labels_a", a), ("labels_b", b))}
    return (
        df.filter(F.col("project").isin(a, b))
        .groupBy(key)
        .agg(*[c.alias(n) for n, c in side.items()])
        .filter(F.col("labels_a").isNotNull() & F.col("labels_b").isNotNull())
    )


def filter_labels(pairs: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Both sides reduced to one allowed label or the rest class."""
    return pairs.withColumns({c: select_single_label(F.col(c), allowed) for c in ("labels_a", "labels_b")})


def annotator_agreement(
    db: Annotations, a: str, b: str, labels: Sequence[str] = templates.AGREEMENT_LABELS
) -> tuple[DataFrame, DataFrame]:
    """The confusion matrix of two annotators, and their kappa and percent agreement."""
    pairs = filter_labels(pair_annotators(labels_by_pdf(db, [a, b]), a, b), labels)
    matrix = metrics.confusion(pairs, "labels_a", "labels_b", labels)
    return matrix, metrics.agreement(pairs, "labels_a", "labels_b", labels)
