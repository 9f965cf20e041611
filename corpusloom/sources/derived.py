"""Working tables derived from the given parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.hashing import percent_bucket
from corpusloom.session import local_table
from corpusloom.sources.annotations import Annotations

CORPUS_CLASSES = ("good", "bad", "good_toxic", "bad_toxic")
PROJECTS = (("A", 1), ("B", 2))
ANNOTATION_CLASSES = (*CORPUS_CLASSES, "other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label() -> Column:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return (
        F.when(good & ~toxic, "good")
        .when(good, "good_toxic")
        .when(~toxic, "bad")
        .otherwise("bad_toxic")
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, label``: four uneven classes."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", _label().alias("label"))
    return documents.join(labels, "doc_id")


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a CSV reader sees it: some texts and labels spelled as missing."""
    hole = percent_bucket("hole", "doc_id")
    return corpus(spark, sf_dir).select(
        "doc_id",
        F.when(hole < 3, "NA").when(hole < 5, "").when(hole < 7, "NaN").otherwise(F.col("text")).alias("text"),
        F.when(percent_bucket("nolabel", "doc_id") < 4, "null").otherwise(F.col("label")).alias("label"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label_true, label_pred, status``: wrong and invalid answers included."""
    ids = corpus(spark, sf_dir).select("doc_id", "label")
    return with_predictions(ids)


def with_predictions(df: DataFrame, suffix: Column | None = None) -> DataFrame:
    key = F.col("doc_id").cast("string") if suffix is None else F.concat_ws(":", "doc_id", suffix)
    inv, err = percent_bucket("inv", key), percent_bucket("err", key)
    return df.select(
        *[c for c in df.columns if c not in ("label", "text")],
        F.col("label").alias("label_true"),
        F.when(inv < 6, F.concat(F.lit("INVALID LABEL: "), "label"))
        .when(err < 25, "good")
        .otherwise(F.col("label"))
        .alias("label_pred"),
        (inv >= 6).alias("status"),
    )


def run_predictions(spark: SparkSession, sf_dir: str, runs: int = 7) -> DataFrame:
    """Predictions of several runs, one per ``n_samples``."""
    ids = corpus(spark, sf_dir).select("doc_id", "label")
    grid = ids.withColumn("n_samples", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(runs))))
    return with_predictions(grid, F.col("n_samples"))


def annotations(spark: SparkSession, sf_dir: str) -> Annotations:
    """The corpus as two annotators' project tables: gaps, double labels, strangers."""
    ids = corpus(spark, sf_dir).select("doc_id", "label")
    label_ids = F.create_map(
        *[F.lit(v) for k, name in enumerate(ANNOTATION_CLASSES, 1) for v in (name, k)]
    )

    def mark(project: int, label: Column, kept: Column) -> Column:
        return F.struct(F.lit(project).alias("project_id"), label.alias("label"), kept.alias("kept"))

    in_a, in_b = percent_bucket("missA", "doc_id") >= 3, percent_bucket("missB", "doc_id") >= 3
    dis = percent_bucket("dis", "doc_id")
    other_view = F.when(dis < 20, "good").when(dis < 25, "other").otherwise(F.col("label"))
    marks = F.array(
        mark(1, F.col("label"), in_a),
        mark(1, F.lit("other"), in_a & (percent_bucket("multiA", "doc_id") < 5)),
        mark(2, other_view, in_b),
    )
    marked = ids.select("doc_id", F.explode(marks).alias("m")).filter("m.kept")
    example_id = (F.col("doc_id") * 2 + F.col("m.project_id") - 1).cast("bigint")
    repeats = F.when(percent_bucket("rep", "doc_id") < 10, 2).otherwise(1)
    labels = marked.select(
        example_id.alias("example_id"),
        (F.col("m.project_id") * 10 + label_ids[F.col("m.label")]).cast("bigint").alias("label_id"),
        F.explode(F.sequence(F.lit(1), repeats)).alias("copy"),
    ).drop("copy")
    examples = ids.select(
        F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("id"),
        F.concat(F.lit('{"pdf_file": "doc_'), "doc_id", F.lit('.pdf"}')).alias("meta"),
    )
    projects = local_table(
        spark, [(pid, name) for name, pid in PROJECTS], "id bigint, name string"
    )
    label_types = local_table(
        spark,
        [(pid * 10 + k, pid, text) for _, pid in PROJECTS for k, text in enumerate(ANNOTATION_CLASSES, 1)],
        "id bigint, project_id bigint, text string",
    )
    return Annotations(projects, label_types, labels, examples)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label, prompt, generated_text``: every outcome of the parser."""
    prompt = F.concat(F.lit("<<<\nInquiry: "), "text", F.lit("\n>>>"))
    head = F.when(percent_bucket("nomark", "doc_id") < 8, "x").otherwise("\nCategory: ")
    bad = percent_bucket("bad", "doc_id")
    answer = F.when(bad < 10, "maybe").when(bad < 13, "").otherwise(F.col("label"))
    tail = F.when(percent_bucket("nonl", "doc_id") < 6, "").otherwise("\n###")
    return corpus(spark, sf_dir).select(
        "doc_id", "label", prompt.alias("prompt"),
        F.concat(prompt, head, answer, tail).alias("generated_text"),
    )


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trial, step, value, state``: one trial per user, one report per day of events."""
    events = table(spark, sf_dir, "events")
    state = percent_bucket("state", "trial")
    return (
        events.groupBy(
            F.col("user_id").alias("trial"),
            F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("step"),
        )
        .agg(F.max("value").alias("value"))
        .withColumn(
            "state",
            F.when(state < 10, "RUNNING").when(state < 30, "PRUNED").when(state < 45, "FAIL").otherwise("COMPLETE"),
        )
    )


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``study, trial, value, state``: one study per user, one trial per event."""
    state = percent_bucket("state", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("study"),
        F.col("event_id").alias("trial"),
        "value",
        F.when(state < 10, "RUNNING").when(state < 20, "PRUNED").when(state < 30, "FAIL").otherwise("COMPLETE").alias("state"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding, label`` with the label as a class code."""
    return table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("bigint"))
