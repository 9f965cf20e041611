"""Confusion counts and the metrics computed from them.

Rows are reduced to ``(true, predicted)`` counts once, with partial aggregation before
the shuffle; everything after works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import templates
from corpusloom.functions import vectors as V
from corpusloom.session import MAX_LOCAL_ROWS


def confusion_counts(
    df: DataFrame, true: str = "label_true", pred: str = "label_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Non-zero cells ``(by.., label_true, label_pred, n)``."""
    return df.groupBy(*by, F.col(true).alias("label_true"), F.col(pred).alias("label_pred")).agg(
        F.count("*").alias("n")
    )


def confusion(
    df: DataFrame, true: str = "label_true", pred: str = "label_pred",
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Full confusion matrix in long form, empty cells as 0.

    Without ``labels`` the axes are the labels seen on either side; with them, a pair is
    dropped when either side is outside the list.  A pair with a null side is in no cell.
    """
    if labels is not None:
        df = df.filter(F.col(true).isin(list(labels)) & F.col(pred).isin(list(labels)))
    counts = confusion_counts(df, true, pred)
    if labels is None:
        # asking for n keeps this the same aggregate as the one joined below, computed once
        seen = counts.filter(F.col("n") > 0).select(F.explode(F.array("label_true", "label_pred")).alias("l"))
        # one label past the bound is enough to refuse, so no more are ever gathered
        listed = seen.where(F.col("l").isNotNull()).distinct().limit(MAX_LOCAL_ROWS + 1)
        axis = listed.agg(F.collect_list("l").alias("axis"))
        axis = axis.withColumn(
            "axis",
            F.when(F.size("axis") <= MAX_LOCAL_ROWS, F.col("axis")).otherwise(
                F.raise_error(F.lit(f"a matrix of more than {MAX_LOCAL_ROWS} labels cannot be filled"))
            ),
        )
    else:
        axis = df.sparkSession.range(1).select(F.array(*[F.lit(x) for x in labels]).alias("axis"))
    cells = axis.select(F.explode("axis").alias("label_true"), "axis").select(
        "label_true", F.explode("axis").alias("label_pred")
    )
    return cells.join(counts, ["label_true", "label_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )


def per_class(counts: DataFrame, by: Sequence[str] = (), valid: Column | None = None) -> DataFrame:
    """``(by.., label, tp, support, predicted, invalid)`` from confusion counts, in one pass.

    Cells that are not ``valid`` count only as invalid, under a null label.
    """
    valid = F.lit(True) if valid is None else valid
    zero = F.lit(0).cast("bigint")
    kept = F.when(valid, F.col("n")).otherwise(zero)

    def side(label: Column, tp: Column, support: Column, predicted: Column, invalid: Column) -> Column:
        return F.struct(
            F.when(valid, label).alias("label"), tp.alias("tp"), support.alias("support"),
            predicted.alias("predicted"), invalid.alias("invalid"),
        )

    hit = F.when(F.col("label_true") == F.col("label_pred"), kept).otherwise(zero)
    sides = F.array(
        side(F.col("label_true"), hit, kept, zero, F.col("n") - kept),
        side(F.col("label_pred"), zero, zero, kept, zero),
    )
    return (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(*[F.sum(f"s.{c}").cast("bigint").alias(c) for c in ("tp", "support", "predicted", "invalid")])
    )


def metrics_from_classes(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row counts, balanced accuracy, macro F1 and accuracy; null when nothing is valid."""
    tp, sup, pred = F.col("tp").cast("double"), F.col("support"), F.col("predicted")
    return classes.groupBy(*by).agg(
        F.sum("support").alias("n_valid"),
        F.sum("invalid").alias("n_invalid"),
        F.avg(F.when(sup > 0, tp / sup)).alias("balanced_accuracy"),
        F.avg(F.when(sup + pred > 0, tp * 2 / (sup + pred))).alias("f1_score_macro"),
        (F.sum(tp) / F.nullif(F.sum(sup), F.lit(0))).alias("accuracy"),
    )


def _unlabelled(df: DataFrame, true: str) -> Column:
    codes = df.schema[true].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(true).isNull() | ((F.col(true) == -1) if codes else F.lit(False))


def labelled(df: DataFrame, true: str = "label_true") -> DataFrame:
    """Rows with a truth: a null label, or its code -1, is no class and enters no metric."""
    return df.where(~_unlabelled(df, true))


def count_unlabelled(df: DataFrame, by: Sequence[str] = (), true: str = "label_true") -> DataFrame:
    """How many rows the metrics leave out for want of a truth."""
    return df.groupBy(*by).agg(F.count_if(_unlabelled(df, true)).alias("n_unlabelled"))


def metrics_by(
    df: DataFrame, by: Sequence[str] | str, true: str = "label_true", pred: str = "label_pred"
) -> DataFrame:
    """The metrics of every run in one pass over the rows."""
    by = [by] if isinstance(by, str) else list(by)
    classes = per_class(confusion_counts(labelled(df, true), true, pred, by), by)
    return metrics_from_classes(classes, by).drop("n_invalid", "n_valid")


def classification_metrics(df: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    return metrics_by(df, [], true, pred)


def eval_few_shots(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of the valid rows, with the counts of valid and invalid ones."""
    # Invalid answers are free text: fold them into one cell before the shuffle.
    folded = labelled(df).withColumn("label_pred", F.when(F.col("status"), F.col("label_pred")))
    counts = confusion_counts(folded, by=[*by, "status"])
    return metrics_from_classes(per_class(counts, by, F.col("status")), by)


def metrics_table(df: DataFrame, by: Sequence[str] = ("model", "project")) -> DataFrame:
    """One report line per model and project: counts and metrics of the valid rows."""
    return eval_few_shots(df, by)


def first_rows(df: DataFrame, order: str = "doc_id", k: int = 5) -> DataFrame:
    """The first rows by id, for inspection; each task keeps only ``k`` rows."""
    return df.orderBy(order).limit(k)


def best_run(metrics: DataFrame, key: str = "n_samples", metric: str = "f1_score_macro") -> DataFrame:
    """The run with the largest metric; the smallest key on ties."""
    best = F.max_by(F.struct(key, metric), F.struct(F.col(metric), -F.col(key)))
    return metrics.agg(best.alias("b")).select("b.*")


def agreement(
    df: DataFrame, a: str, b: str, labels: Sequence[str] = templates.AGREEMENT_LABELS
) -> DataFrame:
    """Cohen's kappa and percent agreement over the pairs with both labels in the list."""
    listed = df.filter(F.col(a).isin(list(labels)) & F.col(b).isin(list(labels)))
    marginals = per_class(confusion_counts(listed, a, b))
    total = F.sum("support").cast("double")
    stats = marginals.agg(
        F.coalesce(F.sum("support"), F.lit(0)).cast("bigint").alias("n"),
        (F.sum("tp") / F.nullif(total, F.lit(0.0))).alias("po"),
        (F.sum(F.col("support").cast("double") * F.col("predicted")) / F.nullif(total * total, F.lit(0.0))).alias("pe"),
    )
    kappa = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return stats.select("n", kappa.alias("kappa"), (F.col("po") * 100).alias("pct_agreement"))


def misclassified(pred: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Corpus rows whose valid prediction differs from the true label."""
    wrong = pred.filter(F.col("label_pred") != F.col("label_true"))
    return corpus.join(wrong, key)


# -- losses ------------------------------------------------------------------

def weighted_ce(df: DataFrame, logits: str = "logits", code: str = "label_code", weight: str = "weight") -> DataFrame:
    """Weighted mean of ``-log p``; rows without a class (-1), or with one past the logits, are left out."""
    w = F.col(weight)
    nll = -V.log_prob(F.col(logits), F.col(code).cast("int"))
    inside = (F.col(code) >= 0) & (F.col(code) < F.size(logits))
    return df.filter(inside).agg(
        (F.sum(w * nll) / F.sum(w)).alias("weighted_ce"), F.count("*").alias("n")
    )


def weighted_bce(df: DataFrame, logits: str = "logits", targets: str = "targets", weight: str = "weights") -> DataFrame:
    """Mean of the weighted binary cross-entropy over all rows and labels."""
    cell = F.zip_with(
        F.arrays_zip(V.doubles(F.col(logits)).alias("z"), V.doubles(F.col(targets)).alias("y")),
        F.col(weight),
        # max(z, 0) - z*y + log(1 + exp(-|z|)): the form that never overflows
        lambda c, w: w
        * (F.greatest(c["z"], F.lit(0.0)) - c["z"] * c["y"] + F.log1p(F.exp(-F.abs(c["z"])))),
    )
    return df.agg(
        (F.sum(V.vsum(cell)) / F.sum(F.size(logits))).alias("weighted_bce"), F.count("*").alias("n")
    )

