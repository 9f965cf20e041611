"""Weighted softmax head on frozen embeddings: encode, fit, search, score."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import metrics, trials
from corpusloom.operators.tokens import word_tokens
from corpusloom.session import bounded_rows, local_table

#: Makes, once per Python worker, a function from a batch of texts to vectors.
EncoderFactory = Callable[[], Callable[[pd.Series], Sequence]]

#: Metric names of the configs and the columns that hold them.
METRICS = {"f1_macro": "f1_score_macro", "balanced_accuracy": "balanced_accuracy", "accuracy": "accuracy"}


def encode(df: DataFrame, encoder: EncoderFactory, text: str = "text", out: str = "embedding") -> DataFrame:
    """Add the vectors of a pluggable encoder."""
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder()
        for batch in batches:
            yield pd.Series(list(run(batch)), index=batch.index)

    return df.withColumn(out, vectors(text))


def hash_encoder(df: DataFrame, dims: int = 1024) -> tuple[PipelineModel, DataFrame]:
    """Built-in encoder: hashed term frequencies weighted by inverse document frequency.

    Whole texts take part.  Returns the fitted model and ``df`` with ``features``.
    """
    tokens = df.withColumn("tokens", word_tokens(F.col("text")))
    stages = [
        HashingTF(numFeatures=dims, inputCol="tokens", outputCol="tf"),
        IDF(inputCol="tf", outputCol="features"),
    ]
    model = Pipeline(stages=stages).fit(tokens)
    return model, model.transform(tokens).drop("tokens", "tf")


def as_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(V.doubles(F.col(vector))))


def head(reg: float = 0.0, max_iter: int = 50, weight: str = "weight") -> LogisticRegression:
    """Softmax head whose loss is the weighted mean of the cross-entropy."""
    return LogisticRegression(
        featuresCol="features", labelCol="label_code", weightCol=weight, family="multinomial",
        standardization=False, regParam=reg, maxIter=max_iter,
    )


def fit_head(df: DataFrame, reg: float = 0.0, max_iter: int = 50, weight: str = "weight") -> LogisticRegressionModel:
    """Fit on ``features, label_code, weight``; rows without a class are left out."""
    return head(reg, max_iter, weight).fit(df.filter(F.col("label_code") >= 0))


def predict(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """Add ``pred_code, logits, pred_prob``."""
    scored = model.transform(df)
    return scored.withColumns({
        "logits": vector_to_array("rawPrediction"),
        "pred_code": F.col("prediction").cast("bigint"),
        "pred_prob": F.array_max(vector_to_array("probability")),
    }).drop("rawPrediction", "probability", "prediction")


def evaluate_head(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    return metrics.classification_metrics(predict(model, df), "label_code", "pred_code")


def named_metric(name: str) -> Callable[[DataFrame], DataFrame]:
    """The metric of a config as a function; an error for an unknown name."""
    if name not in METRICS:
        raise ValueError("no valid metric specified")

    def score(runs: DataFrame) -> DataFrame:
        values = metrics.metrics_by(runs, "trial", "label_code", "pred_code")
        return values.select("trial", F.col(METRICS[name]).alias("value"))

    return score


def search_head(
    train: DataFrame, val: DataFrame, grid: Sequence[Mapping[str, Any]],
    metric: str | Callable[[DataFrame], DataFrame] = "f1_macro", parallelism: int = 4,
) -> DataFrame:
    """``trial, state, value, reg, max_iter``: every grid point fitted on train, scored on val.

    The fits run on cached features, up to ``parallelism`` at a time; all models then score val in one scan and one
    aggregation.  The value of a trial is that of its final model.  ``metric`` is a name,
    or a function from ``trial, label_code, pred_code`` rows to ``trial, value``.
    """
    if not grid:
        raise ValueError("a search needs at least one grid point")
    score = metric if callable(metric) else named_metric(metric)
    train = train.select("features", "label_code", "weight").filter(F.col("label_code") >= 0).persist()
    try:
        base = head()
        params = [{base.regParam: float(g["reg"]), base.maxIter: int(g["max_iter"])} for g in grid]
        fits = base.fitMultiple(train, params)
        with ThreadPool(min(parallelism, len(params))) as pool:
            fitted = dict(pool.imap_unordered(lambda _: next(fits), params))
        models = [fitted[i] for i in range(len(params))]
    finally:
        train.unpersist()
    scored = val.select("features", "label_code")
    names = []
    for g, model in zip(grid, models):
        name = f"pred_{g['trial']}"
        model.setPredictionCol(name).setRawPredictionCol("").setProbabilityCol("")
        scored = model.transform(scored)
        names.append(F.struct(F.lit(g["trial"]).cast("bigint").alias("trial"), F.col(name).cast("bigint").alias("pred_code")))
    runs = scored.select("label_code", F.inline(F.array(*names)))
    values = score(runs)
    points = local_table(
        train.sparkSession,
        [(int(g["trial"]), float(g["reg"]), int(g["max_iter"])) for g in grid],
        "trial bigint, reg double, max_iter int",
    )
    return values.join(points, "trial").select(
        "trial", F.lit("COMPLETE").alias("state"), "value", "reg", "max_iter"
    )


def refit_best(train: DataFrame, results: DataFrame, direction: str = "maximize") -> tuple[LogisticRegressionModel, dict]:
    """Fit again with the parameters of the best trial."""
    best = trials.best_trial(
        results.select("trial", "state", "value"), direction, results.select("trial", "reg", "max_iter")
    ).first()
    if best is None:
        raise ValueError("no complete trial")
    return fit_head(train, best["reg"], int(best["max_iter"])), best.asDict()


def project_2d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add ``x, y``: the first two principal components of the centred vectors.

    The largest loading of a component is positive, so its sign does not hang on the solver.
    """
    featured = as_features(df, vector)
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(featured)
    mean = featured.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(2)])
    shift = mean @ loadings
    xy = vector_to_array("xy")
    return model.transform(featured).withColumns({
        name: (xy[k] - F.lit(float(shift[k]))) * F.lit(float(signs[k])) for k, name in enumerate("xy")
    }).drop("features", "xy")


# -- nearest class centroid ----------------------------------------------------

def class_centroids(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``label, centroid``: mean vectors, combined before the shuffle."""
    return (
        as_features(df, vector)
        .groupBy(label)
        .agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("centroid"))
    )


def centroid_predict(
    df: DataFrame, centroids: DataFrame, vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Add ``label_pred`` and ``score``: the centroid with the largest dot product.

    Ties go to the lowest label.  The centroid table is fetched once, within the bound
    on local tables; the products run as matrix products inside Arrow batches.
    """
    rows = bounded_rows(centroids)
    if rows is None:
        raise ValueError("too many classes for one centroid matrix")
    rows = sorted(rows, key=lambda r: r[label])
    names = [r[label] for r in rows]
    matrix = np.array([r["centroid"] for r in rows], dtype="float64").T
    kind = centroids.schema[label].dataType.simpleString()

    @F.pandas_udf(f"label_pred {kind}, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = np.stack(batch.to_numpy()).astype("float64") @ matrix if len(batch) else np.empty((0, len(names)))
            best = scores.argmax(axis=1)
            yield pd.DataFrame({
                "label_pred": [names[b] for b in best], "score": scores[np.arange(len(best)), best],
            })

    return df.withColumn("_near", nearest(vector)).select(*df.columns, "_near.label_pred", "_near.score")
