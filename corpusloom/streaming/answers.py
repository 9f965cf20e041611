"""A labelling service's files as streams: texts coming in, answers coming back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.labelling import parse_generated
from corpusloom.operators.tokens import tokenize
from corpusloom.sources.corpus import CSV_OPTIONS, clean_corpus


def corpus_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, label string") -> DataFrame:
    """New corpus files as they arrive, missing values nulled, rows without text dropped."""
    return clean_corpus(spark.readStream.options(**CSV_OPTIONS).schema(schema).csv(path))


def tokens_stream(stream: DataFrame, **options) -> DataFrame:
    return tokenize(stream, **options)


def checked_answers(stream: DataFrame, allowed: Sequence[str], generated: str = "generated_text") -> DataFrame:
    """Add ``label_pred, status`` to generated texts."""
    label, status = parse_generated(F.col(generated), allowed)
    return stream.withColumns({"label_pred": label, "status": status})


def predicted_classes(stream: DataFrame, logits: str = "logits") -> DataFrame:
    """Add ``pred_code, pred_prob`` to logits."""
    return stream.withColumns(
        {"pred_code": V.argmax_code(F.col(logits)), "pred_prob": V.predicted_prob(F.col(logits))}
    )
