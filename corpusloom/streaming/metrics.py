"""Metrics of runs kept up by a stream of answers.

A stream drops answers that are sent again, turns what is new in a micro-batch into
confusion cells inside its tasks, and appends these.  The checkpoint and the log of the
file sink make every micro-batch count once, after a restart too; a reader adds the cells up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import metrics as M

CELL = ("label_true", "label_pred", "status")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct cell of a task, with its count."""
    held, keys = None, []
    for batch in batches:
        keys = batch.schema.names[:-1]
        found = pa.Table.from_batches([batch])
        held = found if held is None else pa.concat_tables([held, found])
        held = held.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
    if held is not None:
        yield from held.combine_chunks().to_batches()


def confusion_stream(
    answers: DataFrame, by: Sequence[str], key: Sequence[str], at: str = "at", delay: str = "1 hour"
) -> DataFrame:
    """New cells ``(by.., label_true, label_pred, status, n)`` of each micro-batch.

    ``answers`` holds ``by``, ``key``, ``label_true, label_pred, status`` and the time ``at``.
    Of answers with equal ``by`` and ``key`` that come within ``delay`` of each other the first
    counts; nulls in them are equal.  Answers that are older than the watermark, or have no
    time, are left out, and so are those without a truth.  Invalid answers share one cell.
    """
    once = (
        M.labelled(answers.where(F.col(at).isNotNull()))
        .withWatermark(at, delay)
        .dropDuplicatesWithinWatermark([*by, *key])
    )
    valid = F.coalesce(F.col("status"), F.lit(False))
    cells = once.select(
        *by, "label_true", F.when(valid, F.col("label_pred")).alias("label_pred"), valid.alias("status"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return cells.mapInArrow(_combined, cells.schema)


def append_cells(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there to the cells under ``path``, then stop.

    Starting again with the same ``checkpoint`` goes on where the last run ended.
    """
    writer = cells.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)


def read_cells(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """The cells so far, each once; cells that the stream has not committed are not read."""
    return spark.read.parquet(path).groupBy(*by, *CELL).agg(F.sum("n").alias("n"))


def cell_metrics(cells: DataFrame, by: Sequence[str], valid: Column | None = None) -> DataFrame:
    """The metrics of ``eval_few_shots``, from cells."""
    valid = F.col("status") if valid is None else valid
    return M.metrics_from_classes(M.per_class(cells, by, valid), by)
