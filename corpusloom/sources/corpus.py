"""Corpus files, saved splits, result and metric tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import templates
from corpusloom.functions.text import na_to_null

#: Quoting under which whole texts (newlines, quotes, blanks) survive a CSV file.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


#: Name of a part within the path of its file.
PART_PATTERN = r"anonymized_([a-z_]+_part\d+)\.csv"


def clean_corpus(
    df: DataFrame,
    columns: Sequence[str] = ("text", "label"),
    na: Sequence[str] = templates.NA_STRINGS,
) -> DataFrame:
    """Read every spelling of a missing value as null, then drop rows without text."""
    nulled = df.withColumns({c: na_to_null(F.col(c), na) for c in columns})
    return drop_missing_text(nulled)


def drop_missing_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.col(text).isNotNull())


def read_corpus(
    spark: SparkSession, path: str, na: Sequence[str] = templates.NA_STRINGS
) -> DataFrame:
    """``doc_id, text, label`` of a labelled CSV corpus, rows without text dropped.

    A multi-line file is read by one task, so ``doc_id`` follows the file's row order.
    """
    raw = spark.read.options(**CSV_OPTIONS).csv(path)
    rows = raw.select(F.monotonically_increasing_id().alias("doc_id"), "text", "label")
    return clean_corpus(rows, na=na)


def part_paths(datasets: Iterable[str], root: str) -> list[str]:
    """Files of the named unlabelled corpora; an error when no name is known."""
    names = set(datasets)
    paths = [
        f"{root}/{pattern.format(part=part)}"
        for name, pattern in templates.CORPUS_PARTS.items()
        if name in names
        for part in templates.PARTS
    ]
    if not paths:
        raise ValueError("no valid dataset specified")
    return paths


def read_parts(spark: SparkSession, datasets: Iterable[str], root: str) -> DataFrame:
    """``part, row_id, text`` of many unlabelled files in one scan."""
    raw = spark.read.options(**CSV_OPTIONS).csv(part_paths(datasets, root))
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), PART_PATTERN, 1).alias("part"),
        F.monotonically_increasing_id().alias("row_id"),
        na_to_null(F.col("text")).alias("text"),
    )


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved corpus laid out by ``split``; naming one reads only its folder."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Per-row results laid out by ``n_samples``.

    Only the ``n_samples`` present in ``df`` are replaced, so a repeated run is safe.
    """
    options = CSV_OPTIONS if fmt == "csv" else {}
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**options)
        .partitionBy("n_samples")
        .format(fmt)
        .save(path)
    )


def append_metrics(df: DataFrame, path: str) -> None:
    """Add metric rows to the running metrics table, one partition per ``n_samples``.

    Rows of runs that the table already has (same model, project and n_samples, as far as
    the table names them) are not added again; nothing that is there is replaced.
    """
    there = read_metrics(df.sparkSession, path)
    if there is not None:
        keys = [c for c in ("model", "project", "n_samples") if c in df.columns and c in there.columns]
        known = there.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        df = df.join(known, same, "left_anti")
    df.write.mode("append").partitionBy("n_samples").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The running metrics table, or None before the first append."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_best_params(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_best_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def shot_grid(spark: SparkSession, low: int = 1, high: int = 1, listed: str | None = None) -> DataFrame:
    """``n_samples`` from ``low`` to ``high``, or from a comma list."""
    if listed is None:
        values = F.sequence(F.lit(low), F.lit(high))
    else:
        values = F.transform(F.split(F.lit(listed), ","), lambda s: F.trim(s).cast("int"))
    return spark.range(1).select(F.explode(values.cast("array<bigint>")).alias("n_samples"))


def pending_runs(grid: DataFrame, done: DataFrame | None, keys: Sequence[str] = ("n_samples",)) -> DataFrame:
    """Grid rows whose keys have no finished run."""
    if done is None:
        return grid
    return grid.join(done.select(*keys), list(keys), "left_anti")


def map_requests(df: DataFrame, prefix: str = templates.TRANSLATE_PREFIX, text: str = "text") -> DataFrame:
    """The request sent to the model for each row: prefix and whole text."""
    return df.withColumn("request", F.concat(F.lit(prefix), F.col(text)))


def run_name(prefix: str, trial: Column, rate: Column) -> Column:
    """``trial-<n>_<prefix>-<rate>`` with the rate in scientific notation."""
    return F.format_string(f"trial-%d_{prefix}-%.2e", trial, rate)
