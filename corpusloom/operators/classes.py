"""Class tables: codes, names, counts and weights.

A class table has one row per class (``label_code, label_text, n``).  Up to
``MAX_LOCAL_ROWS`` classes it is a local relation, whose known size lets Spark
broadcast it; beyond that it stays a distributed table and the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.operators.ranking import positions_by_order
from corpusloom.session import MAX_LOCAL_ROWS, bounded_rows, local_table

CLASS_SCHEMA = "label_code bigint, label_text string, n bigint"


def class_table(
    df: DataFrame, label: str = "label", order: str = "doc_id", max_local: int = MAX_LOCAL_ROWS
) -> DataFrame:
    """Classes coded by first appearance in ``order``; null labels get no class."""
    seen = (
        df.filter(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label_text"))
        .agg(F.min(order).alias("first_seen"), F.count("*").alias("n"))
    )
    rows = bounded_rows(seen, max_local)
    if rows is None:
        coded = positions_by_order(seen, ["first_seen", "label_text"], "label_code", name="classes")
        return coded.select("label_code", "label_text", "n")
    rows = sorted(rows, key=lambda r: (r["first_seen"], r["label_text"]))
    coded = [(code, r["label_text"], r["n"]) for code, r in enumerate(rows)]
    return local_table(df.sparkSession, coded, CLASS_SCHEMA)


def class_rows(classes: DataFrame) -> list[Row]:
    """The class table on the driver, in code order; an error past the bound."""
    rows = bounded_rows(classes)
    if rows is None:
        raise ValueError(f"more than {MAX_LOCAL_ROWS} classes cannot be listed")
    return sorted(rows, key=lambda r: r["label_code"])


def factorize(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_code``; a null label gets -1."""
    codes = classes.select(F.col("label_text").alias(label), "label_code")
    coded = df.join(codes, label, "left")
    return coded.withColumn("label_code", F.coalesce("label_code", F.lit(-1).cast("bigint")))


def decode_label(df: DataFrame, classes: DataFrame, code: str = "label_code") -> DataFrame:
    """Add ``label_text`` from a code column; unknown codes and -1 give null."""
    names = classes.select(F.col("label_code").alias(code), "label_text")
    return df.join(names, code, "left")


def category_summary(classes: DataFrame) -> DataFrame:
    """One line per class, as `` name (n=count)``."""
    line = F.concat(F.lit(" "), "label_text", F.lit(" (n="), F.col("n").cast("string"), F.lit(")"))
    return classes.select("label_code", "label_text", "n", line.alias("summary"))


def class_counts(df: DataFrame, code: str = "label_code") -> DataFrame:
    return df.filter(F.col(code) >= 0).groupBy(code).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, code: str = "label_code") -> DataFrame:
    """``label_code, n, weight`` with weight 1/count."""
    weighted = class_counts(df, code).withColumn("weight", F.lit(1.0) / F.col("n"))
    rows = bounded_rows(weighted)
    return weighted if rows is None else local_table(df.sparkSession, sorted(rows), weighted.schema)


def with_class_weight(df: DataFrame, weights: DataFrame, code: str = "label_code") -> DataFrame:
    """Each coded row with the weight of its class; uncoded rows are left out."""
    return df.join(weights.select(code, "weight"), code)


def min_class_support(df: DataFrame, code: str = "label_code") -> DataFrame:
    return class_counts(df, code).agg(F.min("n").alias("min_support"))


def coded_classes(df: DataFrame) -> DataFrame:
    """Class table of coded rows, e.g. of a train split: the given codes, its own counts."""
    counted = (
        df.filter(F.col("label_code") >= 0)
        .groupBy("label_code", "label_text")
        .agg(F.count("*").alias("n"))
    )
    rows = bounded_rows(counted)
    return counted if rows is None else local_table(df.sparkSession, sorted(rows), counted.schema)


def label_list(df: DataFrame, order: str, label: str = "label") -> list[str]:
    """Distinct labels in order of first appearance."""
    return [r["label_text"] for r in class_rows(class_table(df, label, order))]
