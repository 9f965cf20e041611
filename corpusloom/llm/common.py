"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case; all other bytes stay.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)).cast("int")


def fresh(name: str) -> str:
    """A column name that no caller's table has."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def as_bytes(value) -> bytes:
    """UTF-8 bytes of a text cell; null counts as empty."""
    if value is None:
        return b""
    return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value)


def answer_by_runs(rows: DataFrame, winners: DataFrame, keys: list[str], run: str) -> DataFrame:
    """``rows`` with the columns of ``winners``, which has one row per ``keys``.

    A hot key would send all its rows to one task.  So each (key, run) is looked up once,
    and the rows then join on key and run: a key's rows are spread over as many tasks as
    there are runs, and no task holds more than one run's share of a key.
    """
    asked = rows.select(*keys, run).distinct()
    answers = asked.join(winners, keys)
    return rows.join(answers, [*keys, run], "left")
