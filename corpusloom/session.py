"""Session helpers: local sessions, the shared folder, bounded small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Most rows any operator may bring to the driver as a lookup table.  Tables past
#: this bound stay distributed.
MAX_LOCAL_ROWS = 10_000


def local_session(cores: int | str = 8, app: str = "corpusloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, where driver and executors share one disk, falls back to a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage, fixes the values of nondeterministic columns, and survives the
    loss of executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, **options)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def write_bucketed(df: DataFrame, name: str, buckets: int, column: str, **options: str) -> DataFrame:
    """``write_through`` for what is grouped by ``column`` again and again, which then needs no shuffle.

    The table has a name of its own in the session's catalog until it is discarded.
    """
    spark = df.sparkSession
    path, called = shared_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").options(path=path, **options).bucketBy(buckets, column).saveAsTable(called)
    table = spark.table(called)
    table._written_path, table._written_name = path, called
    return table


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the files of a query's shuffles go when it has run, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``write_through`` or ``write_bucketed`` returned, once their last reader has run.

    Other DataFrames, and tables derived from written ones, are left alone.
    """
    for table in tables:
        named = getattr(table, "_written_path", None)
        if named is None:
            continue
        if called := getattr(table, "_written_name", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {called}")
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(named)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """Rows held on the driver as a local relation.

    Its exact size is known to the optimizer, so joins against it are broadcast by
    Spark's own size check and need no hint.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema=schema)


def bounded_rows(df: DataFrame, limit: int = MAX_LOCAL_ROWS) -> list[Row] | None:
    """All rows of a small table, or None when it holds more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
