"""Contiguous shards of balanced byte size from global prefix sums.

Rows are dealt into ranges of the order columns; the ranges' totals (one row per range)
are summed in order, and every row gets its global byte offset as its range's offset plus
the running sum inside the range.  Shards are cut at equal byte targets, so they are
contiguous in the order and differ by less than the largest row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh
from corpusloom.session import local_table, write_through


def byte_shards(
    rows: DataFrame, n_shards: int, size: str = "size", order: Sequence[str] = ("doc_id",), n_ranges: int | None = None
) -> DataFrame:
    """``rows`` plus ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in a shard).

    ``rows`` should be narrow: ids, sizes, digests.  Null sizes count as 0; nulls in the
    order columns come first; equal order values are ordered arbitrarily but once and for
    all.  An empty table gives an empty result.  A row goes to the shard that holds the
    middle of its bytes, so a row larger than a shard may leave shards empty.  ``shard``
    and ``slot`` must not be columns of ``rows``.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    taken = {"shard", "slot"} & set(rows.columns)
    if taken:
        raise ValueError(f"rows already has {sorted(taken)}")
    spark = rows.sparkSession
    part, tie, amount, before, seen = (fresh(x) for x in ("part", "tie", "amount", "before", "seen"))
    ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.withColumn(tie, F.monotonically_increasing_id())
        .withColumn(amount, F.coalesce(F.col(size), F.lit(0)).cast("long"))
        .repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order], F.col(tie))
        .withColumn(part, F.spark_partition_id())
    )
    dealt = write_through(dealt, "shard-ranges")
    totals = dealt.groupBy(part).agg(F.sum(amount).alias("bytes"), F.count("*").alias("rows"))
    sums = sorted(tuple(r) for r in totals.collect())  # one row per range, whatever the table's size
    total, passed, starts = 0, 0, []
    for k, size_of, rows_of in sums:
        starts.append((k, total, passed))
        total, passed = total + size_of, passed + rows_of
    starts = local_table(spark, starts, f"{part} int, {before} long, {seen} long")
    inside = Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in order], tie)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col(before) + F.sum(amount).over(running)
    middle = 2 * end - F.col(amount)
    # all rows empty: the targets have no width, so everything is shard 0
    shard = F.floor(middle * F.lit(n_shards) / F.lit(2 * total)) if total else F.lit(0)
    placed = (
        dealt.join(starts, part)
        .withColumn("shard", F.least(shard, F.lit(n_shards - 1)).cast("int"))
        .withColumn(seen, F.col(seen) + F.row_number().over(inside) - 1)
    )
    firsts = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min(seen)).collect()}  # n_shards rows at most
    first = F.element_at(F.array(*[F.lit(firsts.get(k, 0)).cast("long") for k in range(n_shards)]), F.col("shard") + 1)
    return placed.withColumn("slot", F.col(seen) - first).drop(part, tie, amount, before, seen)


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``size`` (UTF-8 bytes plus 1 for the row's end) and ``text_crc32``; null text is empty."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_column), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write each shard's documents under ``path/shard=K``.

    ``shards`` has one row per id; documents without an id there are not written,
    and a column named ``shard`` is replaced.
    """
    placed = docs.drop("shard").join(shards.select(id_column, "shard"), id_column)
    placed.write.partitionBy("shard").parquet(path)
