"""Exact ranks without sorting a whole table in one task.

* ``nth_key`` finds the key at a given rank from prefix counts, so that "the first k
  rows in hash order" becomes a plain filter.
* ``positions_by_hash`` numbers the rows of each group in hash order; a large group is
  split by hash prefix, so no task sees more than about ``max_rows`` of it.
* ``positions_by_order`` numbers rows in the order of a key of any distribution.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import bounded_rows, local_table, write_through

#: Hex digits counted per pass: at most 16**4 = 65,536 counts reach the driver.
PREFIX_DIGITS = 4
#: Rows of one prefix that may be fetched to finish the search for a rank.
FETCH_ROWS = 10_000
#: Rows of one group that are ranked by one task.
TASK_ROWS = 1_000_000


class RankKey(NamedTuple):
    """The ``(hash, id)`` at a rank, and the number of rows ranked."""

    hash: str | None
    id: object
    rows: int

    def reached(self, hash_col: Column, id_col: Column) -> Column:
        """True for the rows at or before this rank."""
        if self.hash is None:
            return F.lit(False)
        # one comparison of structs, so that the hash is computed once per row
        key = F.struct(F.lit(self.hash).alias("h"), F.lit(self.id).alias("id"))
        return F.struct(hash_col.alias("h"), id_col.alias("id")) <= key


def nth_key(keys: DataFrame, rank, fetch_rows: int = FETCH_ROWS) -> RankKey:
    """Find the row at a rank of ``keys(h, id)`` ordered by ``(h, id)``; ids are unique.

    ``rank`` maps the number of rows to the 1-based rank wanted.  Each pass counts rows
    per hash prefix and descends into the one prefix that holds the rank.
    """
    prefix, total, wanted = "", None, 0
    while True:
        start = len(prefix) + 1
        inside = keys if not prefix else keys.filter(F.startswith("h", F.lit(prefix)))
        counts = sorted(
            inside.groupBy(F.substring("h", start, PREFIX_DIGITS).alias("p")).count().collect()
        )
        if total is None:
            total = sum(c["count"] for c in counts)
            wanted = rank(total)
            if wanted <= 0:
                return RankKey(None, None, total)
        for row in counts:
            if wanted <= row["count"]:
                break
            wanted -= row["count"]
        prefix += row["p"]
        if row["count"] <= fetch_rows or len(prefix) >= 32:
            break
    inside = keys.filter(F.startswith("h", F.lit(prefix))).select("h", "id")
    if row["count"] <= fetch_rows:
        found = sorted(inside.collect())[wanted - 1]
    else:  # equal hashes: only repeated ids can get here
        found = inside.orderBy("h", "id").offset(wanted - 1).first()
    return RankKey(found["h"], found["id"], total)


def positions_by_hash(
    df: DataFrame, group: str, hash_col: str, id_col: str, position: str = "pos",
    max_rows: int = TASK_ROWS, sizes: dict | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its group, ordered by ``(hash, id)``.

    Pass only the key columns; join anything wide afterwards by id.  ``sizes`` are the
    rows per group, when they are known already.
    """
    if sizes is None:
        counted = bounded_rows(df.groupBy(group).count())
        sizes = None if counted is None else {r[0]: r["count"] for r in counted}
    if sizes is not None and all(n <= max_rows for n in sizes.values()):
        order = W.partitionBy(group).orderBy(hash_col, id_col)
        return df.withColumn(position, (F.row_number().over(order) - 1).cast("bigint"))
    digits = _prefix_digits(df, group, sizes, max_rows).withColumnRenamed(group, "_group")
    # null is a group like any other
    cut = df.join(digits, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    cut = cut.withColumn("_part", F.substr(hash_col, F.lit(1), F.col("_digits"))).drop("_digits")
    counts = cut.groupBy(group, "_part").count()
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_cut"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col("_part").eqNullSafe(F.col("_cut"))
    order = W.partitionBy(group, "_part").orderBy(hash_col, id_col)
    return (
        cut.withColumn("_rank", F.row_number().over(order))
        .join(offsets, same)
        .withColumn(position, (F.col("_offset") + F.col("_rank") - 1).cast("bigint"))
        .drop("_group", "_part", "_cut", "_offset", "_rank")
    )


def _prefix_digits(df: DataFrame, group: str, sizes: dict | None, max_rows: int) -> DataFrame:
    """Hex digits by which each group is cut so that a cut holds about ``max_rows``."""
    if sizes is None:
        need = F.ceil(F.log(16.0, F.col("count") / F.lit(float(max_rows))))
        return df.groupBy(group).count().select(group, F.greatest(F.lit(0), need).cast("int").alias("_digits"))
    rows = [(g, max(0, math.ceil(math.log(n / max_rows, 16)))) for g, n in sizes.items()]
    schema = T.StructType([df.schema[group], T.StructField("_digits", T.IntegerType())])
    return local_table(df.sparkSession, rows, schema)


def positions_by_order(
    df: DataFrame, order: list[str], position: str = "pos", rows_per_part: int = TASK_ROWS, name: str = "ordered"
) -> DataFrame:
    """Add the 0-based position of each row of the table in the order of unique keys.

    Pass narrow rows and join anything wide afterwards.  They are written once, so that
    counting and sampling do not compute them again; then one range shuffle, sampled by
    Spark so that parts are even whatever the keys look like.  The sorted parts are
    written too, because a second sampling could cut them elsewhere.
    """
    df = write_through(df, name)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows_per_part))
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = write_through(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_row": in_part}),
        f"{name}-sorted",
    )
    offset, rows = 0, []
    for part, count in sorted(ordered.groupBy("_part").count().collect()):
        rows.append((part, offset))
        offset += count
    schema = "_part int, _offset bigint"
    offsets = local_table(df.sparkSession, rows, schema)
    return (
        ordered.join(offsets, "_part")
        .withColumn(position, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )
