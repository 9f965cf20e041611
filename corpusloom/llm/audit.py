"""How filters overlap: what each removes at each place of every order, by Lehmer-rank difference arrays.

A document is reduced to the set of filters that it fails, its mask.  In an order, the first
filter of the mask removes it.  All orders that begin with the same filters have neighbouring
lexicographic (Lehmer) ranks, so the orders in which a mask goes at a step by a filter form
whole intervals of ranks.  Counts of masks are added where intervals begin, taken off where
they end, and summed up over the ranks; no document meets an order.

Spark reduces the documents to counts per part and mask; a part has at most 2^k masks.  The
difference arrays of a part are then one small matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import write_through

#: Orders grow with the factorial of the filters; 7 filters have 5040.
MAX_FILTERS = 7
#: Parts whose arrays a task holds at once.
PARTS_AT_ONCE = 32
MEASURES = ("docs", "good", "toxic")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself; null counts as empty, which fails A alone."""
    text = F.coalesce(text, F.lit(""))
    n, distinct = F.size(words(text)), F.size(F.array_distinct(words(text)))
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": n < 200,
        "B": F.lit(100) * distinct < F.lit(50) * n,
        "C": F.lit(100) * capitals > F.lit(2) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(failures: dict[str, Column], letters: str) -> Column:
    bits = [F.when(failures[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(letters) if f in failures]
    return sum(bits[1:], bits[0]).cast("int")


def repeats(rows: DataFrame) -> Column:
    """Condition on rows joined with ``first``: a smaller identifier has the same text."""
    return F.col("id").isNotNull() & F.col("first").isNull()


def mask_counts(
    docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", repeat_letter: str = "E", part: str = "source",
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``part, mask, docs, good, toxic``: documents of each part by the filters they fail.

    Bit i of the mask stands for the i-th letter.  The repeat filter fails a document if a
    smaller identifier has the identical text; a null identifier is neither smaller than
    another nor fails.  Rows that repeat an identifier and its text fail or pass together
    and all count.  A null part is the empty string.  A document is good or toxic if any
    label row of its identifier says so.

    Texts are read once, for one narrow row each.  The least identifier of a text is a
    partial minimum; rows then meet it by text and identifier, so the rows of a text that is
    everywhere are spread.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        _mask(text_failures(F.col(text_column)), letters).alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256)).alias("digest"),
    )
    narrow = write_through(narrow, "audit-rows")
    rows = narrow.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n"))
    first = narrow.groupBy("digest").agg(F.min("id").alias("first")).where("first is not null")
    first = first.select("digest", F.col("first").alias("id"), "first")
    marked = rows.join(first, ["digest", "id"], "left")
    again = F.when(repeats(marked), F.lit(1 << letters.index(repeat_letter))).otherwise(F.lit(0))
    marked = marked.select("id", "part", (F.col("mask") + again).cast("int").alias("mask"), "n")
    said = labels.select(F.col(id_column).cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"),
    )
    labelled = marked.join(said, "id", "left")
    return labelled.groupBy("part", "mask").agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )


def lehmer_rank(order: tuple[int, ...], k: int) -> int:
    """Rank of the first order, among the lexicographic ones of k filters, that begins with ``order``."""
    left, rank = list(range(k)), 0
    for at, filter_ in enumerate(order):
        rank += left.index(filter_) * math.factorial(k - 1 - at)
        left.remove(filter_)
    return rank


@lru_cache(maxsize=4)
def interval_ends(k: int) -> np.ndarray:
    """ends[mask, step, rank]: +1 where an interval of removing orders begins, -1 behind its end."""
    ends = np.zeros((1 << k, k, math.factorial(k) + 1), np.int64)
    for mask in range(1, 1 << k):
        outside = [f for f in range(k) if not mask >> f & 1]
        inside = [f for f in range(k) if mask >> f & 1]
        for step in range(len(outside) + 1):
            length = math.factorial(k - 1 - step)
            for passed in permutations(outside, step):
                for remover in inside:
                    rank = lehmer_rank((*passed, remover), k)
                    ends[mask, step, rank] += 1
                    ends[mask, step, rank + length] -= 1
    return ends


def interactions(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Totals by (part, order, step) from counts[part, mask, measure]; orders in lexicographic rank."""
    k = counts.shape[1].bit_length() - 1
    orders = np.array(list(permutations(range(k))))
    steps = np.tensordot(counts, interval_ends(k), axes=(1, 0)).cumsum(-1)[..., :-1]  # part, measure, step, rank
    gone, good, toxic = (steps[:, m].swapaxes(1, 2) for m in range(3))
    masks = np.arange(1 << k)
    failing = np.stack([counts[:, masks >> f & 1 == 1, 0].sum(1) for f in range(k)], 1)
    shares = np.stack([(gone * (orders == f)).sum((1, 2)) for f in range(k)], 1)
    return {
        "kept": counts[:, :, 0].sum(1)[:, None, None] - gone.cumsum(2),
        "removed": gone,
        "redundant": failing[:, orders] - gone,
        "unique_fails": counts[:, 1 << orders, 0],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": shares[:, orders],
    }


def filter_interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order and step, zeros included, from ``part, mask, docs, good, toxic``.

    ``kept`` documents pass this step and those before, ``removed`` go here, ``redundant``
    fail the step's filter but went before, ``unique_fails`` fail that filter only,
    ``good_lost`` and ``toxic_lost`` are of the removed, ``shapley`` is the filter's removed
    over all orders.  No rows in, no rows out.
    """
    k = len(letters)
    if not 1 <= k <= MAX_FILTERS or len(set(letters)) != k:
        raise ValueError(f"between 1 and {MAX_FILTERS} different filters are needed")
    names = ["".join(p) for p in permutations(letters)] if list(letters) == sorted(letters) else None
    if names is None:
        raise ValueError("letters must be in order, so that ranks are lexicographic")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    totals = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                array = np.zeros((some.num_rows, 1 << k, len(MEASURES)), np.int64)
                for i, cells in enumerate(some.column("cells").to_pylist()):
                    for cell in cells:
                        array[i, cell["mask"]] += [cell[m] for m in MEASURES]
                found = interactions(array)
                each = len(names) * k
                take = pa.array(np.repeat(np.arange(some.num_rows), each))
                yield pa.record_batch(
                    [
                        some.column("part").take(take),
                        pa.array(np.tile(np.repeat(names, k), some.num_rows), pa.string()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), some.num_rows * len(names))),
                        *[pa.array(np.ascontiguousarray(found[t]).reshape(-1)) for t in totals],
                    ],
                    names=["part", "filter_order", "step", *totals],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{t} long" for t in totals)
    return parts.mapInArrow(totalled, schema)
