"""Contrastive sentence pairs and the embedding loss on them.

Pairs are numbered, not enumerated: a pair number is turned into two row positions by
arithmetic, so only the pairs that are kept ever exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.functions.hashing import md5_key
from corpusloom.operators.classes import class_rows
from corpusloom.operators.ranking import positions_by_hash

#: Training examples of one body fit.
MAX_PAIRS = 25_000
#: A prime above any number of pairs: stepping by it visits every pair number once.
PAIR_STRIDE = 2**89 - 1
#: Numbers of Gram sums that a task holds before it hands them on.
HELD_SUMS = 4_000_000

_WIDE = "decimal(38,0)"


def _wide(value: int) -> Column:
    return F.lit(Decimal(value)).cast(_WIDE)


def pair_totals(sizes: list[int]) -> tuple[int, int]:
    """Numbers of positive pairs (self pairs included) and of negative pairs."""
    positive = sum(n * (n + 1) // 2 for n in sizes)
    negative = (sum(sizes) ** 2 - sum(n * n for n in sizes)) // 2
    return positive, negative


def _slot(bounds: list[int], index: Column) -> Column:
    """0-based slot of ``index`` among ascending lower bounds."""
    literal = F.array(*[_wide(b) for b in bounds])
    return F.size(F.filter(literal, lambda b: b <= index)) - 1


def _at(values: list[int], slot: Column) -> Column:
    return F.get(F.array(*[_wide(v) for v in values]), slot)


def _scattered(index: Column, total: int) -> Column:
    """A permutation of ``0..total-1``."""
    return (index * _wide(PAIR_STRIDE % total) % _wide(total)).cast(_WIDE)


def numbered_pairs(spark, sizes: list[int], n_pairs: int) -> DataFrame:
    """``pair, target, g_left, g_right`` as positions in class order.

    Positive and negative pairs alternate; the smaller side starts over when it is used
    up, so both sides are equally many.
    """
    starts = [sum(sizes[:c]) for c in range(len(sizes))]
    positives = [n * (n + 1) // 2 for n in sizes]
    negatives = [n * s for n, s in zip(sizes, starts)]
    pos_total, neg_total = pair_totals(sizes)
    half = (F.col("pair") if neg_total == 0 else F.floor(F.col("pair") / 2)).cast(_WIDE)
    base = spark.range(n_pairs).withColumnRenamed("id", "pair")

    # positive: class by cumulative counts, then the triangular number inside the class
    pos_bounds = [sum(positives[:c]) for c in range(len(sizes))]
    pos = (
        base.withColumn("target", F.lit(1))
        .withColumn("idx", _scattered(half % _wide(pos_total), pos_total))
        .withColumn("slot", _slot(pos_bounds, F.col("idx")))
        .withColumn("local", (F.col("idx") - _at(pos_bounds, F.col("slot"))).cast(_WIDE))
        .withColumn("j", F.floor((F.sqrt(F.col("local").cast("double") * 8 + 1) - 1) / 2).cast(_WIDE))
    )

    def triangle(j: Column) -> Column:
        return F.floor(j * (j + 1) / 2).cast(_WIDE)

    # the square root is a double: one step either way makes it exact
    pos = (
        pos.withColumn("j", F.when(triangle(F.col("j")) > F.col("local"), F.col("j") - 1).otherwise(F.col("j")).cast(_WIDE))
        .withColumn("j", F.when(triangle(F.col("j") + 1) <= F.col("local"), F.col("j") + 1).otherwise(F.col("j")).cast(_WIDE))
        .select(
            "pair", "target",
            (_at(starts, F.col("slot")) + F.col("local") - triangle(F.col("j"))).cast("bigint").alias("g_left"),
            (_at(starts, F.col("slot")) + F.col("j")).cast("bigint").alias("g_right"),
        )
    )
    if neg_total == 0:
        return pos
    # negative: a row of class c against any row of the classes before it
    neg_bounds = [sum(negatives[:c]) for c in range(len(sizes))]
    neg = (
        base.withColumn("target", F.lit(0))
        .withColumn("idx", _scattered(half % _wide(neg_total), neg_total))
        .withColumn("slot", _slot(neg_bounds, F.col("idx")))
        .withColumn("local", (F.col("idx") - _at(neg_bounds, F.col("slot"))).cast(_WIDE))
        .withColumn("before", _at(starts, F.col("slot")))
        .select(
            "pair", "target",
            (F.col("local") % F.col("before")).cast("bigint").alias("g_left"),
            (F.col("before") + F.floor(F.col("local") / F.col("before"))).cast("bigint").alias("g_right"),
        )
    )
    even = F.col("pair") % 2 == 0
    return pos.filter(even).unionByName(neg.filter(~even))


def contrastive_pairs(
    df: DataFrame,
    classes: DataFrame,
    id_col: str = "doc_id",
    max_pairs: int = MAX_PAIRS,
    batch_size: int = 16,
    seed: int = 42,
) -> DataFrame:
    """``pair, target, id_left, id_right`` for the pairs one training run sees.

    ``df`` has ``id, label_code``; ``classes`` counts its rows.  The run ends after the
    last full batch within ``max_pairs``.
    """
    rows = [r for r in class_rows(classes) if r["n"] > 0]
    sizes = [r["n"] for r in rows]
    pos_total, neg_total = pair_totals(sizes)
    available = 2 * max(pos_total, neg_total) if neg_total else pos_total
    n_pairs = min(available, max_pairs // batch_size * batch_size)
    numbered = numbered_pairs(df.sparkSession, sizes, n_pairs)

    keyed = df.select("label_code", F.col(id_col).alias("id")).withColumn("h", md5_key(f"pairs{seed}", "id"))
    known = {r["label_code"]: r["n"] for r in rows}
    ranked = positions_by_hash(keyed, "label_code", "h", "id", sizes=known)
    start_of = F.create_map(*[
        F.lit(v).cast("bigint") for c, r in enumerate(rows) for v in (r["label_code"], sum(sizes[:c]))
    ])
    placed = ranked.select((start_of[F.col("label_code")] + F.col("pos")).alias("g"), "id")
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("g_left").alias("g")), F.struct(F.lit(1).alias("side"), F.col("g_right").alias("g"))
    )
    # both ends meet the ranked rows in one join, so the ranking is computed once
    found = numbered.select("pair", "target", F.inline(ends)).join(placed, "g")
    return found.groupBy("pair", "target").agg(
        F.max(F.when(F.col("side") == 0, F.col("id"))).alias("id_left"),
        F.max(F.when(F.col("side") == 1, F.col("id"))).alias("id_right"),
    )


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class and width the Gram matrix and the sum of a task's vectors, as one list."""
    held: dict[tuple, list] = {}

    def emit() -> pa.RecordBatch:
        labels, widths = zip(*held)
        counts, sums = zip(*held.values())
        held.clear()
        return pa.record_batch(
            [pa.array(labels, label_type), pa.array(widths, pa.int32()), pa.array(counts, pa.int64()),
             pa.array(list(sums), pa.list_(pa.float64()))], names=["label", "d", "n", "sums"])

    for batch in batches:
        label_type = batch.column(0).type
        codes = batch.column(0).dictionary_encode()
        names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        widths = pc.list_value_length(batch.column(1)).to_numpy()
        for d in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == d)
            order = rows[np.argsort(code[rows], kind="stable")]
            u = batch.column(1).take(pa.array(order)).flatten().to_numpy().reshape(len(order), d)
            kinds, firsts = np.unique(code[order], return_index=True)
            for kind, part in zip(kinds.tolist(), np.split(u, firsts[1:])):
                added = np.concatenate([(part.T @ part).ravel(), part.sum(0)])
                n, before = held.get((names[kind], d), (0, 0.0))
                held[names[kind], d] = (n + len(part), before + added)
                if len(held) * d * (d + 1) > HELD_SUMS:
                    yield emit()
    if held:
        yield emit()


def embedding_loss_over_all(
    embeddings: DataFrame, label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """The loss over all pairs of one table, the positive and the negative mean weighing the same.

    Pairs of one class (with the pairs of a vector and itself) aim at a cosine of 1, the
    others at 0.  For unit vectors the sums of cosines and of their squares follow from a
    class's vector sum and Gram matrix, so no pair is ever listed: a task adds up its own
    vectors class by class, and only these blocks are cut into cells and summed by place.  Null and zero vectors and null labels are left out
    and counted.
    """
    rows = embeddings.select(F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm)
    usable = F.coalesce((F.col("norm") > 0) & F.col("label").isNotNull(), F.lit(False))
    units = rows.where(usable).select("label", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
    kind = units.schema["label"].dataType.simpleString()
    blocks = units.mapInArrow(_class_sums, f"label {kind}, d int, n bigint, sums array<double>")
    cells = blocks.select("label", "d", "n", F.posexplode("sums").alias("place", "x"))
    sums = cells.groupBy("label", "place", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    gram = F.col("place") < F.col("d") * F.col("d")
    square = F.when(gram, F.col("x") * F.col("x")).otherwise(0.0)
    length = F.when(gram, 0.0).otherwise(F.col("x") * F.col("x"))
    inside = sums.groupBy("label").agg(
        F.sum(square).alias("cos2"), F.sum(length).alias("cos"), F.max("n").cast("double").alias("n"))
    own = inside.agg(
        F.sum("cos2").alias("cos2"), F.sum((F.col("cos") - F.col("n")) / 2).alias("cos_in"),
        F.sum((F.col("cos2") - F.col("n")) / 2).alias("cos2_in"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("n_pos"))
    whole = sums.where(gram).groupBy("place").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all2"))
    dropped = rows.agg(F.count_if(~usable).alias("n_dropped"))
    # three tables of one row each, side by side
    stacked = own.unionByName(whole, allowMissingColumns=True).unionByName(dropped, allowMissingColumns=True)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    n_in = F.col("n_pos") - F.col("n")
    n_neg = F.col("n") * (F.col("n") + 1) / 2 - F.col("n_pos")
    positive = (n_in - 2 * F.col("cos_in") + F.col("cos2_in")) / F.nullif(F.col("n_pos"), F.lit(0.0))
    negative = (F.col("all2") - F.col("cos2")) / 2 / F.nullif(n_neg, F.lit(0.0))
    return one.select(
        F.coalesce((positive + negative) / 2, positive, negative).alias("embedding_loss"),
        F.coalesce(F.col("n_pos") + n_neg, F.lit(0)).cast("bigint").alias("n_pairs"),
        "n_dropped",
    )


def pair_vectors(pairs: DataFrame, embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``pair, target, u, v``: pairs with the vectors of their ends, from one scan of the vectors."""
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("id_left").alias("id")), F.struct(F.lit(1).alias("side"), F.col("id_right").alias("id"))
    )
    return pairs.select("pair", "target", F.inline(ends)).join(vectors, "id").groupBy("pair", "target").agg(
        F.first(F.when(F.col("side") == 0, F.col("vector")), ignorenulls=True).alias("u"),
        F.first(F.when(F.col("side") == 1, F.col("vector")), ignorenulls=True).alias("v"),
    )


def embedding_loss(
    pairs: DataFrame, embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Mean of ``(cos(u, v) - target)^2``; pairs with a zero vector are counted apart."""
    both = pair_vectors(pairs, embeddings, id_col, vector)
    scored = both.select("target", V.cosine(F.col("u"), F.col("v")).alias("cos"))
    return scored.agg(
        F.avg(F.pow(F.col("cos") - F.col("target"), F.lit(2.0))).alias("embedding_loss"),
        F.count("cos").alias("n_pairs"),
        F.count_if(F.col("cos").isNull()).alias("n_dropped"),
    )
