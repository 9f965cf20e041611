"""A linear adapter of embeddings, trained on contrastive pairs.

The adapter is a matrix that is trained so that the cosine of two adapted vectors comes near
the pair's target.  A step is one job over a mini-batch of pairs: every task returns one
block of gradients, and blocks are added up in a fixed order, so a fit can be repeated bit
by bit.  Only the matrix, whose size is checked, is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.descent import BETAS, EPSILON, MAX_WEIGHTS, summed_blocks


def pair_gradient(u: np.ndarray, v: np.ndarray, target: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Summed gradient and loss of ``(cos(Au, Av) - target)^2`` and the number of pairs.

    Pairs with an end that is adapted to zero have no cosine and count nowhere.
    """
    p, q = u @ matrix.T, v @ matrix.T
    size_p, size_q = np.linalg.norm(p, axis=1), np.linalg.norm(q, axis=1)
    ok = (size_p > 0) & (size_q > 0)
    u, v, size_p, size_q, target = u[ok], v[ok], size_p[ok, None], size_q[ok, None], target[ok]
    p, q = p[ok] / size_p, q[ok] / size_q
    cosine = (p * q).sum(1)
    error = cosine - target
    by_p = 2 * error[:, None] * (q - cosine[:, None] * p) / size_p
    by_q = 2 * error[:, None] * (p - cosine[:, None] * q) / size_q
    return by_p.T @ u + by_q.T @ v, float((error**2).sum()), int(ok.sum())


def summed_gradients(rows: DataFrame, matrix: np.ndarray) -> tuple[np.ndarray, float, int]:
    """The same over all ``u, v, target`` rows of a table."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(matrix.size + 2)
        for batch in batches:
            if batch.num_rows:
                u, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("u", "v"))
                gradient, loss, n = pair_gradient(u, v, batch.column("target").to_numpy(zero_copy_only=False), matrix)
                total += np.concatenate([gradient.reshape(-1), [loss, n]])
        yield pa.record_batch(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "block"])

    total = summed_blocks(rows.select("u", "v", "target").mapInArrow(blocks, "slot int, block binary"))
    if total is None:
        return np.zeros_like(matrix), 0.0, 0
    return total[:-2].reshape(matrix.shape), float(total[-2]), int(total[-1])


def fit_adapter(
    train: DataFrame, held_out: DataFrame, epochs: int = 3, batches: int = 4, learning_rate: float = 0.002,
) -> tuple[np.ndarray, list[tuple[int, float | None, float | None]]]:
    """The matrix after ``epochs`` passes over the pairs, and ``(epoch, train_loss, eval_loss)`` of each.

    Both tables have ``pair, target, u, v`` (ends as vectors of one width; pairs with a null end are
    left out).  Pairs go into ``batches`` mini-batches by a hash of their number.  The matrix starts
    as the identity, so epoch 0 is the loss of the vectors as they are; a loss over no pairs is None.
    """
    spark = train.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fixed(pairs: DataFrame) -> DataFrame:
        ends = [F.col(c).cast("array<double>").alias(c) for c in ("u", "v")]
        rows = pairs.where("u is not null and v is not null and target is not null").select(
            "pair", F.col("target").cast("double").alias("target"), *ends,
            F.pmod(F.xxhash64("pair"), F.lit(batches)).alias("batch"))
        return rows.repartition(n_parts, "pair").sortWithinPartitions("pair").persist(StorageLevel.MEMORY_AND_DISK)

    rows, checks = fixed(train), fixed(held_out)
    try:
        first = rows.select(F.size("u").alias("n")).first()
        if first is None:
            raise ValueError("a fit needs pairs")
        if first["n"] ** 2 > MAX_WEIGHTS:
            raise ValueError("vectors too wide for an adapter on one driver")
        matrix = np.eye(first["n"])
        mean, spread, step = np.zeros_like(matrix), np.zeros_like(matrix), 0

        def loss(pairs: DataFrame) -> float | None:
            _, total, n = summed_gradients(pairs, matrix)
            return total / n if n else None

        log = [(0, loss(rows), loss(checks))]
        for epoch in range(1, epochs + 1):
            for k in range(batches):
                gradient, _, n = summed_gradients(rows.where(F.col("batch") == k), matrix)
                if not n:
                    continue
                step += 1
                gradient = gradient / n
                mean = BETAS[0] * mean + (1 - BETAS[0]) * gradient
                spread = BETAS[1] * spread + (1 - BETAS[1]) * gradient**2
                moved = mean / (1 - BETAS[0] ** step) / (np.sqrt(spread / (1 - BETAS[1] ** step)) + EPSILON)
                matrix = matrix - learning_rate * moved
            log.append((epoch, loss(rows), loss(checks)))
    finally:
        rows.unpersist()
        checks.unpersist()
    return matrix, log


def adapted(df: DataFrame, matrix: np.ndarray, vector: str = "embedding", out: str = "adapted") -> DataFrame:
    """Add the adapted vectors; null for a null vector."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            made = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            known = np.flatnonzero(rows.notna().to_numpy())
            if len(known):
                x = np.stack(rows.iloc[known].to_numpy()).astype("float64") @ matrix.T
                for at, line in zip(known, x):
                    made.iat[at] = line
            yield made

    return df.withColumn(out, project(F.col(vector).cast("array<double>")))
