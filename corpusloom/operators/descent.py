"""Gradient fits of linear heads, for many trials or many targets in one pass over the rows.

A step of all open trials is one job: every task multiplies its rows with the weights of all
trials at once and returns one block of gradients, and blocks are added up in two rounds in
a fixed order.  The driver holds weights and their moments, whose size is that of trials x
classes x dimensions and is checked; rows never reach it.

Fits are warm: a round goes on from the weights of the round before, so a trial can be
judged after every round and stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.head import named_metric
from corpusloom.session import local_table

#: Most numbers of all weights together (a task holds a few blocks of this size).
MAX_WEIGHTS = 4_000_000
#: Blocks that one task adds up in the first round.
FAN_IN = 64
MIN_TRIALS_FOR_MEDIAN = 3

# Decay of the moments, and of the learning rate by epochs.
BETAS, EPSILON = (0.9, 0.999), 1e-8
DECAY_EVERY, DECAY = 5, 0.5


def softmax_errors(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient by the logits [row, trial, class] and cross-entropy [row, trial]; targets are class codes."""
    top = logits.max(2, keepdims=True)
    parts = np.exp(logits - top)
    total = parts.sum(2, keepdims=True)
    rows = np.arange(len(targets))
    loss = np.log(total[..., 0]) + top[..., 0] - logits[rows, :, targets]
    errors = parts / total
    errors[rows, :, targets] -= 1
    return errors, loss


def sigmoid_errors(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for independent targets [row, target] in 0..1: summed binary cross-entropy."""
    y = targets[:, None, :]
    loss = np.maximum(logits, 0) - logits * y + np.log1p(np.exp(-np.abs(logits)))
    return 1 / (1 + np.exp(-logits)) - y, loss.sum(2)


Errors = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def summed_blocks(blocks: DataFrame) -> np.ndarray | None:
    """The sum of ``slot, block`` rows (blocks of doubles), in the order of slots; None without rows."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table["slot"].to_numpy(), kind="stable")
        cells = table["block"].to_pylist()
        total = np.zeros(len(cells[0]) // 8)
        for i in order:
            total += np.frombuffer(cells[i], np.float64)
        return pa.table({"slot": pa.array([int(table["slot"].to_numpy().min())], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    few = blocks.withColumn("part", F.floor(F.col("slot") / FAN_IN).cast("int")).groupBy("part").applyInArrow(add, "slot int, block binary")
    rows = few.withColumn("part", F.col("slot") * 0).groupBy("part").applyInArrow(add, "slot int, block binary").collect()
    return np.frombuffer(rows[0].block, np.float64) if rows else None


def gradients(rows: DataFrame, weights: np.ndarray, errors: Errors) -> tuple[np.ndarray, np.ndarray, float]:
    """Summed gradient [trial, class, dims + 1], summed loss [trial] and summed weight of all rows.

    ``rows`` has ``x`` (array of doubles), ``target`` (code, or array of targets), ``weight``.
    """
    n_trials, n_classes, width = weights.shape

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = weights.reshape(n_trials * n_classes, width)
        gradient, loss, mass = np.zeros_like(flat), np.zeros(n_trials), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            x = np.hstack([x, np.ones((len(x), 1))])
            target = batch.column("target")
            y = _matrix(target) if pa.types.is_list(target.type) else target.to_numpy(zero_copy_only=False).astype(np.int64)
            w = batch.column("weight").to_numpy(zero_copy_only=False)
            by_logit, lost = errors((x @ flat.T).reshape(len(x), n_trials, n_classes), y)
            gradient += (by_logit * w[:, None, None]).reshape(len(x), -1).T @ x
            loss += (lost * w[:, None]).sum(0)
            mass += float(w.sum())
        out = np.concatenate([gradient.reshape(-1), loss, [mass]])
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["slot", "block"])

    total = summed_blocks(rows.mapInArrow(blocks, "slot int, block binary"))
    if total is None or total[-1] <= 0:
        raise ValueError("a fit needs rows with weight")
    return total[: weights.size].reshape(weights.shape), total[weights.size : -1], float(total[-1])


@dataclass
class Descent:
    """Weights of several heads and the moments of their gradients; steps go on where the last one ended."""

    weights: np.ndarray
    rates: np.ndarray
    l2: np.ndarray
    errors: Errors
    epoch: int = 0
    loss: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __post_init__(self):
        if self.weights.size > MAX_WEIGHTS:
            raise ValueError("too many weights for one pass: search fewer trials at a time")
        self.first, self.second = np.zeros_like(self.weights), np.zeros_like(self.weights)

    def step(self, rows: DataFrame) -> None:
        """One step of all heads along the mean gradient; the intercept is not shrunk."""
        total, loss, mass = gradients(rows, self.weights, self.errors)
        gradient = total / mass
        gradient[:, :, :-1] += self.l2[:, None, None] * self.weights[:, :, :-1]
        self.loss = loss / mass
        rates = self.rates * DECAY ** (self.epoch // DECAY_EVERY)
        self.epoch += 1
        self.first = BETAS[0] * self.first + (1 - BETAS[0]) * gradient
        self.second = BETAS[1] * self.second + (1 - BETAS[1]) * gradient**2
        mean, spread = self.first / (1 - BETAS[0] ** self.epoch), self.second / (1 - BETAS[1] ** self.epoch)
        self.weights = self.weights - rates[:, None, None] * mean / (np.sqrt(spread) + EPSILON)

    def keep(self, which: Sequence[int]) -> None:
        """Go on with some of the heads only."""
        at = np.asarray(which, int)
        for name in ("weights", "rates", "l2", "first", "second"):
            setattr(self, name, getattr(self, name)[at])


def _width(rows: DataFrame) -> int:
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("a fit needs rows with weight")
    return first["n"]


def trial_predictions(rows: DataFrame, trials: Sequence[int], weights: np.ndarray) -> DataFrame:
    """``trial, label_code, pred_code`` of every row and trial; ties go to the lowest code."""
    n_trials, n_classes, width = weights.shape
    names = pa.array(np.asarray(trials, np.int64))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            logits = x @ weights[:, :, :-1].reshape(-1, width - 1).T + weights[:, :, -1].reshape(-1)
            codes = logits.reshape(len(x), n_trials, n_classes).argmax(2)
            take = pa.array(np.repeat(np.arange(len(x)), n_trials))
            yield pa.record_batch(
                [names.take(pa.array(np.tile(np.arange(n_trials), len(x)))), batch.column("target").take(take), pa.array(codes.reshape(-1))],
                names=["trial", "label_code", "pred_code"],
            )

    return rows.select("x", F.col("target").cast("bigint").alias("target")).mapInArrow(predict, "trial long, label_code long, pred_code long")


def search_head_pruned(
    train: DataFrame, val: DataFrame, grid: Sequence[Mapping[str, Any]], n_classes: int,
    metric: str | Callable[[DataFrame], DataFrame] = "f1_macro", direction: str = "maximize",
    round_epochs: int = 1, startup_rounds: int = 1, prune: bool = True,
    vector: str = "embedding", label: str = "label_code", weight: str = "weight",
) -> tuple[DataFrame, DataFrame]:
    """The search that stops trials while they are fitted: ``results`` and ``log``.

    ``grid`` names ``trial, learning_rate, l2_weight, num_epochs`` of each trial.  All open
    trials take ``round_epochs`` steps, are scored on ``val``, and a trial whose best value
    so far is worse than the median of the values of this round ends there as PRUNED; the
    best trial is never worse than the median, so one always ends as COMPLETE.  No trial is
    stopped in the first ``startup_rounds`` rounds, or by fewer than three trials.

    ``results``: ``trial, state, value, n_epochs`` and the parameters; the value is that of
    the last round.  ``log``: ``trial, step, value, state``, as the other operators on trial
    logs take it.  Rows without a class (a negative or null code) are left out.
    """
    if not grid:
        raise ValueError("a search needs at least one grid point")
    if len({int(g["trial"]) for g in grid}) < len(grid):
        raise ValueError("trials need different numbers")
    score = metric if callable(metric) else named_metric(metric)
    spark = train.sparkSession
    x = F.col(vector).cast("array<double>").alias("x")
    rows = train.filter(F.col(label) >= 0).select(x, F.col(label).alias("target"), F.col(weight).cast("double").alias("weight"))
    held = val.filter(F.col(label) >= 0).select(x, F.col(label).alias("target"))
    rows, held = rows.persist(StorageLevel.MEMORY_AND_DISK), held.persist(StorageLevel.MEMORY_AND_DISK)
    sign = 1.0 if direction == "maximize" else -1.0
    try:
        open_trials = [dict(g) for g in grid]
        fits = Descent(
            np.zeros((len(grid), n_classes, _width(rows) + 1)),
            np.array([float(g["learning_rate"]) for g in grid]), np.array([float(g["l2_weight"]) for g in grid]), softmax_errors,
        )
        best: dict[int, float] = {}
        log: list[tuple[int, int, float]] = []
        states: dict[int, tuple[str, float, int]] = {}
        number = 0
        while open_trials:
            for _ in range(round_epochs):
                fits.step(rows)
            names = [int(g["trial"]) for g in open_trials]
            values = {r.trial: float(r.value) for r in score(trial_predictions(held, names, fits.weights)).collect() if r.value is not None}
            for t in names:
                log.append((t, number, values.get(t)))
                best[t] = max(best.get(t, -np.inf), sign * values[t]) if t in values else best.get(t, -np.inf)
            middle = float(np.median([sign * v for v in values.values()])) if values else -np.inf
            judged = prune and number >= startup_rounds and len(names) >= MIN_TRIALS_FOR_MEDIAN
            keep = []
            for i, g in enumerate(open_trials):
                t = int(g["trial"])
                if fits.epoch >= int(g["num_epochs"]):
                    states[t] = ("COMPLETE", values.get(t), fits.epoch)
                elif judged and best[t] < middle:
                    states[t] = ("PRUNED", values.get(t), fits.epoch)
                else:
                    keep.append(i)
            open_trials = [open_trials[i] for i in keep]
            fits.keep(keep)
            number += 1
    finally:
        rows.unpersist()
        held.unpersist()
    results = local_table(
        spark,
        [(int(g["trial"]), *states[int(g["trial"])], float(g["learning_rate"]), float(g["l2_weight"]), int(g["num_epochs"])) for g in grid],
        "trial bigint, state string, value double, n_epochs int, learning_rate double, l2_weight double, num_epochs int",
    )
    reports = [(t, s, v, states[t][0]) for t, s, v in log]
    return results, local_table(spark, reports, "trial bigint, step bigint, value double, state string")


def fit_targets(
    rows: DataFrame, n_targets: int, epochs: int = 50, learning_rate: float = 0.05, l2_weight: float = 0.0,
    vector: str = "embedding", targets: str = "targets", weight: str | None = None,
) -> tuple[np.ndarray, float]:
    """Weights [target, dims + 1] (the intercept last) and mean loss of independent targets in 0..1.

    One pass a step for all targets; no target's weights depend on another target, so the
    result is that of one fit per target.  Rows without targets are left out.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    used = rows.filter(F.col(targets).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(vector).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("target"), w.alias("weight")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = Descent(np.zeros((1, n_targets, _width(used) + 1)), np.array([learning_rate]), np.array([l2_weight]), sigmoid_errors)
        for _ in range(epochs):
            fit.step(used)
    finally:
        used.unpersist()
    return fit.weights[0], float(fit.loss[0])


def predict_targets(rows: DataFrame, weights: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Adds ``target_probs``: the probability of each target; null for a null vector."""
    width = weights.shape[1] - 1
    x = F.col(vector).cast("array<double>")
    logits = [
        F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in line[:width]]), lambda a, b: a * b), F.lit(float(line[width])), lambda s, v: s + v)
        for line in weights
    ]
    probs = F.transform(F.array(*logits), lambda z: 1 / (1 + F.exp(-z)))
    return rows.withColumn("target_probs", F.when(F.col(vector).isNotNull(), probs))
