"""Search spaces and trial logs: best trial, budget, pruning, checkpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import md5_key, uniform
from corpusloom.operators.ranking import TASK_ROWS
from corpusloom.session import bounded_rows, local_table

USED_STATES = ("COMPLETE", "RUNNING", "PRUNED")
TRIAL_BUDGET = 100
STARTUP_TRIALS = 5

#: Quantiles that bracket a median, and the accuracy of their sketch: its rank error is a
#: tenth of the bracket, which leaves a thousandth of the rows to be ranked.
BRACKET = (0.4995, 0.5005)
BRACKET_ACCURACY = 20_000

# Parameters used when a search space does not name them.
DEFAULTS = {"head_learning_rate": 1e-6, "batch_size": 128, "num_epochs": 50, "max_iter": 1}


def space_from_config(config: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """Search space of a config with ``{name}_min``, ``{name}_max``, ``{name}_log`` keys,
    comma lists and plain values."""
    space: dict[str, dict[str, Any]] = {}
    for key, value in config.items():
        if key.endswith("_min") and config.get(f"{key[:-4]}_max") is not None:
            name = key[:-4]
            whole = isinstance(value, int) and isinstance(config[f"{name}_max"], int)
            space[name] = {
                "low": value, "high": config[f"{name}_max"],
                "log": bool(config.get(f"{name}_log", False)), "int": whole,
            }
        elif key in ("batch_size", "num_epochs"):
            space[key] = {"choices": str(value)}
    return space


def suggestion(spec: Mapping[str, Any], u: Column) -> Column:
    """One draw of a parameter from a uniform ``u`` in [0, 1)."""
    if "choices" in spec:
        values = F.split(F.lit(spec["choices"]), ",")
        pick = F.floor(u * F.size(values)).cast("int")
        return F.trim(F.get(values, pick)).cast("double")
    low, high = F.lit(float(spec["low"])), F.lit(float(spec["high"]))
    if spec.get("int"):
        return low + F.floor(u * (high - low + 1)).cast("double")
    if spec.get("log"):
        return F.exp(F.ln(low) + u * (F.ln(high) - F.ln(low)))
    return low + u * (high - low)


def param_grid(trials: DataFrame, space: Mapping[str, Mapping[str, Any]], seed: int = 42) -> DataFrame:
    """``trial`` and one column per parameter, drawn from the space by trial number."""
    return trials.select(
        "trial",
        *[suggestion(spec, uniform(md5_key(f"{name}{seed}", "trial"))).alias(name) for name, spec in space.items()],
    )


def trial_results(log: DataFrame) -> DataFrame:
    """``trial, state, value``: each trial with the value of its last step."""
    return log.groupBy("trial").agg(
        F.max_by("state", "step").alias("state"), F.max_by("value", "step").alias("value")
    )


def best_trial(
    results: DataFrame, direction: str = "maximize", params: DataFrame | None = None,
    defaults: Mapping[str, float] = {},
) -> DataFrame:
    """The best COMPLETE trial, the earliest on ties, with its parameters.

    Parameters that are absent or null take their default.
    """
    sign = 1.0 if direction == "maximize" else -1.0
    key = F.struct(F.col("value") * sign, -F.col("trial"))
    best = (
        results.filter(F.col("state") == "COMPLETE")
        .agg(F.max_by(F.struct("trial", "value"), key).alias("b"))
        .select("b.*")
        .filter(F.col("trial").isNotNull())
    )
    if params is not None:
        best = best.join(params, "trial", "left")
    for name, value in defaults.items():
        known = F.coalesce(F.col(name), F.lit(value)) if name in best.columns else F.lit(value)
        best = best.withColumn(name, known.cast("double"))
    return best


def trial_budget(results: DataFrame, budget: int = TRIAL_BUDGET) -> DataFrame:
    """Trials per state, trials that count against the budget, and whether to stop."""
    used = F.count_if(F.col("state").isin(list(USED_STATES)))
    return results.agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in (*USED_STATES, "FAIL")],
        used.alias("n_used"),
        (used > budget).alias("stop"),
    )


def exact_median(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    """``group, median``: exact, without collecting a group.

    A quantile sketch brackets the median of each group.  Values outside the bracket
    are only counted; equal values inside it are counted together.
    """
    bracket = df.groupBy(group).agg(
        F.percentile_approx(value, list(BRACKET), BRACKET_ACCURACY).alias("_b"), F.count(value).alias("_n")
    )
    rows = bounded_rows(bracket)
    if rows is not None:
        bracket = local_table(df.sparkSession, rows, bracket.schema)
    side = F.when(F.col(value) < F.col("_b")[0], -1).when(F.col(value) > F.col("_b")[1], 1).otherwise(0)
    cells = (
        df.filter(F.col(value).isNotNull())
        .join(bracket, group)
        .groupBy(group, "_n", side.alias("_side"), F.when(side == 0, F.col(value)).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    upto = F.sum("_c").over(W.partitionBy(group).orderBy("_side", "_v"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)

    def holds(rank: Column) -> Column:
        return (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))

    middle = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
    return (
        cells.withColumn("_upto", upto)
        .groupBy(group)
        .agg(middle[0].alias("_low"), middle[1].alias("_high"))
        .select(
            group,
            F.when(F.col("_low").isNull() | F.col("_high").isNull(),
                   F.raise_error(F.lit("the median left its bracket")).cast("double"))
            .otherwise((F.col("_low") + F.col("_high")) / 2).alias("median"),
        )
    )


def running_best(
    log: DataFrame, run: str = "trial", step: str = "step", value: str = "value",
    direction: str = "maximize", max_rows: int = TASK_ROWS,
) -> DataFrame:
    """Add ``best_value`` and ``best_step`` up to each step; the earliest of equals wins.

    A run longer than ``max_rows`` is cut into blocks of steps: the best of the blocks
    before is looked up, so no task walks a whole long run.
    """
    sign = 1.0 if direction == "maximize" else -1.0
    keyed = log.withColumn("_k", F.struct((F.col(value) * sign).alias("v"), (-F.col(step)).alias("s")))
    longest = log.groupBy(run).count().agg(F.max("count")).first()[0] or 0
    if longest <= max_rows:
        upto = W.partitionBy(run).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
        best = keyed.withColumn("_best", F.max("_k").over(upto))
    else:
        keyed = keyed.withColumn("_block", F.floor(F.col(step) / max_rows))
        blocks = keyed.groupBy(run, "_block").agg(F.max("_k").alias("_top"))
        before = W.partitionBy(run).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        blocks = blocks.select(run, "_block", F.max("_top").over(before).alias("_prior"))
        upto = W.partitionBy(run, "_block").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
        best = (
            keyed.join(blocks, [run, "_block"])
            .withColumn("_best", F.greatest(F.max("_k").over(upto), F.col("_prior")))
            .drop("_block", "_prior")
        )
    return best.withColumns(
        {"best_value": F.col("_best.v") * sign, "best_step": -F.col("_best.s")}
    ).drop("_k", "_best")


def best_checkpoint(log: DataFrame, run: str = "trial", direction: str = "maximize", **options) -> DataFrame:
    """The best checkpoint so far, and whether this step set it."""
    best = running_best(log, run, direction=direction, **options)
    return best.withColumn("is_best", F.col("best_step") == F.col("step"))


def prune_flags(
    log: DataFrame, direction: str = "maximize", startup: int = STARTUP_TRIALS, **options
) -> DataFrame:
    """Flag the steps at which a trial's best so far is worse than the median of the
    finished trials at that step; never with fewer than ``startup`` finished trials."""
    complete = log.filter(F.col("state") == "COMPLETE")
    n_complete = complete.select("trial").distinct().count()
    best = running_best(log, direction=direction, **options)
    medians = exact_median(complete, "step")
    worse = (F.col("best_value") < F.col("median")) if direction == "maximize" else (F.col("best_value") > F.col("median"))
    prune = F.coalesce(worse, F.lit(False)) if n_complete >= startup else F.lit(False)
    return best.join(medians, "step", "left").withColumn("prune", prune)


def round_loss(col: Column) -> Column:
    """Logged losses keep 4 digits, half to even."""
    return F.bround(col, 4)


def epoch_loss(log: DataFrame, steps_per_epoch: int = 10) -> DataFrame:
    """Mean batch loss per trial and epoch."""
    epoch = F.floor(F.col("step") / steps_per_epoch).cast("bigint")
    return log.groupBy("trial", epoch.alias("epoch")).agg(
        F.avg("value").alias("epoch_loss"), F.count("*").alias("n_steps")
    )


def retain_latest(log: DataFrame, k: int, run: str = "trial", step: str = "step") -> DataFrame:
    """The newest ``k`` checkpoints of each run.

    Spark keeps only ``k`` rows per run before the shuffle, so a long run is no burden.
    """
    newest = F.row_number().over(W.partitionBy(run).orderBy(F.desc(step)))
    return log.withColumn("_rank", newest).filter(F.col("_rank") <= k).drop("_rank")


def eval_steps(batch_size: int, total: int = 25_000, evaluations: int = 10) -> tuple[int, int]:
    """Steps of a run over ``total`` examples, and steps between two evaluations."""
    return total // batch_size, int(total / evaluations // batch_size)


def missing_params(params: Sequence[str]) -> dict[str, float]:
    """Defaults for the named parameters."""
    return {p: float(DEFAULTS[p]) for p in params if p in DEFAULTS}


# -- heartbeats ------------------------------------------------------------------

# Fixed value: seconds between two heartbeats of a live trial.
HEARTBEAT_SECONDS = 60


def heartbeat_sessions(beats: DataFrame, gap_seconds: int) -> DataFrame:
    """``trial, session, first_beat, last_beat, n_beats``: runs of heartbeats without a longer gap.

    ``beats`` has ``trial, at`` (a timestamp); null times are left out, repeated ones count.
    Beats are first thinned to the first and last of every stretch of ``gap_seconds``: two
    beats of one stretch are never further apart than the gap, so only these can border a
    gap.  A trial with more beats than a task should sort is thus small before it is sorted.
    """
    beats = beats.select("trial", F.col("at").cast("timestamp").alias("at"))
    seconds = F.col("at").cast("double")
    stretches = beats.filter(F.col("at").isNotNull()).groupBy("trial", F.floor(seconds / gap_seconds).alias("stretch")).agg(
        F.min("at").alias("first_beat"), F.max("at").alias("last_beat"), F.count("*").alias("n_beats")
    )
    by_time = W.partitionBy("trial").orderBy("stretch")
    apart = F.col("first_beat").cast("double") - F.lag("last_beat").over(by_time).cast("double") > gap_seconds
    marked = stretches.withColumn("_new", F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("_new").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("trial", "session").agg(
        F.min("first_beat").alias("first_beat"), F.max("last_beat").alias("last_beat"), F.sum("n_beats").alias("n_beats")
    )


def stale_trials(beats: DataFrame, states: DataFrame, now: Column, gap_seconds: int, max_retry: int = 3) -> DataFrame:
    """``trial, session, state, attempt, retried_from, will_retry`` and the session's times.

    A trial runs while it beats.  When it is silent for more than ``gap_seconds`` it is stale:
    it fails, and the next session of its beats is a retry of that one.  ``states`` gives
    the state in which a trial ended (``trial, state``; a trial without one is RUNNING).
    The last session of a trial has its end state; a RUNNING one that is silent at ``now``
    is stale as well.  All earlier sessions are FAIL.  ``attempt`` counts from 0,
    ``retried_from`` is the session before, and ``will_retry`` says that a failed session
    which was silent, and is the last, may be started again: ``attempt < max_retry``.
    Trials that never beat have no row.
    """
    sessions = heartbeat_sessions(beats, gap_seconds)
    ends = states.groupBy("trial").agg(F.max("state").alias("_end"))
    last = F.col("session") == F.max("session").over(W.partitionBy("trial"))
    silent = now.cast("double") - F.col("last_beat").cast("double") > gap_seconds
    end = F.coalesce("_end", F.lit("RUNNING"))
    rows = sessions.withColumn("_last", last).join(ends, "trial", "left")
    state = F.when(~F.col("_last"), "FAIL").when((end == "RUNNING") & silent, "FAIL").otherwise(end)
    return rows.select(
        "trial", F.col("session").cast("bigint").alias("session"), "first_beat", "last_beat", "n_beats",
        state.alias("state"),
        F.col("session").cast("bigint").alias("attempt"),
        F.when(F.col("session") > 0, F.col("session") - 1).cast("bigint").alias("retried_from"),
        (F.col("_last") & (end == "RUNNING") & silent & (F.col("session") < max_retry)).alias("will_retry"),
    )
