"""Search that learns from finished trials: Parzen estimators for many studies at once.

The finished trials of a study are split at a quantile of their value.  For every parameter
the good and the other trials give one density each; candidates are drawn from the good one,
and the candidate whose good density is largest against the other one is proposed.

Trials are only counted: a parameter's range is cut into bins, and a density is a sum of
kernels at the bins.  So a study of any size reaches the densities as at most ``BINS``
counts a parameter, combined before the shuffle, and no study is gathered or sorted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import md5_key, uniform
from corpusloom.functions.vectors import let
from corpusloom.operators.trials import suggestion

BINS = 64
STARTUP_TRIALS = 10
GOOD_SHARE = 0.1
MAX_GOOD = 25
CANDIDATES = 24
#: Scale of a logistic kernel of unit standard deviation.
LOGISTIC = math.sqrt(3) / math.pi

Space = Mapping[str, Mapping[str, Any]]


def choices(spec: Mapping[str, Any]) -> list[float]:
    return [float(c) for c in str(spec["choices"]).split(",")]


def bins(spec: Mapping[str, Any]) -> int:
    """Bins of a parameter: its choices, or ``BINS`` equal parts of its range."""
    return len(choices(spec)) if "choices" in spec else BINS


def to_unit(spec: Mapping[str, Any], x: Column) -> Column:
    """A parameter's value as a place in [0, 1]; null stays null."""
    low, high = F.lit(float(spec["low"])), F.lit(float(spec["high"]))
    if spec.get("int"):
        place = (x - low + 0.5) / (high - low + 1)
    elif spec.get("log"):
        place = (F.ln(x) - F.ln(low)) / (F.ln(high) - F.ln(low))
    else:
        place = (x - low) / (high - low)
    return F.when(place.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)))


def to_bin(spec: Mapping[str, Any], x: Column) -> Column:
    """The bin of a value; null for null and for values that are no choice."""
    if "choices" in spec:
        at = F.array_position(F.array(*[F.lit(c) for c in choices(spec)]), x.cast("double"))
        return F.when(at > 0, (at - 1).cast("int"))
    return F.when(x.isNotNull(), F.least(F.lit(BINS - 1), F.floor(to_unit(spec, x.cast("double")) * BINS)).cast("int"))


def split_trials(trials: DataFrame, direction: str = "maximize", share: float = GOOD_SHARE, most: int = MAX_GOOD) -> tuple[DataFrame, DataFrame]:
    """``study, n, n_good`` of each study, and its good trials: the best ``ceil(share * n)``, at most ``most``.

    Only complete trials with a value count.  Of equal values the earlier trial is better.
    A task keeps at most ``most`` trials of a study before they are shuffled.
    """
    complete = trials.filter((F.col("state") == "COMPLETE") & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    sizes = complete.groupBy("study").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("n_good", F.least(F.lit(most), F.ceil(F.col("n") * F.lit(share))).cast("bigint"))
    order = F.col("value").desc() if direction == "maximize" else F.col("value").asc()
    best = complete.withColumn("_rank", F.row_number().over(W.partitionBy("study").orderBy(order, "trial")))
    good = best.filter(F.col("_rank") <= most).join(sizes, "study").filter(F.col("_rank") <= F.col("n_good"))
    return sizes, good.drop("_rank", "n", "n_good")


def parameter_counts(trials: DataFrame, space: Space) -> DataFrame:
    """``study, param, bin, n``: how often a study's trials fall in each bin of a parameter."""
    cells = F.array(*[F.struct(F.lit(name).alias("param"), to_bin(spec, F.col(name)).alias("bin")) for name, spec in space.items()])
    return (
        trials.select("study", F.inline(cells)).filter("bin is not null").groupBy("study", "param", "bin").agg(F.count("*").alias("n"))
    )


def densities(trials: DataFrame, space: Space, direction: str = "maximize", share: float = GOOD_SHARE, most: int = MAX_GOOD) -> DataFrame:
    """``study, param, cells, n_good, n_bad, scale_good, scale_bad`` of every parameter with finished trials.

    ``cells`` lists the bins in order with their good and other trials and their centres in
    [0, 1].  A scale is that of the kernels of a side: its spread times n^(-1/5), but not
    below 1 / min(100, n + 1).
    """
    _, good = split_trials(trials, direction, share, most)
    complete = trials.filter((F.col("state") == "COMPLETE") & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    every = parameter_counts(complete, space)
    of_good = parameter_counts(good, space).withColumnRenamed("n", "good")
    cells = every.join(of_good, ["study", "param", "bin"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    n_bins = F.create_map(*[F.lit(v) for name, spec in space.items() for v in (name, bins(spec))])
    cells = cells.withColumn("bad", F.col("n") - F.col("good")).withColumn("centre", (F.col("bin") + 0.5) / n_bins[F.col("param")])

    def spread(side: str) -> Column:
        n, total, squares = (F.sum(F.col(side) * x) for x in (F.lit(1), F.col("centre"), F.col("centre") * F.col("centre")))
        wide = F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))) * F.pow(n, F.lit(-0.2))
        floor = F.lit(1.0) / F.least(F.lit(100), n + 1)
        return F.greatest(floor, F.coalesce(F.when(n > 0, wide), F.lit(0.0))) * LOGISTIC

    return cells.groupBy("study", "param").agg(
        F.array_sort(F.collect_list(F.struct("bin", "centre", "good", "bad"))).alias("cells"),
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
        spread("good").alias("scale_good"), spread("bad").alias("scale_bad"),
    )


def kernel_density(z: Column, cells: Column, side: str, n: Column, scale: Column) -> Column:
    """Density at z in [0, 1]: logistic kernels at the bins, cut off at 0 and 1, and one uniform part."""
    def one(total: Column, cell: Column) -> Column:
        mass = 1 / (1 + F.exp(-(1 - cell["centre"]) / scale)) - 1 / (1 + F.exp(cell["centre"] / scale))
        kernel = let(F.exp(-F.abs((z - cell["centre"]) / scale)), lambda t: t / (scale * (1 + t) * (1 + t) * mass))
        return total + F.when(cell[side] > 0, cell[side] * kernel).otherwise(0.0)

    return (F.aggregate(cells, F.lit(1.0), one) / (n + 1)).cast("double")


def choice_density(bin_: Column, cells: Column, side: str, n: Column, k: Column) -> Column:
    """Share of a choice, every choice counted once more than it was seen."""
    seen = F.aggregate(cells, F.lit(0).cast("bigint"), lambda total, c: total + F.when(c["bin"] == bin_, c[side]).otherwise(F.lit(0)))
    return ((seen + 1) / (n + k)).cast("double")


def candidates(density: DataFrame, space: Space, seed: int, n: int = CANDIDATES) -> DataFrame:
    """Adds ``draw, z`` (a place in [0, 1], or the number of a choice): ``n`` draws from the good density.

    A draw takes one good trial, or the uniform part, at random and then a place under its kernel.
    """
    k = F.create_map(*[F.lit(v) for name, spec in space.items() for v in (name, bins(spec) if "choices" in spec else 0)])
    drawn = density.withColumn("k", k[F.col("param")]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u1, u2 = (uniform(md5_key(f"{salt}{seed}", "study", "param", "draw")) for salt in ("part", "place"))
    drawn = drawn.withColumns({"u1": u1, "u2": u2})
    points = lambda field: F.flatten(F.transform("cells", lambda c: F.array_repeat(c[field].cast("double"), c["good"].cast("int"))))

    def under(centre: Column) -> Column:
        scale = F.col("scale_good")
        below = 1 / (1 + F.exp(centre / scale))
        p = below + F.col("u2") * (1 / (1 + F.exp(-(1 - centre) / scale)) - below)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), centre + scale * F.ln(p / (1 - p))))

    place = let(
        F.get(points("centre"), F.floor(F.col("u1") * (F.col("n_good") + 1)).cast("int")),
        lambda centre: F.when(centre.isNull(), F.col("u2")).otherwise(under(centre)),
    )
    chosen = F.get(
        F.concat(points("bin"), F.transform(F.sequence(F.lit(0), F.greatest(F.col("k"), F.lit(1)) - 1), lambda i: i.cast("double"))),
        F.floor(F.col("u1") * (F.col("n_good") + F.col("k"))).cast("int"),
    )
    return drawn.withColumn("z", F.when(F.col("k") > 0, chosen).otherwise(place)).drop("u1", "u2")


def log_ratio(drawn: DataFrame) -> DataFrame:
    """Adds ``log_ratio`` of the good density and the other one at ``z``."""
    def of(side: str, z: Column) -> Column:
        n = F.col(f"n_{side}")
        return F.when(F.col("k") > 0, choice_density(z, F.col("cells"), side, n, F.col("k"))).otherwise(
            kernel_density(z, F.col("cells"), side, n, F.col(f"scale_{side}"))
        )

    rated = let(F.col("z"), lambda z: F.struct(z.alias("z"), (F.ln(of("good", z)) - F.ln(of("bad", z))).alias("log_ratio")))
    return drawn.withColumn("_rated", rated).drop("z").select("*", "_rated.*").drop("_rated")


def _valued(spec: Mapping[str, Any], z: Column) -> Column:
    if "choices" in spec:
        return F.get(F.array(*[F.lit(c) for c in choices(spec)]), z.cast("int"))
    # the largest place below 1 keeps whole numbers inside their range
    return suggestion(spec, F.least(z, F.lit(1 - 2.0**-53)))


def tpe_suggest(
    trials: DataFrame, space: Space, direction: str = "maximize", seed: int = 42, startup: int = STARTUP_TRIALS,
    share: float = GOOD_SHARE, most: int = MAX_GOOD, n_candidates: int = CANDIDATES,
) -> DataFrame:
    """``study, param, value, log_ratio, n_good, n_bad``: the next trial of every study.

    ``trials`` has ``study, trial, state, value`` and one column per parameter.  A study with
    fewer than ``startup`` complete trials gets a random draw, with a null ``log_ratio``;
    so does a parameter that none of them names.  Of equal ratios the earlier draw wins.
    """
    if direction not in ("maximize", "minimize"):
        raise ValueError("direction is maximize or minimize")
    sizes, _ = split_trials(trials, direction, share, most)
    asked = trials.select("study").distinct().join(sizes, "study", "left").select(
        "study", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.array(*map(F.lit, space))).alias("param")
    )
    known = densities(trials, space, direction, share, most).join(sizes.filter(F.col("n") >= startup).select("study"), "study", "left_semi")
    # few bytes with much to compute: the tasks would otherwise be merged by size
    known = known.repartition(trials.sparkSession.sparkContext.defaultParallelism * 2, "study", "param")
    scored = log_ratio(candidates(known, space, seed, n_candidates))
    best = scored.groupBy("study", "param").agg(
        # rounded, so that ratios equal but for the order of a sum are equal
        F.max(F.struct(
            F.round("log_ratio", 9).alias("rounded"), (-F.col("draw")).alias("earlier"), "log_ratio", "z", "n_good", "n_bad",
        )).alias("b")
    ).select("study", "param", "b.log_ratio", "b.z", "b.n_good", "b.n_bad")
    value = F.lit(None).cast("double")
    for name, spec in space.items():
        random = suggestion(spec, uniform(md5_key(f"start{seed}", "study", "param")))
        value = F.when(F.col("param") == name, F.coalesce(_valued(spec, F.col("z")), random)).otherwise(value)
    return asked.join(best, ["study", "param"], "left").select(
        "study", "param", value.cast("double").alias("value"), "log_ratio",
        F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"),
    )
