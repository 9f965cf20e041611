"""The Parzen search against a brute-force density, and on a target it should find."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search as S

SPACE = {
    "rate": {"low": 1e-4, "high": 1.0, "log": True, "int": False},
    "size": {"low": 4, "high": 16, "log": False, "int": True},
    "epochs": {"choices": "1,5,10"},
}


def studies(spark, rows):
    return spark.createDataFrame(rows, "study long, trial long, state string, value double, rate double, size double, epochs double").repartition(3)


def sample(seed, n, study=1, state="COMPLETE", best=0.01):
    r = np.random.default_rng(seed)
    rows = []
    for t in range(n):
        rate, size, epochs = float(10 ** r.uniform(-4, 0)), float(r.integers(4, 17)), float(r.choice([1, 5, 10]))
        value = -abs(math.log10(rate) - math.log10(best)) - 0.1 * abs(size - 6) + (1.0 if epochs == 10 else 0.0)
        rows.append((study, t, state, value, rate, size, epochs))
    return rows


def unit(name, x):
    if name == "rate":
        return (math.log(x) - math.log(1e-4)) / (math.log(1.0) - math.log(1e-4))
    return (x - 4 + 0.5) / 13


def kernel_sum(z, points):
    """Density of points put at the middle of their bins, kernel by kernel."""
    n = len(points)
    centres = [(min(63, math.floor(max(0, min(1, p)) * 64)) + 0.5) / 64 for p in points]
    spread = float(np.std(centres)) * n ** -0.2 if n else 0.0
    s = max(1 / min(100, n + 1), spread) * math.sqrt(3) / math.pi
    cdf = lambda t: 1 / (1 + math.exp(-t))
    pdf = lambda t: cdf(t) * (1 - cdf(t))
    return (1 + sum(pdf((z - c) / s) / s / (cdf((1 - c) / s) - cdf(-c / s)) for c in centres)) / (n + 1)


def test_densities_against_single_kernels(spark):
    rows = sample(1, 60) + sample(2, 30, study=2) + sample(3, 40, study=1, state="FAIL")
    rows += [(1, 900, "COMPLETE", None, 0.1, 5.0, 1.0), (1, 901, "COMPLETE", float("nan"), 0.1, 5.0, 1.0), (2, 902, "COMPLETE", 0.3, None, 99.0, 7.0)]
    scored = S.log_ratio(S.candidates(S.densities(studies(spark, rows), SPACE), SPACE, seed=3)).collect()
    assert len(scored) == 2 * 3 * S.CANDIDATES
    for study in (1, 2):
        done = [r for r in rows if r[0] == study and r[2] == "COMPLETE" and r[3] is not None and not math.isnan(r[3])]
        done.sort(key=lambda r: (-r[3], r[1]))
        n_good = min(25, math.ceil(0.1 * len(done)))
        sides = done[:n_good], done[n_good:]
        for row in (r for r in scored if r.study == study):
            if row.param == "epochs":
                got = [[r[6] for r in side if r[6] in (1.0, 5.0, 10.0)] for side in sides]
                parts = [(sum(x == (1.0, 5.0, 10.0)[int(row.z)] for x in g) + 1) / (len(g) + 3) for g in got]
            else:
                at = 4 if row.param == "rate" else 5
                got = [[unit(row.param, r[at]) for r in side if r[at] is not None] for side in sides]
                assert (row.n_good, row.n_bad) == tuple(map(len, got))
                parts = [kernel_sum(row.z, g) for g in got]
            assert 0 <= row.z <= (2 if row.param == "epochs" else 1)
            assert row.log_ratio == pytest.approx(math.log(parts[0] / parts[1]), abs=1e-9)


def test_a_density_integrates_to_one(spark):
    density = S.densities(studies(spark, sample(4, 80)), {"rate": SPACE["rate"]})
    grid = density.crossJoin(spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("z")))
    for side in ("good", "bad"):
        total = grid.select(F.avg(S.kernel_density(F.col("z"), F.col("cells"), side, F.col(f"n_{side}"), F.col(f"scale_{side}")))).first()[0]
        assert total == pytest.approx(1, abs=1e-4)


def test_proposals_move_to_the_best(spark):
    rows = [r for k in range(40) for r in sample(10 + k, 100, study=k)]
    found = S.tpe_suggest(studies(spark, rows), SPACE).collect()
    assert len(found) == 40 * 3
    rates = [abs(math.log10(r.value) + 2) for r in found if r.param == "rate"]
    assert np.mean(rates) < 0.5  # a random draw is 1 away on average
    assert np.mean([r.value == 10 for r in found if r.param == "epochs"]) > 0.9
    assert all(r.value == int(r.value) and 4 <= r.value <= 16 for r in found if r.param == "size")
    lower = S.tpe_suggest(studies(spark, rows), SPACE, direction="minimize").collect()
    assert np.mean([abs(math.log10(r.value) + 2) for r in lower if r.param == "rate"]) > 1


def test_small_studies_draw_at_random_and_draws_repeat(spark):
    rows = sample(5, 9) + sample(6, 30, study=2) + sample(7, 20, study=3, state="RUNNING")
    first = {(r.study, r.param): r for r in S.tpe_suggest(studies(spark, rows), SPACE).collect()}
    assert len(first) == 9
    assert all((r.log_ratio is None) == (study in (1, 3)) for (study, _), r in first.items())
    again = {(r.study, r.param): r for r in S.tpe_suggest(studies(spark, rows[::-1]).repartition(5), SPACE).collect()}
    assert {k: r.value for k, r in again.items()} == {k: r.value for k, r in first.items()}
    assert S.tpe_suggest(studies(spark, []), SPACE).collect() == []
    with pytest.raises(ValueError):
        S.tpe_suggest(studies(spark, rows), SPACE, direction="up")


def test_equal_values_and_one_choice_are_fine(spark):
    rows = [(1, t, "COMPLETE", 0.5, 0.01, 4.0, 5.0) for t in range(50)]
    found = {r.param: r for r in S.tpe_suggest(studies(spark, rows), SPACE).collect()}
    assert (found["rate"].n_good, found["rate"].n_bad) == (5, 45)
    assert all(math.isfinite(r.log_ratio) and r.value is not None for r in found.values())
