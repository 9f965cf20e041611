"""Gradient fits: many trials in one pass, stopped by medians; many targets in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import descent as N
from corpusloom.operators import trials as T


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    out = []
    for i in range(360):
        code = i % 3
        x = r.normal(0, 1, 4) + np.eye(4)[code] * 2.2
        out.append((i, x.tolist(), code, 1.0 + code))
    return spark.createDataFrame(out, "vec_id long, embedding array<double>, label_code long, weight double").repartition(5).cache()


def parts(rows):
    return rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0")


def grid(n=9):
    return [{"trial": k, "learning_rate": 10 ** (-5 + 0.5 * k), "l2_weight": 1e-4, "num_epochs": (4, 8)[k % 2]} for k in range(n)]


@pytest.mark.parametrize("errors, targets", [(N.softmax_errors, None), (N.sigmoid_errors, 3)])
def test_gradient_against_finite_differences(spark, rows, errors, targets):
    r = np.random.default_rng(4)
    weights = r.normal(0, 0.5, (2, 3, 5))
    target = F.col("label_code") if targets is None else F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (k <= F.col("label_code")).cast("double"))
    used = rows.select(F.col("embedding").alias("x"), target.alias("target"), "weight")
    gradient, loss, mass = N.gradients(used, weights, errors)
    assert mass == pytest.approx(720)
    for at in [(0, 0, 0), (1, 2, 3), (1, 1, 4)]:
        moved = weights.copy()
        moved[at] += 1e-6
        _, other, _ = N.gradients(used, moved, errors)
        assert (other - loss)[at[0]] / 1e-6 == pytest.approx(gradient[at], rel=1e-3, abs=1e-3)
        assert (other - loss)[1 - at[0]] == 0  # trials do not touch each other


def test_sums_do_not_depend_on_tasks(rows):
    weights = np.random.default_rng(5).normal(0, 0.5, (1, 3, 5))
    used = rows.select(F.col("embedding").alias("x"), F.col("label_code").alias("target"), "weight")
    one, other = (N.gradients(used.repartition(n), weights, N.softmax_errors)[0] for n in (1, 150))
    assert np.allclose(one, other, atol=1e-9)


def test_pruned_search_finds_the_winner_of_the_full_search(rows):
    train, val = parts(rows)
    results, log = N.search_head_pruned(train, val, grid(), 3)
    full, _ = N.search_head_pruned(train, val, grid(), 3, prune=False)
    got, whole = ({r.trial: r for r in df.collect()} for df in (results, full))
    assert {r.state for r in whole.values()} == {"COMPLETE"} and {r.state for r in got.values()} == {"COMPLETE", "PRUNED"}
    best = [T.best_trial(df.select("trial", "state", "value")).first() for df in (results, full)]
    assert best[0].trial == best[1].trial and best[0].value == best[1].value > 0.8
    assert sum(r.n_epochs for r in got.values()) < sum(r.n_epochs for r in whole.values())
    for t, r in got.items():  # a trial that goes on is fitted as if it were alone
        assert r.state == "PRUNED" or (r.value, r.n_epochs) == (whole[t].value, whole[t].n_epochs)
    steps = log.collect()
    assert len(steps) == sum(r.n_epochs for r in got.values())
    assert T.trial_results(log).join(results, ["trial", "state", "value"]).count() == len(got)


def test_pruning_follows_the_medians_of_the_log(rows):
    train, val = parts(rows)
    results, log = N.search_head_pruned(train, val, grid(), 3, startup_rounds=2)
    by_step, best = {}, {}
    for r in log.collect():
        by_step.setdefault(r.step, {})[r.trial] = r.value
    ended = {r.trial: (r.state, r.n_epochs) for r in results.collect()}
    for step in sorted(by_step):
        values = by_step[step]
        middle = np.median(list(values.values()))
        for t, v in values.items():
            best[t] = max(best.get(t, -1), v)
            stopped = step >= 2 and len(values) >= 3 and best[t] < middle and step + 1 < grid()[t]["num_epochs"]
            assert (ended[t] == ("PRUNED", step + 1)) == stopped


def test_search_refuses_what_it_cannot_do(rows, spark):
    train, val = parts(rows)
    with pytest.raises(ValueError):
        N.search_head_pruned(train, val, [], 3)
    with pytest.raises(ValueError):
        N.search_head_pruned(train, val, grid(1) * 2, 3)
    with pytest.raises(ValueError):
        N.search_head_pruned(train.limit(0), val, grid(1), 3)
    with pytest.raises(ValueError, match="too many weights"):
        N.Descent(np.zeros((N.MAX_WEIGHTS, 1, 2)), np.ones(1), np.ones(1), N.softmax_errors)
    noise = train.limit(5).withColumn("label_code", F.lit(-1).cast("bigint"))
    plain, mixed = (N.search_head_pruned(df, val, grid(2), 3)[0].collect() for df in (train, train.unionByName(noise)))
    assert [r.state for r in plain] == [r.state for r in mixed] and [r.value for r in plain] == [r.value for r in mixed]


def test_targets_together_equal_targets_alone(rows):
    both = rows.withColumn("targets", F.array((F.col("label_code") == 0).cast("double"), (F.col("label_code") >= 1).cast("double"), F.lit(1.0)))
    weights, loss = N.fit_targets(both, 3, epochs=12)
    assert weights.shape == (3, 5) and loss < 3 * np.log(2)
    for k in range(2):
        alone, _ = N.fit_targets(both.withColumn("targets", F.array(F.get("targets", F.lit(k)))), 1, epochs=12)
        assert np.allclose(alone[0], weights[k], atol=1e-9)
    scored = N.predict_targets(both.unionByName(both.limit(1).withColumn("embedding", F.lit(None).cast("array<double>"))), weights).collect()
    for r in scored:
        if r.embedding is None:
            assert r.target_probs is None
        else:
            z = weights[:, :4] @ np.array(r.embedding) + weights[:, 4]
            assert r.target_probs == pytest.approx((1 / (1 + np.exp(-z))).tolist())
