import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sorted_rows
from corpusloom.operators import trials as T

LOG = "trial bigint, step bigint, value double, state string"


def test_space_from_config():
    space = T.space_from_config({
        "lr_min": 1e-4, "lr_max": 1e-1, "lr_log": True, "size_min": 4, "size_max": 8, "num_epochs": "1,5",
        "batch_size": 8, "model_id": "m",
    })
    assert space["lr"] == {"low": 1e-4, "high": 1e-1, "log": True, "int": False}
    assert space["size"]["int"] and space["num_epochs"] == {"choices": "1,5"} and space["batch_size"] == {"choices": "8"}
    assert "model_id" not in space


def test_param_grid_ranges(spark):
    trials = spark.range(500).withColumnRenamed("id", "trial")
    space = {"lr": {"low": 1e-4, "high": 1e-1, "log": True}, "n": {"low": 4, "high": 8, "int": True},
             "e": {"choices": "1, 5,50"}, "w": {"low": 0.0, "high": 2.0}}
    rows = T.param_grid(trials, space).collect()
    assert rows == T.param_grid(trials.repartition(7), space).orderBy("trial").collect()
    assert {r.n for r in rows} == {4.0, 5.0, 6.0, 7.0, 8.0} and {r.e for r in rows} == {1.0, 5.0, 50.0}
    assert all(1e-4 <= r.lr <= 1e-1 and 0 <= r.w < 2 for r in rows)
    assert 0.4 < sum(r.lr < 10**-2.5 for r in rows) / 500 < 0.6  # half of a log range
    assert {r.lr for r in rows} != {r.lr for r in T.param_grid(trials, space, seed=1).collect()}


def test_best_trial_counts_complete_ones_and_the_earliest_tie(make):
    log = make([(0, 0, 0.9, "FAIL"), (1, 0, 0.9, "COMPLETE"), (1, 1, 0.5, "COMPLETE"), (2, 0, 0.5, "COMPLETE"),
                (3, 0, 0.1, "COMPLETE"), (4, 0, 0.99, "PRUNED")], LOG)
    results = T.trial_results(log)
    params = make([(1, 0.01, None)], "trial bigint, lr double, num_epochs double")
    best = T.best_trial(results, "maximize", params, {"num_epochs": 50.0, "batch_size": 128.0}).first().asDict()
    assert best == {"trial": 1, "value": 0.5, "lr": 0.01, "num_epochs": 50.0, "batch_size": 128.0}
    assert tuple(T.best_trial(results, "minimize").first()) == (3, 0.1)
    assert T.best_trial(results.filter("state = 'FAIL'")).count() == 0


def test_budget(make):
    rows = [(i, s) for i, s in enumerate(["COMPLETE"] * 3 + ["RUNNING"] + ["PRUNED"] * 2 + ["FAIL"] * 9)]
    df = make(rows, "trial bigint, state string")
    assert tuple(T.trial_budget(df, 6).first()) == (3, 1, 2, 9, 6, False)
    assert T.trial_budget(df, 5).first().stop


@pytest.mark.parametrize("sizes", [[1], [2, 3], [4, 1000], [1, 5001]])
def test_exact_median(make, sizes):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.random(), 0.25, 7.5])) for g, n in enumerate(sizes) for _ in range(n)]
    got = {r.g: r.median for r in T.exact_median(make(rows + [(0, None)], "g int, value double"), "g").collect()}
    for g in range(len(sizes)):
        assert got[g] == pytest.approx(np.median([v for k, v in rows if k == g]))


def test_exact_median_of_one_repeated_value(make):
    assert T.exact_median(make([(0, 3.0)] * 2000, "g int, value double"), "g").first().median == 3.0


@pytest.mark.parametrize("direction", ["maximize", "minimize"])
def test_running_best_does_not_depend_on_blocks(make, direction):
    rng = random.Random(3)
    rows = [(r, s, float(rng.randint(0, 9))) for r in range(3) for s in range(60 if r else 200)]
    df = make(rows, "trial bigint, step bigint, value double")
    whole = sorted_rows(T.running_best(df, direction=direction))
    assert whole == sorted_rows(T.running_best(df, direction=direction, max_rows=16))
    pick = max if direction == "maximize" else min
    for trial, step, _, best, best_step in whole:
        seen = [(v, s) for r, s, v in rows if r == trial and s <= step]
        assert best == pick(v for v, _ in seen) and best_step == min(s for v, s in seen if v == best)


def test_best_checkpoint_needs_strict_improvement(make):
    df = make([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.7), (1, 4, 0.6)], "trial bigint, step bigint, value double")
    assert {r.step: r.is_best for r in T.best_checkpoint(df).collect()} == {1: True, 2: False, 3: True, 4: False}


def prune_case(make, complete):
    rows = [(t, s, float(t), "COMPLETE") for t in range(complete) for s in (0, 1)]
    return make(rows + [(90, 0, 1.0, "RUNNING"), (90, 1, 0.0, "RUNNING"), (91, 0, 3.0, "RUNNING"), (92, 7, -1.0, "RUNNING")], LOG)


def test_no_pruning_during_start_up(make):
    assert not any(r.prune for r in T.prune_flags(prune_case(make, 4)).collect())


def test_pruning_compares_the_best_so_far_with_the_median(make):
    flags = {(r.trial, r.step): r.prune for r in T.prune_flags(prune_case(make, 5)).collect()}
    assert flags[90, 0] and flags[90, 1]  # best 1 below the median 2
    assert not flags[91, 0] and not flags[92, 7]  # better; no finished trial at that step
    assert not flags[2, 0]  # a tie survives
    low = {(r.trial, r.step): r.prune for r in T.prune_flags(prune_case(make, 5), "minimize").collect()}
    assert not low[90, 1] and low[91, 0]


def test_epoch_loss_and_rounding(make):
    df = make([(1, s, float(s), "COMPLETE") for s in range(20)], LOG)
    assert sorted_rows(T.epoch_loss(df)) == [(1, 0, 4.5, 10), (1, 1, 14.5, 10)]
    assert [r[0] for r in make([(0.12345,), (0.12355,)], "v double").select(T.round_loss(F.col("v"))).collect()] == [0.1234, 0.1236]


def test_retention_keeps_the_newest(make):
    df = make([(r, s, 0.0, "x") for r in (1, 2) for s in range(r * 4)], LOG)
    kept = T.retain_latest(df, 5)
    assert [(r.trial, r.step) for r in sorted(kept.collect())] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (2, 5), (2, 6), (2, 7)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_steps_and_defaults():
    assert T.eval_steps(16) == (1562, 156)
    assert T.missing_params(["batch_size", "unknown"]) == {"batch_size": 128.0}


# -- heartbeats --------------------------------------------------------------------


def test_stale_trials(spark):
    start = 1_700_000_000
    beats = {1: [0, 50, 100, 220, 230, 500], 2: [7], 3: [0, 60, 120], 4: [0, 61, 200, 400, 700]}
    rows = [(t, start + s) for t, seconds in beats.items() for s in seconds] + [(1, start), (5, None)]
    df = spark.createDataFrame(rows, "trial long, s long").selectExpr("trial", "timestamp_seconds(s) as at").repartition(3)
    states = spark.createDataFrame([(1, "COMPLETE"), (2, "RUNNING"), (4, "RUNNING"), (9, "FAIL")], "trial long, state string")
    now = F.timestamp_seconds(F.lit(start + 755))
    found = {(r.trial, r.session): r for r in T.stale_trials(df, states, now, 60).collect()}
    assert {k: (r.n_beats, r.state, r.retried_from, r.will_retry) for k, r in found.items()} == {
        (1, 0): (4, "FAIL", None, False), (1, 1): (2, "FAIL", 0, False), (1, 2): (1, "COMPLETE", 1, False),
        (2, 0): (1, "FAIL", None, True),
        (3, 0): (3, "FAIL", None, True),  # 60 seconds are no gap
        (4, 0): (1, "FAIL", None, False), (4, 1): (1, "FAIL", 0, False), (4, 2): (1, "FAIL", 1, False),
        (4, 3): (1, "FAIL", 2, False), (4, 4): (1, "RUNNING", 3, False),
    }
    assert T.stale_trials(df.limit(0), states, now, 60).count() == 0


def test_sessions_of_a_long_trial_match_a_walk(spark):
    import random

    r, t, times = random.Random(2), 0, []
    for _ in range(3000):
        t += r.choice([0, 1, 1, 2, 5, 59, 60, 61, 90])
        times.append(t)
    df = spark.createDataFrame([(1, t) for t in times], "trial long, s long").selectExpr("trial", "timestamp_seconds(s) as at")
    want, last = [], None
    for t in times:
        if last is None or t - last > 60:
            want.append(0)
        want[-1] += 1
        last = t
    got = T.heartbeat_sessions(df, 60).orderBy("session").collect()
    assert [x.n_beats for x in got] == want
