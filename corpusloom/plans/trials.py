"""Queries on trial logs and search spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import search as S
from corpusloom.operators import trials as T
from corpusloom.plans.sql import key, u100, unit, with_ctes
from corpusloom.session import write_through
from corpusloom.sources import derived as D

# A search space as the configs write it.
CONFIG = {
    "head_learning_rate_min": 1e-4,
    "head_learning_rate_max": 1e-1,
    "head_learning_rate_log": True,
    "l2_weight_min": 1e-4,
    "l2_weight_max": 1e-3,
    "batch_size_min": 4,
    "batch_size_max": 16,
    "num_epochs": "1,5,10,25,50",
}


def _grid(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    trials = events.select(F.col("user_id").alias("trial")).distinct()
    return T.param_grid(trials, T.space_from_config(CONFIG))


def param_grid(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return grid.select("trial", *[F.round(c, 9).alias(c) for c in grid.columns if c != "trial"])


def best_trial(spark, sf_dir):
    results = T.trial_results(D.trial_log(spark, sf_dir))
    params = _grid(spark, sf_dir).select("trial", "head_learning_rate", "num_epochs")
    best = T.best_trial(results, "maximize", params, T.missing_params(["num_epochs", "batch_size"]))
    return best.withColumn("head_learning_rate", F.round("head_learning_rate", 9))


def trial_budget(spark, sf_dir):
    return T.trial_budget(T.trial_results(D.trial_log(spark, sf_dir)))


def prune_flags(spark, sf_dir):
    flags = T.prune_flags(write_through(D.trial_log(spark, sf_dir), "trials"))
    return flags.select("trial", "step", "best_value", F.round("median", 6).alias("median"), "prune")


def epoch_loss(spark, sf_dir):
    return T.epoch_loss(D.trial_log(spark, sf_dir)).withColumn("epoch_loss", F.round("epoch_loss", 6))


def best_checkpoint(spark, sf_dir):
    best = T.best_checkpoint(write_through(D.trial_log(spark, sf_dir), "trials"), direction="minimize")
    return best.select("trial", "step", "best_value", "best_step", "is_best")


def retain_latest(spark, sf_dir):
    return T.retain_latest(D.trial_log(spark, sf_dir), 5).select("trial", "step", "value")


def tpe_suggest(spark, sf_dir):
    space = T.space_from_config(CONFIG)
    studies = write_through(D.studies(spark, sf_dir), "studies")
    drawn = T.param_grid(studies, space).join(studies, "trial")
    proposed = S.tpe_suggest(write_through(drawn, "study-trials"), space)
    return proposed.withColumns({"value": F.round("value", 9), "log_ratio": F.round("log_ratio", 6)})


def stale_trials(spark, sf_dir):
    """Users as trials, their events as heartbeats; two days of silence end a trial."""
    beats = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("trial"), F.col("ts").alias("at"))
    states = T.trial_results(D.trial_log(spark, sf_dir)).select("trial", "state")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    found = T.stale_trials(beats, states, now, 48 * 3600)
    return found.drop("first_beat", "last_beat")


QUERIES = {
    f.__name__: f
    for f in (stale_trials, param_grid, best_trial, trial_budget, prune_flags, epoch_loss, best_checkpoint, retain_latest, tpe_suggest)
}


def _u(name: str) -> str:
    return unit(key(f"{name}42", "trial"))


_GRID = f"""select trial,
  exp(ln(cast(1e-4 as double)) + {_u('head_learning_rate')} * (ln(cast(1e-1 as double)) - ln(cast(1e-4 as double)))) as head_learning_rate,
  cast(1e-4 as double) + {_u('l2_weight')} * (cast(1e-3 as double) - cast(1e-4 as double)) as l2_weight,
  cast(4 as double) + floor({_u('batch_size')} * 13) as batch_size,
  cast(string_split('1,5,10,25,50', ',')[cast(floor({_u('num_epochs')} * 5) as int) + 1] as double) as num_epochs
from (select distinct user_id as trial from events)"""

_NUMERIC = {
    "head_learning_rate": "(ln(head_learning_rate) - ln(cast(1e-4 as double))) / (ln(cast(1e-1 as double)) - ln(cast(1e-4 as double)))",
    "l2_weight": "(l2_weight - cast(1e-4 as double)) / (cast(1e-3 as double) - cast(1e-4 as double))",
    "batch_size": "(batch_size - 4 + 0.5) / 13",
}
_CHOICES = "[1.0, 5.0, 10.0, 25.0, 50.0]"


def _kernels(side: str) -> str:
    """Density of one side at z: logistic kernels at the bins of ``cells``, cut off at 0 and 1."""
    scale = f"scale_{side}"
    t = f"exp(-abs((z - c.centre) / {scale}))"
    mass = f"(1 / (1 + exp(-(1 - c.centre) / {scale})) - 1 / (1 + exp(c.centre / {scale})))"
    kernels = f"list_sum(list_transform(cells, lambda c: c.{side} * {t} / ({scale} * (1 + {t}) * (1 + {t}) * {mass})))"
    return f"(1 + {kernels}) / (n_{side} + 1)"


def _shares(side: str) -> str:
    return f"(1 + list_sum(list_transform(cells, lambda c: case when c.bin = z then c.{side} else 0 end))) / cast(n_{side} + 5 as double)"


def _scale(side: str) -> str:
    return (
        f"greatest(1.0 / least(100, sum({side}) + 1), coalesce(sqrt(greatest(0, sum({side} * centre * centre) / nullif(sum({side}), 0)"
        f" - pow(sum({side} * centre) / nullif(sum({side}), 0), 2))) * pow(nullif(sum({side}), 0), -0.2), 0)) * {S.LOGISTIC!r}"
    )


_UNDER = "1 / (1 + exp(centre / scale_good))"
_TPE_STEPS = {
    "studies": f"""select user_id as study, event_id as trial, value,
        case when {u100('state', 'event_id')} < 10 then 'RUNNING' when {u100('state', 'event_id')} < 20 then 'PRUNED'
             when {u100('state', 'event_id')} < 30 then 'FAIL' else 'COMPLETE' end as state from events""",
    "drawn": _GRID.replace("select trial,", "select study, trial, value, state,", 1).replace(
        "(select distinct user_id as trial from events)", "studies"),
    "complete": "select *, row_number() over (partition by study order by value desc, trial) as place,"
                " count(*) over (partition by study) as n from drawn where state = 'COMPLETE'",
    "ranked": "select *, place <= least(25, ceil(n * cast(0.1 as double))) as is_good from complete",
    "long": " union all ".join(
        [f"select study, is_good, n, '{p}' as param, least(63, floor(greatest(0.0, least(1.0, {z})) * 64)) as bin, 64 as bins from ranked"
         for p, z in _NUMERIC.items()]
        + [f"select study, is_good, n, 'num_epochs' as param, list_position({_CHOICES}, num_epochs) - 1 as bin, 5 as bins from ranked"]
    ),
    "binned": "select study, param, bin, (bin + 0.5) / any_value(bins) as centre, count(*) filter (is_good) as good,"
              " count(*) filter (not is_good) as bad from long where n >= 10 group by study, param, bin",
    "known": f"""select study, param, list({{'bin': bin, 'centre': centre, 'good': good, 'bad': bad}} order by bin) as cells,
        sum(good) as n_good, sum(bad) as n_bad, {_scale('good')} as scale_good, {_scale('bad')} as scale_bad,
        flatten(list(list_transform(range(good), lambda i: centre) order by bin)) as centres,
        flatten(list(list_transform(range(good), lambda i: bin) order by bin)) as picks
        from binned group by study, param""",
    "draws": f"select *, {unit(key('part42', 'study', 'param', 'draw'))} as u1, {unit(key('place42', 'study', 'param', 'draw'))} as u2"
             " from known, (select unnest(range(24)) as draw)",
    "placed": "select *, centres[cast(floor(u1 * (n_good + 1)) as bigint) + 1] as centre,"
              " list_concat(picks, [0, 1, 2, 3, 4])[cast(floor(u1 * (n_good + 5)) as bigint) + 1] as pick from draws",
    "leveled": f"select *, {_UNDER} + u2 * (1 / (1 + exp(-(1 - centre) / scale_good)) - {_UNDER}) as p from placed",
    "sited": "select *, case when param = 'num_epochs' then pick when centre is null then u2"
          " else greatest(0.0, least(1.0, centre + scale_good * ln(p / (1 - p)))) end as z from leveled",
    "rated": f"select *, case when param = 'num_epochs' then ln({_shares('good')}) - ln({_shares('bad')})"
             f" else ln({_kernels('good')}) - ln({_kernels('bad')}) end as log_ratio from sited",
    "chosen": "select * from rated qualify row_number() over (partition by study, param order by round(log_ratio, 9) desc, draw) = 1",
    "asked": "select study, param, md5(concat('start42:', cast(study as varchar), ':', param)) as h"
             " from (select distinct study from studies),"
             " (select unnest(['head_learning_rate', 'l2_weight', 'batch_size', 'num_epochs']) as param)",
    "seated": f"select a.study, a.param, coalesce(z, {unit('a.h')}) as u, z, log_ratio, n_good, n_bad"
              " from asked a left join chosen c on a.study = c.study and a.param = c.param",
}

ORACLES = {
    "stale_trials": with_ctes(
        "results",
        "select s.trial, cast(session as bigint) as session, n_beats, case when not is_last then 'FAIL'"
        " when state = 'RUNNING' and silent then 'FAIL' else state end as state, cast(session as bigint) as attempt,"
        " case when session > 0 then cast(session - 1 as bigint) end as retried_from,"
        " is_last and state = 'RUNNING' and silent and session < 3 as will_retry"
        " from (select *, session = max(session) over (partition by trial) as is_last,"
        "  epoch(timestamp '2024-01-31 00:00:00') - epoch(last_beat) > 172800 as silent from sessions) s"
        " join results r on s.trial = r.trial",
        gaps="select user_id as trial, ts, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts) > 172800"
             " then 1 else 0 end as fresh from events",
        numbered="select *, sum(fresh) over (partition by trial order by ts) as session from gaps",
        sessions="select trial, session, max(ts) as last_beat, count(*) as n_beats from numbered group by trial, session",
    ),
    "tpe_suggest": with_ctes(
        "",
        "select study, param, round(case param when 'head_learning_rate' then"
        " exp(ln(cast(1e-4 as double)) + u * (ln(cast(1e-1 as double)) - ln(cast(1e-4 as double))))"
        " when 'l2_weight' then cast(1e-4 as double) + u * (cast(1e-3 as double) - cast(1e-4 as double))"
        " when 'batch_size' then 4 + floor(least(u, 1 - pow(2, -53)) * 13)"
        f" else {_CHOICES}[cast(coalesce(z, floor(u * 5)) as bigint) + 1] end, 9) as value,"
        " round(log_ratio, 6) as log_ratio, cast(coalesce(n_good, 0) as bigint) as n_good, cast(coalesce(n_bad, 0) as bigint) as n_bad"
        " from seated",
        **_TPE_STEPS,
    ),
    "param_grid": with_ctes(
        "", "select trial, round(head_learning_rate, 9) as head_learning_rate, round(l2_weight, 9) as l2_weight,"
            " batch_size, num_epochs from grid", grid=_GRID,
    ),
    "best_trial": with_ctes(
        "results",
        "select r.trial, r.value, round(g.head_learning_rate, 9) as head_learning_rate, g.num_epochs,"
        " cast(128 as double) as batch_size from results r join grid g on g.trial = r.trial"
        " where r.state = 'COMPLETE' order by r.value desc, r.trial limit 1", grid=_GRID,
    ),
    "trial_budget": with_ctes(
        "results",
        "select count(*) filter (state = 'COMPLETE') as n_complete, count(*) filter (state = 'RUNNING') as n_running,"
        " count(*) filter (state = 'PRUNED') as n_pruned, count(*) filter (state = 'FAIL') as n_fail,"
        " count(*) filter (state <> 'FAIL') as n_used, count(*) filter (state <> 'FAIL') > 100 as stop from results",
    ),
    "prune_flags": with_ctes(
        "trial_log",
        "select b.trial, b.step, b.best_value, round(m.median, 6) as median, coalesce(b.best_value < m.median"
        " and (select count(distinct trial) from trial_log where state = 'COMPLETE') >= 5, false) as prune"
        " from (select trial, step, max(value) over (partition by trial order by step) as best_value from trial_log) b"
        " left join (select step, median(value) as median from trial_log where state = 'COMPLETE' group by step) m"
        " on m.step = b.step",
    ),
    "epoch_loss": with_ctes(
        "trial_log",
        "select trial, step // 10 as epoch, round(avg(value), 6) as epoch_loss, count(*) as n_steps"
        " from trial_log group by all",
    ),
    "best_checkpoint": with_ctes(
        "trial_log",
        "select trial, step, best_value, best_step, best_step = step as is_best from ("
        "select trial, step, min(value) over w as best_value, arg_min(step, value) over w as best_step"
        " from trial_log window w as (partition by trial order by step))",
    ),
    "retain_latest": with_ctes(
        "trial_log",
        "select trial, step, value from trial_log qualify row_number() over (partition by trial order by step desc) <= 5",
    ),
}
