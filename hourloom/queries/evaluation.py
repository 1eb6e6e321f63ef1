"""Ranks, splits, folds, imputation, scaling, baselines and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.grid import HOUR
from hourloom.operators.ranks import exact_quantiles, sorted_rank
from hourloom.operators.windows import add_features, lag, lead, rolling
from hourloom.plans import evaluation as ev
from hourloom.plans import features as sets
from hourloom.queries import inputs, query
from hourloom.queries.inputs import SERIES, WIDE, hour_ts, lag_sql, roll_sql, steady, steady_sql
from hourloom.settings import HORIZONS

BY = "PARTITION BY parameter"
RANKED = """r AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY h) - 1 AS seq,
  count(*) OVER (PARTITION BY parameter) AS n FROM p)"""
PAIRS = f"""{SERIES}, f AS (SELECT parameter, h, value, {lag_sql('value', 1, 'lag_1', BY)},
  lead(value, 1) OVER ({BY} ORDER BY h) AS y FROM series),
p AS (SELECT * FROM f WHERE y IS NOT NULL), {RANKED}"""


def metric_sql(y: str, pred: str, mape_above: float | None = None) -> list[str]:
    e = f"({y} - {pred})"
    relative = f"abs({e}) / greatest(abs({y}), 2.220446049250313e-16)"
    if mape_above is not None:
        relative = f"CASE WHEN {y} > {mape_above} THEN abs({e} / {y}) END"
    return [
        "count(*) AS n_test",
        f"sqrt(avg({e} * {e})) AS rmse",
        f"avg(abs({e})) AS mae",
        f"1 - avg({e} * {e}) / nullif(var_pop({y}), 0) AS r2",
        f"100 * avg({relative}) AS mape",
    ]


STEADY_METRICS = ", ".join(["n_test"] + [f"{steady_sql(c)} AS {c}" for c in ("rmse", "mae", "r2", "mape")])


def steady_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: steady(c) for c in ("rmse", "mae", "r2", "mape")})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per parameter: value, the value before it and the next hour as y, ranked in time."""
    table = add_features(
        inputs.series(spark, sf_dir), [lag("lag_1", "value", 1), lead("y", "value", 1)], ["parameter"]
    )
    return ev.chronological_rank(table.na.drop(subset=["y"]), ["parameter"], hourly_keys=True)


@query(f"""WITH {SERIES}, p AS (SELECT parameter, h, value, lead(value, 1) OVER ({BY} ORDER BY h) AS y,
  {roll_sql('value', 'mean', 24, 12, 'day_mean', BY)}, {roll_sql('value', 'std', 24, 12, 'day_std', BY)} FROM series),
q AS (SELECT * FROM p WHERE y IS NOT NULL), r AS (SELECT *, row_number() OVER ({BY} ORDER BY h) - 1 AS seq,
  count(*) OVER ({BY}) AS n FROM q),
m AS (SELECT parameter, {', '.join(metric_sql('y', 'value'))}, avg(day_mean) AS day_mean, avg(day_std) AS day_std
  FROM r WHERE seq >= floor(n * 0.8) AND value IS NOT NULL GROUP BY parameter)
SELECT parameter, {STEADY_METRICS}, {steady_sql('day_mean', 5)} AS day_mean, {steady_sql('day_std', 5)} AS day_std FROM m""")
def flagship_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events to a complete hourly grid, rolling day statistics, a time split, a scored baseline."""
    wanted = [
        rolling("day_mean", "value", "mean", 24, 12),
        rolling("day_std", "value", "std", 24, 12),
        lead("y", "value", 1),
    ]
    table = add_features(inputs.series(spark, sf_dir), wanted, ["parameter"])
    table = table.withColumns({c: steady(c) for c in ("day_mean", "day_std")})
    ranked = ev.chronological_rank(table.na.drop(subset=["y"]), ["parameter"], hourly_keys=True)
    levels = [steady(F.avg(c), 5).alias(c) for c in ("day_mean", "day_std")]
    scored = ev.regression_metrics(ranked.where(~ev.is_train()), ["parameter"], pred="value", extra=levels)
    return steady_metrics(scored)


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, count(*) OVER () AS n_rows FROM events""")
def distributed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global rank of the raw events in time."""
    rows = inputs.table(spark, sf_dir, "events").select("event_id", "ts")
    return sorted_rank(rows, ["ts", "event_id"]).select("event_id", "seq", "n_rows")


@query(f"""WITH {WIDE} SELECT h AS ts, row_number() OVER (ORDER BY h) - 1 AS seq, count(*) OVER () AS n_rows FROM wide""")
def calendar_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of one hourly series without keys; only day counts are accumulated in one place."""
    return ev.chronological_rank(inputs.wide(spark, sf_dir)).select(hour_ts(), "seq", "n_rows")


@query(f"""WITH {PAIRS} SELECT parameter, count(CASE WHEN seq < floor(n * 0.8) THEN 1 END) AS n_train,
  count(CASE WHEN seq >= floor(n * 0.8) THEN 1 END) AS n_test, max(CASE WHEN seq < floor(n * 0.8) THEN h END) AS train_end,
  min(CASE WHEN seq >= floor(n * 0.8) THEN h END) AS test_start FROM r GROUP BY parameter""")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = ev.is_train()
    ts = hour_ts()
    return pairs(spark, sf_dir).groupBy("parameter").agg(
        F.count_if(train).alias("n_train"),
        F.count_if(~train).alias("n_test"),
        F.max(F.when(train, ts)).alias("train_end"),
        F.min(F.when(~train, ts)).alias("test_start"),
    )


FOLDS = f"""{PAIRS}, k AS (SELECT r.*, i AS fold, n - (6 - i) * (n // 6) AS start, n // 6 AS block
  FROM r, (SELECT unnest(generate_series(1, 5)) AS i)),
folds AS (SELECT *, CASE WHEN seq < start THEN 'train' ELSE 'validate' END AS role FROM k WHERE seq < start + block)"""


@query(f"""WITH {FOLDS} SELECT parameter, CAST(fold AS INTEGER) AS fold, role, count(*) AS n_rows, min(h) AS first_ts, max(h) AS last_ts
FROM folds GROUP BY ALL""")
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = hour_ts()
    return ev.expanding_folds(pairs(spark, sf_dir)).groupBy("parameter", "fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


@query(f"""WITH {FOLDS}, s AS (SELECT parameter, fold, sqrt(avg((y - value) * (y - value))) AS rmse
  FROM folds WHERE role = 'validate' AND value IS NOT NULL GROUP BY ALL)
SELECT parameter, {steady_sql('avg(rmse)')} AS cv_mean, {steady_sql('stddev_pop(rmse)')} AS cv_std, count(rmse) AS n_folds
FROM s GROUP BY parameter""")
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = ev.expanding_folds(pairs(spark, sf_dir)).where("role = 'validate'")
    scores = ev.regression_metrics(held_out, ["parameter", "fold"], pred="value")
    return ev.fold_summary(scores, ["parameter"]).withColumns({c: steady(c) for c in ("cv_mean", "cv_std")})


COLUMNS = ["pm10", "temp", "wind_spd", "humidity"]
WIDE_RANKED = f"""{WIDE}, p AS (SELECT * FROM wide WHERE pm25 IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS seq, count(*) OVER () AS n FROM p),
med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in COLUMNS)} FROM r WHERE seq < floor(n * 0.8)),
filled AS (SELECT r.h, r.seq, r.n, r.pm25, {', '.join(f'coalesce(r.{c}, med.{c}) AS {c}' for c in COLUMNS)} FROM r, med)"""


def ranked_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.chronological_rank(inputs.wide(spark, sf_dir).na.drop(subset=["pm25"]))


@query(f"WITH {WIDE_RANKED} SELECT h AS ts, pm25, {', '.join(f'{steady_sql(c)} AS {c}' for c in COLUMNS)} FROM filled")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_wide(spark, sf_dir)
    imputer = ev.MedianImputer.fit(ranked.where(ev.is_train()), COLUMNS)
    filled = imputer.transform(ranked)
    return filled.select(hour_ts(), "pm25", *[steady(c).alias(c) for c in imputer.columns])


@query(f"""WITH {WIDE_RANKED}, s AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in COLUMNS)}
  FROM r WHERE seq < floor(n * 0.8))
SELECT r.h AS ts, {', '.join(f'{steady_sql(f"({c} - {c}_m) / {c}_s")} AS {c}' for c in COLUMNS)} FROM r, s""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_wide(spark, sf_dir)
    scaler = ev.Standardiser.fit(ranked.where(ev.is_train()), COLUMNS)
    return scaler.transform(ranked).select(hour_ts(), *[steady(c).alias(c) for c in COLUMNS])


@query(f"""WITH {PAIRS}, m AS (SELECT parameter, {', '.join(metric_sql('y', 'value'))}
  FROM r WHERE seq >= floor(n * 0.8) AND value IS NOT NULL GROUP BY parameter)
SELECT parameter, {STEADY_METRICS} FROM m""")
def persistence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = pairs(spark, sf_dir).where(~ev.is_train())
    return steady_metrics(ev.regression_metrics(test, ["parameter"], pred="value"))


POLLUTANTS = ("pm25", "pm10")


def _targets_sql(parameter: str) -> str:
    targets = ", ".join(f"lead({parameter}, {k}) OVER (ORDER BY h) AS t{k}" for k in HORIZONS)
    return f"SELECT '{parameter}' AS parameter, h, lag({parameter}, 1) OVER (ORDER BY h) AS before, {targets} FROM wide"


LAG1 = f"""{WIDE}, f AS ({' UNION ALL '.join(_targets_sql(p) for p in POLLUTANTS)}),
p AS ({' UNION ALL '.join(f'SELECT parameter, h, before, {k} AS horizon, t{k} AS y FROM f WHERE t{k} IS NOT NULL' for k in HORIZONS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY parameter, horizon ORDER BY h) - 1 AS seq,
             count(*) OVER (PARTITION BY parameter, horizon) AS n FROM p),
med AS (SELECT parameter, horizon, median(before) AS med FROM r WHERE seq < floor(n * 0.8) GROUP BY ALL),
t AS (SELECT r.parameter, r.horizon, y, coalesce(before, med) AS pred FROM r JOIN med USING (parameter, horizon)
      WHERE seq >= floor(n * 0.8))"""


def lag1_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of both pollutants and every horizon with the imputed previous value as prediction."""
    grid, parts = inputs.wide(spark, sf_dir), []
    for parameter in POLLUTANTS:
        wanted = [lag("before", parameter, 1), *sets.horizon_targets(parameter)]
        long = sets.long_targets(add_features(grid, wanted, keep=[HOUR]), HORIZONS, [HOUR, "before"])
        parts.append(long.withColumn("parameter", F.lit(parameter)))
    keys = ["parameter", "horizon"]
    ranked = ev.chronological_rank(reduce(DataFrame.unionByName, parts), keys, hourly_keys=True)
    medians = exact_quantiles(ranked.where(ev.is_train()), ["before"], [0.5], keys)
    test = ranked.where(~ev.is_train()).join(medians.select(*keys, "quantile"), keys)
    return test.withColumn("pred", F.coalesce("before", "quantile"))


@query(f"""WITH {LAG1}, m AS (SELECT parameter, horizon, {', '.join(metric_sql('y', 'pred'))} FROM t GROUP BY ALL)
SELECT parameter, CAST(horizon AS INTEGER) AS horizon, {STEADY_METRICS} FROM m""")
def lag1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steady_metrics(ev.regression_metrics(lag1_predictions(spark, sf_dir), ["parameter", "horizon"]))


@query(f"""WITH {LAG1}, m AS (SELECT parameter, horizon, {', '.join(metric_sql('y', 'pred', 1.0))} FROM t GROUP BY ALL)
SELECT parameter, CAST(horizon AS INTEGER) AS horizon, n_test, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(r2, 3) AS r2,
  round(mape, 1) AS mape FROM m""")
def masked_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ev.regression_metrics(lag1_predictions(spark, sf_dir), ["parameter", "horizon"], mape_above=1.0)
    return ev.rounded(scored)


DM = f"""{PAIRS}, d AS (SELECT parameter, pow(y - value, 2) - pow(y - lag_1, 2) AS d FROM r
  WHERE seq >= floor(n * 0.8) AND value IS NOT NULL AND lag_1 IS NOT NULL),
m AS (SELECT parameter, count(d) AS n, avg(d) AS mean_d, var_samp(d) AS var_d FROM d GROUP BY parameter)"""


def dm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).where(~ev.is_train()).na.drop(subset=["value", "lag_1"])


@query(f"""WITH {DM} SELECT parameter, n, {steady_sql('mean_d', 4)} AS mean_d, {steady_sql('var_d', 3)} AS var_d,
  CASE WHEN var_d / n > 0 THEN {steady_sql('mean_d / sqrt(var_d / n)')} ELSE 0.0 END AS stat FROM m""")
def dm_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ev.dm_test(dm_rows(spark, sf_dir), "value", "lag_1", keys=["parameter"], p_value=False)
    return result.withColumns({"mean_d": steady("mean_d", 4), "var_d": steady("var_d", 3), "stat": steady("stat")})


# With t = sqrt(v) tan(a) the tail of Student's distribution is an integral of cos(a)^(v - 1), here by the midpoint rule.
@query(f"""WITH {DM}, s AS (SELECT *, n - 1 AS v, CASE WHEN var_d / n > 0 THEN mean_d / sqrt(var_d / n) ELSE 0.0 END AS stat FROM m),
a AS (SELECT *, atan(abs(stat) / sqrt(v)) AS a0 FROM s),
i AS (SELECT parameter, n, stat, v, avg(pow(cos(a0 + (pi() / 2 - a0) * (k + 0.5) / 20000), v - 1)) * (pi() / 2 - a0) AS tail
      FROM (SELECT *, unnest(range(20000)) AS k FROM a) GROUP BY parameter, n, stat, v, a0),
t AS (SELECT parameter, n, stat, 2 * tail * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi()) AS p FROM i)
SELECT parameter, n, round(stat, 3) AS stat, round(p, 4) AS p_value, p < 0.05 AS significant FROM t""")
def dm_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ev.dm_test(dm_rows(spark, sf_dir), "value", "lag_1", keys=["parameter"])
    return result.select("parameter", "n", F.round("stat", 3).alias("stat"), F.round("p_value", 4).alias("p_value"), "significant")
