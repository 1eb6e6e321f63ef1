"""Model queries, at the sizes that are the defaults of plans.models."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.grid import HOUR, hourly_long
from hourloom.operators.distribution import correlation_matrix
from hourloom.operators.profile import group_completeness
from hourloom.operators.windows import add_features, lead
from hourloom.plans import features as sets
from hourloom.plans import linear, models, pipelines
from hourloom.plans.evaluation import chronological_rank, is_train, regression_metrics
from hourloom.plans.reports import horizon_comparison as compare_horizons
from hourloom.queries import inputs, query
from hourloom.queries.features import MULTI_SOURCE_SQL, RICH_COLUMNS, rich_wide
from hourloom.queries.inputs import MEAS, WIDE, mean_sql, steady, steady_sql
from hourloom.settings import HORIZONS


# target: companion series and its lags
NEXT_HOUR = {"pm25": ("pm10", (1, 24)), "pm10": ("pm25", (1,))}


def next_hour_table(spark: SparkSession, sf_dir: str, target: str) -> tuple[DataFrame, list[str]]:
    wanted = sets.next_hour_features(target, *NEXT_HOUR[target])
    table = add_features(inputs.wide(spark, sf_dir), [*wanted, lead("y", target, 1)], keep=[HOUR, target])
    # the current value is known whenever its change is, so complete cases imply it
    return table, [f.name for f in wanted]


def next_hour_run(
    spark: SparkSession, sf_dir: str, regressors: list, n_splits: int = 0, target: str = "pm25"
) -> models.NextHourRun:
    table, columns = next_hour_table(spark, sf_dir, target)
    return models.next_hour_experiment(table, columns, target, regressors, n_splits=n_splits)


def each_pollutant(table_of: Callable[[str], DataFrame], pollutants: Iterable[str] = NEXT_HOUR) -> DataFrame:
    """The tables of all pollutants, told apart by a column."""
    tables = [table_of(t).select(F.lit(t).alias("pollutant"), "*") for t in pollutants]
    return reduce(DataFrame.unionByName, tables)


def released(run: models.NextHourRun) -> models.NextHourRun:
    """The run without its cached rows, which its results and predictions do not read."""
    run.release()
    return run


def next_hour_results_of(spark: SparkSession, sf_dir: str, regressors: list, target: str) -> DataFrame:
    return released(next_hour_run(spark, sf_dir, regressors, target=target)).results


def next_hour_results(spark: SparkSession, sf_dir: str, regressors: list, n_splits: int = 0) -> DataFrame:
    return each_pollutant(lambda t: released(next_hour_run(spark, sf_dir, regressors, n_splits, t)).results)


@query()
def fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_hour_results(spark, sf_dir, [models.ols(), models.ridge(), models.lasso()], n_splits=5)


@query()
def fit_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_hour_results(spark, sf_dir, [models.forest()], n_splits=5)


@query()
def fit_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_hour_results(spark, sf_dir, [models.boosting()], n_splits=5)


# With one standardised feature all three linear models have closed forms in plain aggregates.
ONE_FEATURE = f"""{WIDE}, f AS (SELECT h, pm25 AS x, lead(pm25, 1) OVER (ORDER BY h) AS y FROM wide),
p AS (SELECT * FROM f WHERE y IS NOT NULL AND x IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS seq, count(*) OVER () AS n FROM p),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n_train FROM r WHERE seq < floor(n * 0.8)),
c AS (SELECT sum((x - mx) / sx * (y - my)) AS zy FROM r, s WHERE seq < floor(n * 0.8)),
w AS (SELECT 'Linear Regression' AS model, zy / n_train AS w FROM c, s
  UNION ALL SELECT 'Ridge Regression', zy / (n_train + 1.0) FROM c, s
  UNION ALL SELECT 'Lasso Regression', sign(zy) * greatest(abs(zy / n_train) - 0.1, 0) FROM c, s),
e AS (SELECT model, r.y - (my + w * (x - mx) / sx) AS e FROM r, s, w WHERE seq >= floor(n * 0.8))"""


@query(f"WITH {ONE_FEATURE} SELECT model, count(*) AS n_test, {steady_sql('sqrt(avg(e * e))', 4)} AS rmse FROM e GROUP BY model")
def linear_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalty mapping of the linear models, checked where a closed form exists."""
    table = add_features(inputs.wide(spark, sf_dir), [lead("y", "pm25", 1)], keep=[HOUR, "pm25"])
    ranked = chronological_rank(table.na.drop(subset=["y", "pm25"])).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = ranked.where(is_train()), ranked.where(~is_train())
    fitted = [models.fit(m, train, ["pm25"]) for m in (models.ols(), models.ridge(), models.lasso())]
    scored = models.score_long(models.predict_all(fitted, test), {m.name: m.pred for m in fitted})
    scores = models.small_table(regression_metrics(scored, ["model"]))
    ranked.unpersist()
    return scores.select("model", "n_test", steady("rmse", 4).alias("rmse"))


# Many series: pooled linear models of one feature, with split and folds by series, have closed forms as well.
SERIES_KEYS = ["parameter", "site"]
SITE_SERIES = f"""{MEAS}, per_ts AS (SELECT parameter, location % 3 AS site, ts, {mean_sql('value', 2)} AS v FROM meas GROUP BY ALL),
hourly AS (SELECT parameter, site, date_trunc('hour', ts) AS h, {mean_sql('v', 6)} AS x FROM per_ts GROUP BY ALL),
hours AS (SELECT parameter, site, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hourly GROUP BY parameter, site),
f AS (SELECT parameter, site, h, x, lead(x, 1) OVER (PARTITION BY parameter, site ORDER BY h) AS y
  FROM hours LEFT JOIN hourly USING (parameter, site, h)),
r AS (SELECT *, row_number() OVER (PARTITION BY parameter, site ORDER BY h) - 1 AS seq,
  count(*) OVER (PARTITION BY parameter, site) AS n FROM f WHERE y IS NOT NULL),
train AS (SELECT parameter, site, x, y, row_number() OVER (PARTITION BY parameter, site ORDER BY h) - 1 AS seq,
  count(*) OVER (PARTITION BY parameter, site) AS n FROM r WHERE x IS NOT NULL AND seq < floor(n * 0.8)),
test AS (SELECT * FROM r WHERE x IS NOT NULL AND seq >= floor(n * 0.8))"""


def _closed_forms(train: str, by: str = "") -> str:
    """Common table expressions s (moments) and w (weights) of the three linear models on a table with x and y."""
    group, using = (f"GROUP BY {by}", f"USING ({by})") if by else ("", "ON true")
    lead_in = f"{by}, " if by else ""
    weights = [
        ("Linear Regression", "zy / k"),
        ("Ridge Regression", "zy / (k + 1.0)"),
        ("Lasso Regression", "sign(zy) * greatest(abs(zy / k) - 0.1, 0)"),
    ]
    models_sql = " UNION ALL ".join(f"SELECT {lead_in}mx, sx, my, '{name}' AS model, {w} AS w FROM c" for name, w in weights)
    return f"""s AS (SELECT {lead_in}avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS k FROM {train} {group}),
c AS (SELECT {lead_in}mx, sx, my, k, sum((x - mx) / sx * (y - my)) AS zy FROM {train} JOIN s {using} GROUP BY ALL),
w AS ({models_sql})"""


def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measurements(spark, sf_dir).withColumn("site", F.col("location") % 3)
    return add_features(hourly_long(rows, SERIES_KEYS, **inputs.SCALES), [lead("y", "value", 1)], SERIES_KEYS)


def site_run(spark: SparkSession, sf_dir: str, n_splits: int) -> models.NextHourRun:
    regressors = [models.ols(), models.ridge(), models.lasso()]
    return models.next_hour_experiment(site_table(spark, sf_dir), ["value"], "value", regressors, n_splits, keys=SERIES_KEYS)


@query(f"""WITH {SITE_SERIES}, {_closed_forms('train')},
e AS (SELECT parameter, site, model, y - (my + w * (x - mx) / sx) AS e FROM test, w
  UNION ALL SELECT parameter, site, 'Naive Baseline', y - x FROM test)
SELECT parameter, site, model, count(*) AS n_test, {steady_sql('sqrt(avg(e * e))', 4)} AS rmse FROM e GROUP BY ALL""")
def series_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled models over many series, split in time series by series and scored per series."""
    run = released(site_run(spark, sf_dir, n_splits=0))
    return run.series_results.select(*SERIES_KEYS, "model", "n_test", steady("rmse", 4).alias("rmse"))


@query(f"""WITH {SITE_SERIES}, d AS (SELECT i AS fold, x, y, seq, n - (6 - i) * (n // 6) AS beg, n // 6 AS block
  FROM train, (SELECT unnest(generate_series(1, 5)) AS i)),
known AS (SELECT fold, x, y FROM d WHERE seq < beg), held AS (SELECT fold, x, y FROM d WHERE seq >= beg AND seq < beg + block),
{_closed_forms('known', 'fold')},
v AS (SELECT model, fold, sqrt(avg((y - (my + w * (x - mx) / sx)) ** 2)) AS rmse FROM held JOIN w USING (fold) GROUP BY ALL)
SELECT model, {steady_sql('avg(rmse)', 4)} AS cv_rmse_mean, {steady_sql('stddev_pop(rmse)', 4)} AS cv_rmse_std FROM v GROUP BY model""")
def series_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five expanding folds within each of many series, one pooled model per fold."""
    scores = released(site_run(spark, sf_dir, n_splits=5)).results.where(F.col("model") != "Naive Baseline")
    return scores.select("model", *[steady(c, 4).alias(c) for c in ("cv_rmse_mean", "cv_rmse_std")])


@query()
def importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tops(target: str) -> DataFrame:
        run = released(next_hour_run(spark, sf_dir, [models.forest(), models.boosting()], target=target))
        return reduce(DataFrame.unionByName, [models.top_features(m.importances(spark), 10) for m in run.fitted])

    return each_pollutant(tops)


@query()
def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five models with expanding-window cross-validation and the persistence row."""
    return next_hour_results(spark, sf_dir, models.next_hour_models(), n_splits=5)


@query()
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest test error of all five models."""
    regressors = models.next_hour_models()
    return each_pollutant(lambda t: models.best_model(next_hour_results_of(spark, sf_dir, regressors, t)))


def multi_source_table(spark: SparkSession, sf_dir: str, target: str) -> tuple[DataFrame, list]:
    return pipelines.build_features(rich_wide(spark, sf_dir), target, zone=None)


@query()
def horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    regressors = models.horizon_models()
    tables = {t: multi_source_table(spark, sf_dir, t) for t in ("pm25", "pm10")}
    return pipelines.score_horizons(tables, HORIZONS, regressors)[0]


@query()
def horizon_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting against forest at every horizon of both pollutants."""
    regressors = models.horizon_models()
    tables = {t: multi_source_table(spark, sf_dir, t) for t in ("pm25", "pm10")}
    return pipelines.score_horizons(tables, HORIZONS, regressors)[1]


@query()
def horizon_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: multi_source_table(spark, sf_dir, t) for t in ("pm25", "pm10")}
    return compare_horizons(pipelines.score_horizons(tables, HORIZONS, [models.boosting(subsample=0.8)])[0])


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scores(target: str) -> DataFrame:
        table, wanted = multi_source_table(spark, sf_dir, target)
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
        scored = models.ablation(table, sets.ablation_sets(wanted), "target_1h", models.boosting())
        table.unpersist()
        return scored

    return each_pollutant(scores)


def _groups_sql(target: str) -> str:
    wanted = sets.multi_source_features(target, RICH_COLUMNS)
    cells = " UNION ALL ".join(
        f"SELECT '{f.group}' AS feature_group, 100.0 * CAST(count({f.name}) AS DOUBLE) / count(*) AS p FROM t" for f in wanted
    )
    return f"""SELECT '{target}' AS pollutant, feature_group, count(*) AS n_features, {steady_sql('avg(p)')} AS mean_pct_present
FROM (WITH t AS ({MULTI_SOURCE_SQL[target]}) {cells}) GROUP BY feature_group"""


@query(f"{_groups_sql('pm25')} UNION ALL {_groups_sql('pm10')}")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns per feature group of each pollutant and how complete they are."""
    grid = rich_wide(spark, sf_dir)

    def groups(target: str) -> DataFrame:
        wanted = sets.multi_source_features(target, grid.columns)
        table = sets.feature_table(grid, [*wanted, *sets.horizon_targets(target, [1])], required=["target_1h"])
        present = group_completeness(table, sets.by_group(wanted))
        return present.withColumn("mean_pct_present", steady("mean_pct_present"))

    return each_pollutant(groups)


def _slope_sql() -> str:
    """One least-squares line per series on its training hours; few or equal readings give a flat one."""
    return f"""WITH {SITE_SERIES},
m AS (SELECT parameter, site, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx FROM train GROUP BY ALL),
lines AS (SELECT parameter, site, n, my, mx, CASE WHEN vx > 0 THEN cxy / vx ELSE 0 END AS slope FROM m),
e AS (SELECT parameter, site, count(*) AS n_test, sqrt(avg((t.y - (g.my + g.slope * (t.x - g.mx))) ** 2)) AS rmse
  FROM test t JOIN lines g USING (parameter, site) GROUP BY ALL)
SELECT parameter, site, n, {steady_sql('slope')} AS slope, {steady_sql('my - slope * mx', 4)} AS intercept, n_test,
  {steady_sql('rmse', 4)} AS rmse FROM lines JOIN e USING (parameter, site)"""


@query(_slope_sql())
def series_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of its own for every series: one grouped aggregation, all systems solved by batches of series."""
    rows = site_table(spark, sf_dir).select(*SERIES_KEYS, HOUR, "value", "y").na.drop(subset=["y"])
    ranked = chronological_rank(rows, SERIES_KEYS, hourly_keys=True).na.drop(subset=["value"])
    fitted = linear.fit_series(ranked.where(is_train()), ["value"], "y", SERIES_KEYS)
    scored = linear.predict_series(ranked.where(~is_train()), fitted, ["value"], SERIES_KEYS)
    scores = regression_metrics(scored, SERIES_KEYS).select(*SERIES_KEYS, "n_test", steady("rmse", 4).alias("rmse"))
    lines = fitted.select(
        *SERIES_KEYS, "n", steady(F.col("weights")[0]).alias("slope"), steady("intercept", 4).alias("intercept")
    )
    return lines.join(scores, SERIES_KEYS)


CORRELATED = ["pm25_lag_1", "pm25_lag_24", "pm25_diff_1", "temp_lag_1", "hour_sin", "target_1h"]


def _feature_correlation_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {steady_sql(f'corr({a}, {b})')} AS r FROM t" for a in CORRELATED for b in CORRELATED
    )
    return f"WITH t AS ({MULTI_SOURCE_SQL['pm25']}) {pairs}"


@query(_feature_correlation_sql())
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all multi-source features with each other in one pass; the check reads some of them."""
    table, wanted = multi_source_table(spark, sf_dir, "pm25")
    matrix = correlation_matrix(table, [*(f.name for f in wanted), "target_1h"])
    told = matrix.where(F.col("x").isin(CORRELATED) & F.col("y").isin(CORRELATED))
    return told.select("x", "y", steady("r").alias("r"))
