import numpy as np
import pandas as pd
import pytest
from frames import ar_daily
from pyspark.sql import functions as F

from hourloom.operators.windows import add_features, lag, lead
from hourloom.plans import evaluation as ev
from hourloom.plans import features as sets
from hourloom.plans import models, reports


def timeline(spark, n):
    return spark.range(n).select((F.col("id") + 473_000).alias("hour_index"), F.col("id").cast("double").alias("y"))


@pytest.mark.parametrize("n", [7, 10, 101, 1000])
def test_split_and_fold_sizes(spark, n):
    ranked = ev.chronological_rank(timeline(spark, n))
    assert ranked.where(ev.is_train()).count() == int(n * 0.8)
    train = ranked.where(ev.is_train())
    test = ranked.where(~ev.is_train())
    assert train.agg(F.max("hour_index")).first()[0] < test.agg(F.min("hour_index")).first()[0]
    block = n // 6
    sizes = ev.expanding_folds(ranked).groupBy("fold", "role").count().collect()
    got = {(r.fold, r.role): r["count"] for r in sizes}
    want = {}
    for fold, (start, end) in enumerate(ev.fold_bounds(n), 1):
        want[(fold, "train")], want[(fold, "validate")] = start, end - start
        assert end - start == block
    assert got == want and ev.fold_bounds(n)[-1][1] == n


def test_hourly_keys_rank_equals_bucketed_rank(spark):
    df = timeline(spark, 500).withColumn("k", F.col("hour_index") % 3)
    a = ev.chronological_rank(df, ["k"]).select("hour_index", "seq", "n_rows")
    b = ev.chronological_rank(df, ["k"], hourly_keys=True).select("hour_index", "seq", "n_rows")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_median_imputer(spark):
    rows = [(1.0, None, 5.0), (2.0, None, None), (10.0, None, 7.0), (100.0, None, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    imputer = ev.MedianImputer.fit(df, ["a", "b", "c"])
    assert imputer.medians == {"a": 6.0, "c": 6.0} and imputer.dropped == ("b",)
    assert [tuple(r) for r in imputer.transform(df).collect()] == [(1.0, 5.0), (2.0, 6.0), (10.0, 7.0), (100.0, 6.0)]


def test_standardiser(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = ev.Standardiser.fit(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_metrics(spark):
    y, p = np.array([0.0, 1.0, 2.0, 4.0]), np.array([0.5, 1.0, 1.0, 5.0])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "pred": p}))
    m = ev.regression_metrics(df).first()
    e = y - p
    assert m.rmse == pytest.approx(np.sqrt((e**2).mean())) and m.mae == pytest.approx(np.abs(e).mean())
    assert m.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert m.mape == pytest.approx(100 * np.mean(np.abs(e) / np.maximum(np.abs(y), np.finfo(float).eps)))
    masked = ev.regression_metrics(df, mape_above=1.0).first()
    assert masked.mape == pytest.approx(100 * np.mean(np.abs(e[y > 1] / y[y > 1])))
    constant = ev.regression_metrics(spark.createDataFrame([(1.0, 2.0)], "y double, pred double")).first()
    assert constant.r2 is None


def test_dm(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=200)
    pdf = pd.DataFrame({"y": y, "a": y + rng.normal(size=200), "b": y + 0.5 * rng.normal(size=200)})
    df = spark.createDataFrame(pdf)
    d = (pdf.y - pdf.a) ** 2 - (pdf.y - pdf.b) ** 2
    row = ev.dm_test(df, "a", "b").first()
    assert row.stat == pytest.approx(d.mean() / np.sqrt(d.var(ddof=1) / 200))
    assert row.stat > 0 and row.significant and row.p_value < 0.05
    same = ev.dm_test(df, "a", "a").first()
    assert (same.stat, same.p_value, same.significant) == (0.0, 1.0, False)


def one_hour(spark):
    grid = ar_daily(spark)
    wanted = sets.next_hour_features("pm25", "pm10")
    table = add_features(grid, [*wanted, lead("y", "pm25", 1)], keep=["hour_index", "pm25"])
    return table, [f.name for f in wanted]


def test_next_hour_models_beat_persistence(spark):
    table, columns = one_hour(spark)
    run = models.next_hour_experiment(
        table, columns, "pm25", models.next_hour_models(trees=5, rounds=5, maxDepth=5), n_splits=2
    )
    rows = {r.model: r for r in run.results.collect()}
    assert set(rows) == {
        "Naive Baseline", "Linear Regression", "Ridge Regression", "Lasso Regression", "Random Forest", "Gradient Boosting",
    }
    baseline = rows["Naive Baseline"]
    assert baseline.train_rmse is None and baseline.cv_rmse_mean is None
    for name in ("Linear Regression", "Ridge Regression", "Lasso Regression", "Random Forest"):
        assert rows[name].test_rmse < baseline.test_rmse, name
        assert rows[name].cv_rmse_mean > 0
    best = models.best_model(run.results).first().model
    assert best == min((m for m in rows if m != "Naive Baseline"), key=lambda m: rows[m].test_rmse)

    forest = next(m for m in run.fitted if m.name == "Random Forest")
    top = models.top_features(forest.importances(spark), 10).collect()
    assert len(top) == 10 and top[0].importance >= top[-1].importance
    assert next(m for m in run.fitted if m.name == "Ridge Regression").importances(spark).count() == 0

    residuals = reports.residuals(run.predictions, forest.pred)
    assert residuals.count() == run.test.count() == reports.residual_qq(residuals).count()
    assert reports.residual_histogram(residuals).agg(F.sum("count")).first()[0] == run.test.count()
    axis = reports.predicted_vs_actual(residuals).first()
    ends = residuals.agg(F.least(F.min("actual"), F.min("predicted")), F.greatest(F.max("actual"), F.max("predicted"))).first()
    assert (axis.axis_low, axis.axis_high) == tuple(ends)
    run.release()


def two_series(spark):
    """Series of unequal length that share hours, with next-hour and lag columns."""
    grid = ar_daily(spark, 600).withColumn("series", F.lit("a"))
    grid = grid.unionByName(ar_daily(spark, 240, seed=5).withColumn("series", F.lit("b")))
    return add_features(grid, [lag("pm25_lag_1", "pm25", 1), lead("target_1h", "pm25", 1)], ["series"])


def test_series_keep_their_own_split_and_scores(spark):
    table = two_series(spark).withColumn("y", F.col("target_1h"))
    run = models.next_hour_experiment(table, ["pm25"], "pm25", [models.ols()], n_splits=3, keys=["series"])
    for series, n in (("a", 600), ("b", 240)):
        train, test = (x.where(F.col("series") == series) for x in (run.train, run.test))
        paired = table.where((F.col("series") == series) & F.col("y").isNotNull()).count()
        assert train.count() <= int(paired * 0.8) < n and test.count() <= paired - int(paired * 0.8)
        assert train.agg(F.max("hour_index")).first()[0] < test.agg(F.min("hour_index")).first()[0]
        assert train.agg(F.max("seq")).first()[0] == train.count() - 1
    pooled = {r.model: r.test_rmse for r in run.results.collect()}
    parts = run.series_results.collect()
    assert {(r.series, r.model) for r in parts} == {(s, m) for s in "ab" for m in pooled}
    for model, rmse in pooled.items():
        held = [(r.n_test, r.rmse) for r in parts if r.model == model]
        assert sum(n * x * x for n, x in held) / sum(n for n, _ in held) == pytest.approx(rmse**2)
    assert len(run.cv_scores["Linear Regression"]) == 3
    run.release()


def test_one_key_gives_the_run_without_keys(spark):
    table = two_series(spark).where("series = 'a'").withColumn("y", F.col("target_1h"))
    rows = []
    for keys in ([], ["series"]):
        run = models.next_hour_experiment(table, ["pm25"], "pm25", [models.ols(), models.ridge()], n_splits=3, keys=keys)
        rows.append({r.model: (r.test_rmse, r.train_rmse, r.cv_rmse_mean, r.cv_rmse_std) for r in run.results.collect()})
        run.release()
    assert rows[0].keys() == rows[1].keys()
    for model, values in rows[0].items():
        assert values == pytest.approx(rows[1][model]), model


def test_horizon_and_ablation_over_series(spark):
    table = two_series(spark)
    ridge = models.ridge(scaled=False, name="Ridge")
    columns = ["pm25", "pm25_lag_1"]
    run = models.horizon_experiment(table, columns, "target_1h", "pm25_lag_1", [ridge], keys=["series"])
    pooled = {r.model: r.n_test for r in run.metrics.collect()}
    parts = run.series_metrics.groupBy("model").agg(F.sum("n_test").alias("n"), F.count("*").alias("series")).collect()
    assert {r.model: (r.n, r.series) for r in parts} == {m: (n, 2) for m, n in pooled.items()}
    sizes = table.where("target_1h is not null").groupBy("series").count().collect()
    assert pooled["Ridge"] == sum(r["count"] - int(r["count"] * 0.8) for r in sizes)
    steps = models.ablation(table, [("now", ["pm25"]), ("with lag", columns)], "target_1h", ridge, keys=["series"])
    assert [r.n_features for r in steps.orderBy("step").collect()] == [1, 2]


def test_linear_models_match_closed_forms(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [2.0, -0.3, 4.0] + rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    df = spark.createDataFrame(pdf)
    z = (x - x.mean(0)) / x.std(0)
    yc = y - y.mean()
    for alpha in (1.0, 300.0):
        want = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ yc)
        got = models.fit(models.ridge(alpha), df, ["a", "b", "c"]).model
        assert list(got.coefficients) == pytest.approx(list(want), abs=1e-8)
    raw = x - x.mean(0)
    want = np.linalg.solve(raw.T @ raw + 50.0 * np.eye(3), raw.T @ yc)
    got = models.fit(models.ridge(50.0, scaled=False), df, ["a", "b", "c"]).model
    assert list(got.coefficients) == pytest.approx(list(want), abs=1e-8)
    w = np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rest = yc - z @ w + z[:, j] * w[j]
            c = z[:, j] @ rest / 400
            w[j] = np.sign(c) * max(abs(c) - 0.5, 0)
    got = models.fit(models.lasso(0.5), df, ["a", "b", "c"]).model
    assert list(got.coefficients) == pytest.approx(list(w), abs=1e-3)


def test_horizons_and_ablation(spark):
    grid = ar_daily(spark)
    wanted = sets.multi_source_features("pm25", grid.columns)
    table = sets.feature_table(grid, [*wanted, *sets.horizon_targets("pm25")], required=["target_1h"]).persist()
    tables = []
    for h in (1, 24):
        run = models.horizon_experiment(
            table, sets.names_of(wanted), f"target_{h}h", "pm25_lag_1", models.horizon_models(trees=3, rounds=3, maxDepth=4)
        )
        rows = {r.model: r for r in run.metrics.collect()}
        assert rows["Ridge"].rmse < rows["Naive baseline"].rmse
        assert run.comparison.first().n == rows["Ridge"].n_test
        tables.append(run.metrics.select(F.lit("pm25").alias("pollutant"), F.lit(f"{h}h").alias("horizon"), "*"))
    wide = reports.horizon_comparison(tables[0].unionByName(tables[1]))
    assert wide.count() == 2 and wide.where("gradient_boosting_rmse is null or naive_baseline_rmse is null").isEmpty()
    steps = models.ablation(table, sets.ablation_sets(wanted)[:3], "target_1h", models.boosting(maxIter=3)).orderBy("step").collect()
    assert [s.n_features for s in steps] == [1, 8, 19]
    assert steps[1].rmse < steps[0].rmse
    table.unpersist()


def test_baseline_without_lag_is_the_training_mean(spark):
    grid = ar_daily(spark, 300)
    wanted = [f for f in sets.next_hour_features("pm25") if f.group == "time"]
    table = add_features(grid, [*wanted, lead("target_1h", "pm25", 1)], keep=["hour_index"])
    run = models.horizon_experiment(table, [f.name for f in wanted], "target_1h", None, [models.ridge(scaled=False, name="Ridge")])
    assert {r.model for r in run.metrics.collect()} == {"Naive baseline", "Ridge"} and run.comparison is None
