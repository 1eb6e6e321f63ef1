"""What the registered model queries ask for, without the minutes of their full sizes."""

import pytest

from hourloom import queries as registry
from hourloom.plans import features, models

registry.load()
RUNS = registry.RUNNERS
BEST = ["best_model", "residual_table", "residual_histogram", "residual_qq", "predicted_vs_actual"]
FIVE = ["Linear Regression", "Ridge Regression", "Lasso Regression", "Random Forest", "Gradient Boosting"]


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", BEST)
def test_best_model_is_chosen_among_all_five(spark, monkeypatch, name):
    def experiment(table, columns, current, regressors, *args, **options):
        raise Asked([m.name for m in regressors])

    monkeypatch.setattr(models, "next_hour_experiment", experiment)
    with pytest.raises(Asked) as asked:
        RUNS[name](spark, "/root/testdata/sf0.001")
    assert asked.value.args[0] == FIVE


NEXT_HOUR = ["fit_linear", "fit_forest", "fit_boosting", "results_table", "importance_topk"]


@pytest.mark.parametrize("name", ["fit_linear", "fit_forest", "fit_boosting", "results_table"])
def test_fits_are_cross_validated(spark, monkeypatch, name):
    def experiment(table, columns, current, regressors, n_splits=5, **options):
        raise Asked(n_splits)

    monkeypatch.setattr(models, "next_hour_experiment", experiment)
    with pytest.raises(Asked) as asked:
        RUNS[name](spark, "/root/testdata/sf0.001")
    assert asked.value.args[0] == 5


@pytest.mark.parametrize("name", [*NEXT_HOUR, *BEST])
def test_next_hour_queries_cover_both_pollutants(spark, monkeypatch, name):
    whole, asked = models.next_hour_experiment, []

    def experiment(table, columns, current, regressors, n_splits=5, **options):
        asked.append((current, tuple(columns)))
        small = {m.name: m for m in models.next_hour_models(trees=2, rounds=2, maxDepth=2)}
        return whole(table, columns, current, [small[m.name] for m in regressors[-2:]], 0, **options)

    monkeypatch.setattr(models, "next_hour_experiment", experiment)
    rows = RUNS[name](spark, "/root/testdata/sf0.01")
    assert {r["pollutant"] for r in rows.select("pollutant").distinct().collect()} == {"pm25", "pm10"}
    pm25, pm10 = (features.next_hour_features(*x) for x in (("pm25", "pm10"), ("pm10", "pm25", (1,))))
    assert asked == [("pm25", tuple(f.name for f in pm25)), ("pm10", tuple(f.name for f in pm10))]


def test_ablation_covers_both_pollutants(spark, monkeypatch):
    small, whole = models.boosting(maxIter=1, maxDepth=1), models.ablation
    monkeypatch.setattr(models, "ablation", lambda table, sets, target, regressor: whole(table, sets[:2], target, small))
    rows = RUNS["ablation"](spark, "/root/testdata/sf0.01").collect()
    assert [(r["pollutant"], r["step"]) for r in rows] == [("pm25", 0), ("pm25", 1), ("pm10", 0), ("pm10", 1)]
