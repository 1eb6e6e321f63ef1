"""Plot-ready tables about model errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourloom.plans import models, reports
from hourloom.queries import query
from hourloom.queries.models import each_pollutant, next_hour_run, released


def best_residuals(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    """Residuals of the model with the lowest test error of all five."""
    run = released(next_hour_run(spark, sf_dir, models.next_hour_models(), target=target))
    best = models.best_model(run.results).first()["model"]
    column = next(m.pred for m in run.fitted if m.name == best)
    return reports.residuals(run.predictions, column)


@query()
def residual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_pollutant(lambda t: best_residuals(spark, sf_dir, t))


@query()
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_pollutant(lambda t: reports.residual_histogram(best_residuals(spark, sf_dir, t), 50))


@query()
def residual_qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_pollutant(lambda t: reports.residual_qq(best_residuals(spark, sf_dir, t)))


@query()
def predicted_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_pollutant(lambda t: reports.predicted_vs_actual(best_residuals(spark, sf_dir, t)))
