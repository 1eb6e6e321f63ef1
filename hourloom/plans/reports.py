"""Plot-ready tables: profile bands, guideline columns, residuals, predicted against actual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.operators.distribution import histogram, qq_points
from hourloom.settings import GUIDELINES


def guideline_of(parameter: str, period: str) -> Column:
    """The guideline level of the parameter column for a period; null where there is none."""
    levels = [F.lit(x) for p, level in GUIDELINES.items() for x in (p, level[period])]
    return F.try_element_at(F.create_map(*levels), F.col(parameter))


def profile_band(profile: DataFrame, guideline: float | Column) -> DataFrame:
    """Mean plus and minus one deviation, with a guideline level."""
    return profile.withColumns(
        {
            "band_low": F.col("mean") - F.col("std"),
            "band_high": F.col("mean") + F.col("std"),
            "guideline": guideline if isinstance(guideline, Column) else F.lit(guideline),
        }
    )


def with_guidelines(df: DataFrame, parameter: str, value: str) -> DataFrame:
    """Constant reference columns and a status against both guideline levels."""
    level = GUIDELINES[parameter]
    status = (
        F.when(F.col(value) > level["daily"], "above_daily")
        .when(F.col(value) > level["annual"], "above_annual")
        .when(F.col(value).isNotNull(), "within")
    )
    return df.withColumns(
        {
            "guideline_daily": F.lit(level["daily"]),
            "guideline_annual": F.lit(level["annual"]),
            "status": status,
        }
    )


def residuals(predictions: DataFrame, pred: str, order: str = "hour_index", y: str = "y") -> DataFrame:
    """Time-ordered predictions with their residuals."""
    return predictions.select(
        order,
        F.col(y).alias("actual"),
        F.col(pred).alias("predicted"),
        (F.col(y) - F.col(pred)).alias("residual"),
    )


def residual_histogram(residual_rows: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(residual_rows, ["residual"], bins)


def residual_qq(residual_rows: DataFrame) -> DataFrame:
    return qq_points(residual_rows, "residual")


def predicted_vs_actual(residual_rows: DataFrame) -> DataFrame:
    """Pairs with the common axis range of the identity line."""
    bounds = residual_rows.agg(
        F.struct(
            F.least(F.min("actual"), F.min("predicted")).alias("lo"),
            F.greatest(F.max("actual"), F.max("predicted")).alias("hi"),
        )
    ).scalar()
    return residual_rows.withColumn("_b", bounds).select(
        "hour_index", "actual", "predicted", F.col("_b.lo").alias("axis_low"), F.col("_b.hi").alias("axis_high")
    )


def horizon_comparison(metrics: DataFrame, models: Sequence[str] = ("Gradient Boosting", "Naive baseline")) -> DataFrame:
    """One row per pollutant and horizon with RMSE and R² of the compared models."""
    cells = []
    for m in models:
        short = m.lower().replace(" ", "_")
        for c in ("rmse", "r2"):
            cells.append(F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{short}_{c}"))
    return metrics.groupBy("pollutant", "horizon").agg(*cells)
