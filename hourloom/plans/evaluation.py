"""Chronological splits, expanding folds, imputation, scaling, baselines, metrics and the DM test."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.functions.distributions import t_tail
from hourloom.functions.timecols import floor_div
from hourloom.operators.grid import HOUR
from hourloom.operators.ranks import distributed_rank, exact_quantiles

EPS = 2.220446049250313e-16  # fixed value: double machine epsilon


def chronological_rank(
    df: DataFrame,
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    bucket_hours: int = 24,
    hourly_keys: bool = False,
) -> DataFrame:
    """Add seq (0-based position in time) and n_rows per key.

    hourly_keys=True says that a key has at most one row per hour. Its length is then bounded by the
    calendar (8,784 rows a year), and one window per key ranks it without reading the input twice.
    Otherwise, and always for a table without keys, ranks come from accumulated day counts.
    """
    if hourly_keys and keys:
        series = W.partitionBy(*keys)
        return df.withColumns(
            {
                "seq": F.row_number().over(series.orderBy(HOUR, *ties)).cast("bigint") - 1,
                "n_rows": F.count(F.lit(1)).over(series),
            }
        )
    day = floor_div(F.col(HOUR), bucket_hours)
    return distributed_rank(df, [HOUR, *ties], [("_day", day)], keys)


def is_train(test_size: float = 0.2) -> Column:
    """First share of the rows in time order; needs seq and n_rows."""
    return F.col("seq") < F.floor(F.col("n_rows") * F.lit(1.0 - test_size))


def expanding_folds(ranked: DataFrame, n_splits: int = 5) -> DataFrame:
    """One row per (row, fold) it takes part in, with role train or validate.

    Fold i trains on everything before its validation block; the blocks are the last n_splits
    blocks of n // (n_splits + 1) rows.
    """
    fold = F.explode(F.array(*[F.lit(i) for i in range(1, n_splits + 1)])).alias("fold")
    spread = ranked.select("*", fold)
    return spread.withColumn("role", fold_role(F.col("fold"), n_splits)).where(F.col("role").isNotNull())


def fold_role(fold: Column, n_splits: int = 5) -> Column:
    """train, validate or null for a row in the fold; needs seq and n_rows, so folds follow each series."""
    block = floor_div_col(F.col("n_rows"), n_splits + 1)
    start = F.col("n_rows") - (F.lit(n_splits + 1) - fold) * block
    return F.when(F.col("seq") < start, "train").when(F.col("seq") < start + block, "validate")


def fold_block(n_splits: int = 5) -> Column:
    """0 for rows before every validation block, else the number of the fold that validates on the row.

    Fold i trains on the blocks below i. Needs seq and n_rows.
    """
    block = floor_div_col(F.col("n_rows"), n_splits + 1)
    first = F.col("n_rows") - n_splits * block
    later = F.call_function("div", F.col("seq") - first, F.nullif(block, F.lit(0).cast("bigint"))) + 1
    return F.when(F.col("seq") < first, 0).otherwise(F.coalesce(later, F.lit(0))).cast("int")


def floor_div_col(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def fold_bounds(n: int, n_splits: int = 5) -> list[tuple[int, int]]:
    """(start, end) of each validation block for n rows."""
    block = n // (n_splits + 1)
    return [(n - (n_splits - i) * block, n - (n_splits - i - 1) * block) for i in range(n_splits)]


@dataclass(frozen=True)
class MedianImputer:
    """Exact training medians; columns without any training value are dropped."""

    medians: dict[str, float]
    dropped: tuple[str, ...] = ()

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> MedianImputer:
        rows = exact_quantiles(train, columns, [0.5]).select("column", "quantile").collect()  # one per column
        medians = {r["column"]: r["quantile"] for r in rows}
        return cls({c: medians[c] for c in columns if c in medians}, tuple(c for c in columns if c not in medians))

    @property
    def columns(self) -> list[str]:
        return list(self.medians)

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)), F.lit(m)) for c, m in self.medians.items()}
        return df.withColumns(filled).drop(*self.dropped)


@dataclass(frozen=True)
class Standardiser:
    """Population mean and deviation of the training rows; constant columns are only centred."""

    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> Standardiser:
        cells = [c for name in columns for c in (F.avg(name), F.stddev_pop(name))]
        row = train.agg(*cells).first()
        return cls({name: (row[2 * i], row[2 * i + 1]) for i, name in enumerate(columns)})

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        scaled = {
            f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in self.moments.items()
        }
        return df.withColumns(scaled)


def regression_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y",
    pred: str = "pred",
    mape_above: float | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """RMSE, MAE, R² and MAPE in one aggregation.

    mape_above restricts MAPE to rows whose true value exceeds it; extra aggregates ride along.
    """
    both = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    error = F.col(y) - F.col(pred)
    relative = F.abs(error) / F.greatest(F.abs(F.col(y)), F.lit(EPS))
    if mape_above is not None:
        relative = F.when(F.col(y) > mape_above, F.abs(error / F.col(y)))
    mse = F.avg(error * error)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1.0 - mse / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        (100.0 * F.avg(relative)).alias("mape"),
        *extra,
    )


def rounded(metrics: DataFrame) -> DataFrame:
    """Fixed rounding of published tables: three decimals, one for MAPE."""
    places = {"rmse": 3, "mae": 3, "r2": 3, "mape": 1}
    return metrics.withColumns({c: F.round(c, d) for c, d in places.items()})


def dm_test(
    df: DataFrame, pred_a: str, pred_b: str, y: str = "y", keys: Sequence[str] = (), p_value: bool = True
) -> DataFrame:
    """Diebold-Mariano comparison on squared errors. A positive statistic means a's errors are larger."""
    d = F.pow(F.col(y) - F.col(pred_a), F.lit(2.0)) - F.pow(F.col(y) - F.col(pred_b), F.lit(2.0))
    moments = df.select(*keys, d.alias("d")).groupBy(*keys).agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.var_samp("d").alias("var_d")
    )
    var_mean = F.col("var_d") / F.col("n")
    flat = ~F.coalesce(var_mean > 0, F.lit(False))
    result = moments.withColumn(
        "stat", F.when(flat, F.lit(0.0)).otherwise(F.col("mean_d") / F.sqrt(F.when(~flat, var_mean)))
    )
    if not p_value:
        return result
    p = t_tail(F.col("stat"), (F.col("n") - 1).cast("double"))
    return result.withColumn("p_value", F.when(flat, F.lit(1.0)).otherwise(p)).withColumn(
        "significant", F.col("p_value") < 0.05
    )


def fold_summary(scores: DataFrame, keys: Sequence[str], score: str = "rmse") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.groupBy(*keys).agg(
        F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"), F.count(score).alias("n_folds")
    )
