"""Linear models from moments, MLlib trees, and the experiments built on them.

Linear models and all their folds come from one aggregation. Tree fits (models, folds, horizons, targets)
are independent and submitted together over one stored table of assembled vectors. Predictions of all
models are chained on one frame, so every score table is a single aggregation.

keys name the series of a table that holds many: a key has one row per hour at most. Rank, split and
folds then follow each series on its own, one model learns from the training rows of all of them, and
scores come for all rows together and per series. Without keys the table is one series.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.grid import HOUR
from hourloom.operators.moments import Moments, block_moments, total
from hourloom.plans.evaluation import (
    MedianImputer,
    chronological_rank,
    dm_test,
    fold_block,
    fold_role,
    is_train,
    regression_metrics,
    rounded,
)
from hourloom.plans.linear import Plane, Solver, fit_with_folds, lasso_solver, least_squares, ridge_solver, solve_planes
from hourloom.plans.runner import Job, run_jobs, stored, vector_table
from hourloom.settings import RANDOM_SEED

# --- Fixed values: model sizes and penalties ---------------------------------------------------------
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 0.1
FOREST = {"numTrees": 100, "maxDepth": 15}
FOREST_MIN_LEAF = 5
BOOSTING = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}
BOOSTING_SUBSAMPLE = 0.8


@dataclass
class Regressor:
    """A named way to fit: a solver over moments, or a factory of an MLlib estimator."""

    name: str
    build: Callable[[], object] | None = None
    solver: Solver | None = None
    scaled: bool = False
    cost: float = 1.0  # relative training time, longest fits start first


def ols() -> Regressor:
    return Regressor("Linear Regression", solver=least_squares, scaled=True)


def ridge(alpha: float = RIDGE_ALPHA, scaled: bool = True, name: str = "Ridge Regression") -> Regressor:
    return Regressor(name, solver=ridge_solver(alpha), scaled=scaled)


def lasso(alpha: float = LASSO_ALPHA, max_iter: int = 1000) -> Regressor:
    return Regressor("Lasso Regression", solver=lasso_solver(alpha, max_iter), scaled=True)


def forest(min_leaf: int = FOREST_MIN_LEAF, **size) -> Regressor:
    """Bagged trees over all features; split quality is quantised to maxBins."""
    options = {**FOREST, **size}
    return Regressor(
        "Random Forest",
        lambda: RandomForestRegressor(
            labelCol="y",
            minInstancesPerNode=min_leaf,
            featureSubsetStrategy="all",
            seed=RANDOM_SEED,
            **options,
        ),
        cost=options["maxDepth"],
    )


def boosting(subsample: float = 1.0, **size) -> Regressor:
    options = {**BOOSTING, **size}
    return Regressor(
        "Gradient Boosting",
        lambda: GBTRegressor(
            labelCol="y", subsamplingRate=subsample, featureSubsetStrategy="all", seed=RANDOM_SEED, **options
        ),
        cost=options["maxIter"] * options["maxDepth"],
    )


def next_hour_models(trees: int = FOREST["numTrees"], rounds: int = BOOSTING["maxIter"], **size) -> list[Regressor]:
    return [ols(), ridge(), lasso(), forest(numTrees=trees, **size), boosting(maxIter=rounds)]


def horizon_models(trees: int = FOREST["numTrees"], rounds: int = BOOSTING["maxIter"], **size) -> list[Regressor]:
    return [
        ridge(scaled=False, name="Ridge"),
        forest(min_leaf=1, numTrees=trees, **size),
        boosting(subsample=BOOSTING_SUBSAMPLE, maxIter=rounds),
    ]


@dataclass
class Fitted:
    """A trained model and the columns it reads."""

    name: str
    model: Model | Plane
    columns: list[str]

    @property
    def pred(self) -> str:
        return "pred_" + self.name.lower().replace(" ", "_")

    def predict(self, df: DataFrame) -> DataFrame:
        """Append this model's prediction column and keep everything else."""
        if isinstance(self.model, Plane):
            return df.withColumn(self.pred, self.model.column(self.columns))
        vector = f"_x_{self.pred}"
        assembled = VectorAssembler(inputCols=self.columns, outputCol=vector).transform(df)
        return self.predict_vectors(assembled, vector).select(*df.columns, self.pred)

    def predict_vectors(self, df: DataFrame, vector: str = "features") -> DataFrame:
        self.model.setFeaturesCol(vector).setPredictionCol(self.pred)
        return self.model.transform(df)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(model, feature, importance) for tree models; empty for linear ones."""
        rows = []
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
            rows = [(self.name, c, float(v)) for c, v in zip(self.columns, values)]
        return spark.createDataFrame(rows, "model string, feature string, importance double")


def fit(regressor: Regressor, train: DataFrame, columns: Sequence[str]) -> Fitted:
    """Train on complete rows; the label column is y."""
    columns = list(columns)
    if regressor.solver:
        moments = total(block_moments(train, [*columns, "y"]).values(), len(columns) + 1)
        return fit_moments(regressor, moments, columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(train).select("features", "y")
    return fit_vectors(regressor, vectors, columns)


def fit_moments(regressor: Regressor, moments: Moments, columns: Sequence[str]) -> Fitted:
    """A linear model out of the moments of the columns and y."""
    return Fitted(regressor.name, solve_planes(regressor.solver, [moments], regressor.scaled)[0], list(columns))


def fit_vectors(regressor: Regressor, vectors: DataFrame, columns: Sequence[str]) -> Fitted:
    """A tree model on rows of (features, y)."""
    return Fitted(regressor.name, regressor.build().fit(vectors), list(columns))


def score_long(df: DataFrame, predictions: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """(model, y, pred) rows out of one frame holding several prediction columns."""
    cells = [F.struct(F.lit(n).alias("model"), F.col(c).alias("pred")) for n, c in predictions.items()]
    return df.select(*keep, "y", F.inline(F.array(*cells)))


def predict_all(models: Sequence[Fitted], df: DataFrame) -> DataFrame:
    for m in models:
        df = m.predict(df)
    return df


def fold_score(regressor: Regressor, vectors: DataFrame, columns: Sequence[str], fold: int, n_splits: int) -> float:
    """RMSE of a fresh tree model on one expanding fold of (features, y, seq, n_rows)."""
    role = fold_role(F.lit(fold), n_splits)
    fold_model = fit_vectors(regressor, vectors.where(role == "train"), columns)
    scored = fold_model.predict_vectors(vectors.where(role == "validate"))
    return regression_metrics(scored, pred=fold_model.pred).first()["rmse"]


def fit_all(
    regressors: Sequence[Regressor], train: DataFrame, columns: Sequence[str], n_splits: int = 0
) -> tuple[list[Fitted], dict[str, list[float]]]:
    """All models on all rows of train, and the RMSE of each expanding fold.

    train carries y, seq and n_rows. Linear models share one pass over the fold blocks; tree fits run
    together over one table of vectors.
    """
    spark, columns = train.sparkSession, list(columns)
    fitted: dict[str, Fitted] = {}
    scores: dict[str, list[float]] = {m.name: [] for m in regressors}
    linear = [m for m in regressors if m.solver]
    if linear:
        blocks = block_moments(train, [*columns, "y"], fold_block(n_splits) if n_splits else None)
        for m in linear:
            plane, scores[m.name] = fit_with_folds(m.solver, blocks, len(columns) + 1, n_splits, m.scaled)
            fitted[m.name] = Fitted(m.name, plane, columns)
    trees = [m for m in regressors if not m.solver]
    if trees:
        n = train.count()
        vectors = vector_table(train, columns, ["y", "seq", "n_rows"], n)
        jobs = [Job((m.name, 0), lambda m=m: fit_vectors(m, vectors.select("features", "y"), columns), m.cost) for m in trees]
        if n > n_splits:  # folds of fewer rows are empty
            jobs += [
                Job((m.name, i), lambda m=m, i=i: fold_score(m, vectors, columns, i, n_splits), m.cost * i / (n_splits + 1))
                for m in trees
                for i in range(1, n_splits + 1)
            ]
        for (name, fold), result in run_jobs(spark, jobs).items():
            if fold:
                scores[name].append(result)
            else:
                fitted[name] = result
        vectors.unpersist()
    return [fitted[m.name] for m in regressors], scores


@dataclass
class NextHourRun:
    """Everything one next-hour experiment produced."""

    fitted: list[Fitted]
    columns: list[str]
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    results: DataFrame
    cv_scores: dict[str, list[float]] = field(default_factory=dict)
    series_results: DataFrame | None = None  # test metrics per series and model

    def release(self) -> None:
        """Drop the cached train and test rows; results and predictions do not need them."""
        self.train.unpersist()
        self.test.unpersist()


def next_hour_experiment(
    table: DataFrame,
    columns: Sequence[str],
    current: str,
    models: Sequence[Regressor],
    n_splits: int = 5,
    test_size: float = 0.2,
    keys: Sequence[str] = (),
) -> NextHourRun:
    """Split in time, keep complete cases, compare models with persistence.

    table carries hour_index, the features, y (next hour) and the current value. The chronological
    split is taken before incomplete rows are dropped.
    """
    columns = list(columns)
    spark = table.sparkSession
    source = table.select(*keys, HOUR, *dict.fromkeys([*columns, current]), "y").na.drop(subset=["y"])
    source = source.persist(StorageLevel.MEMORY_AND_DISK)  # ranking reads it twice
    ranked = chronological_rank(source, keys, hourly_keys=True)
    complete = ranked.na.drop(subset=columns)
    train_rows = complete.where(is_train(test_size)).drop("seq", "n_rows")
    train = chronological_rank(train_rows, keys, hourly_keys=True).persist(StorageLevel.MEMORY_AND_DISK)
    test = complete.where(~is_train(test_size)).persist(StorageLevel.MEMORY_AND_DISK)
    for rows in (train, test):
        rows.count()  # fill the cache before the input is let go
    source.unpersist()

    fitted, cv = fit_all(models, train, columns, n_splits)
    predictions = predict_all(fitted, test)
    names = {m.name: m.pred for m in fitted}
    predictions = stored(predictions.select(*keys, HOUR, *dict.fromkeys([current, "y", *names.values()])))
    test_scores = score_long(predictions, {"Naive Baseline": current, **names}, keys)
    on_test = regression_metrics(test_scores, ["model"])
    by_series = regression_metrics(test_scores, [*keys, "model"]) if keys else None
    on_train = regression_metrics(score_long(predict_all(fitted, train), names), ["model"])
    folds = spark.createDataFrame(
        [(name, float(s)) for name, scores in cv.items() for s in scores], "model string, rmse double"
    )
    summary = folds.groupBy("model").agg(
        F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std")
    )
    wanted = ["rmse", "mae", "r2", "mape"]
    results = (
        on_test.select("model", *[F.col(c).alias(f"test_{c}") for c in wanted])
        .join(on_train.select("model", *[F.col(c).alias(f"train_{c}") for c in wanted]), "model", "left")
        .join(summary, "model", "left")
    )
    return NextHourRun(fitted, columns, train, test, predictions, small_table(results), cv, by_series)


def best_model(results: DataFrame, score: str = "test_rmse") -> DataFrame:
    """Lowest score; the model name breaks ties."""
    return results.where(F.col("model") != "Naive Baseline").orderBy(score, "model").limit(1)


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


@dataclass
class HorizonRun:
    metrics: DataFrame
    comparison: DataFrame | None
    fitted: list[Fitted]
    series_metrics: DataFrame | None = None  # metrics per series and model


@dataclass
class HorizonTable:
    """The prepared rows of one target and horizon."""

    columns: list[str]
    train: DataFrame
    test: DataFrame
    vectors: DataFrame
    moments: Moments | None
    baseline: Column
    held: list[DataFrame]
    keys: tuple[str, ...] = ()

    def fit(self, regressor: Regressor) -> Fitted:
        if regressor.solver:
            return fit_moments(regressor, self.moments, self.columns)
        return fit_vectors(regressor, self.vectors, self.columns)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def prepare_horizon(
    table: DataFrame,
    columns: Sequence[str],
    target: str,
    lag1: str | None,
    linear: bool = True,
    test_size: float = 0.2,
    keys: Sequence[str] = (),
) -> HorizonTable:
    """Split in time, impute with training medians, assemble vectors and sum products."""
    ranked = chronological_rank(
        table.withColumn("y", F.col(target)).na.drop(subset=["y"]).select(*keys, HOUR, *columns, "y"),
        keys,
        hourly_keys=True,
    ).persist(StorageLevel.MEMORY_AND_DISK)
    imputer = MedianImputer.fit(ranked.where(is_train(test_size)), columns)
    filled = imputer.transform(ranked).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = filled.where(is_train(test_size)), filled.where(~is_train(test_size))
    n, mean = train.agg(F.count(F.lit(1)), F.avg("y")).first()
    ranked.unpersist()
    vectors = vector_table(train, imputer.columns, ["y"], n)
    width = len(imputer.columns) + 1
    moments = total(block_moments(train, [*imputer.columns, "y"]).values(), width) if linear else None
    baseline = F.col(lag1) if lag1 in imputer.medians else F.lit(mean)
    return HorizonTable(imputer.columns, train, test, vectors, moments, baseline, [filled, vectors], tuple(keys))


def score_horizon(prepared: HorizonTable, fitted: Sequence[Fitted]) -> HorizonRun:
    """Metrics of all models and the lag-1 baseline on the test rows, and the comparison of the tree models."""
    names = {m.name: m.pred for m in fitted}
    scored = predict_all(fitted, prepared.test.withColumn("baseline", prepared.baseline))
    scored = stored(scored.select(*prepared.keys, "y", "baseline", *names.values()))
    cells = score_long(scored, {"Naive baseline": "baseline", **names}, prepared.keys)
    metrics = small_table(rounded(regression_metrics(cells, ["model"], mape_above=1.0)))
    by_series = None
    if prepared.keys:
        by_series = rounded(regression_metrics(cells, [*prepared.keys, "model"], mape_above=1.0))
    comparison = None
    if {"Gradient Boosting", "Random Forest"} <= set(names):
        comparison = small_table(dm_test(scored, names["Gradient Boosting"], names["Random Forest"]))
    return HorizonRun(metrics, comparison, list(fitted), by_series)


def horizon_experiments(
    asked: Sequence[tuple[Hashable, DataFrame, Sequence[str], str, str | None]],
    models: Sequence[Regressor],
    test_size: float = 0.2,
    keys: Sequence[str] = (),
) -> dict[Hashable, HorizonRun]:
    """Runs by name for (name, table, columns, target, lag1): prepared, fitted and scored together.

    Every fit of every name is one job of the pool, the longest first. The rows of all names asked for
    together are held at once.
    """
    if not asked:
        return {}
    spark = asked[0][1].sparkSession
    linear = any(m.solver for m in models)
    prepared = run_jobs(
        spark,
        [Job(name, lambda t=t, c=c, y=y, l=l: prepare_horizon(t, c, y, l, linear, test_size, keys)) for name, t, c, y, l in asked],
    )
    fits = run_jobs(
        spark,
        [Job((name, i), lambda p=p, m=m: p.fit(m), m.cost) for name, p in prepared.items() for i, m in enumerate(models)],
    )
    runs = run_jobs(
        spark,
        [
            Job(name, lambda p=p, name=name: score_horizon(p, [fits[(name, i)] for i in range(len(models))]))
            for name, p in prepared.items()
        ],
    )
    for p in prepared.values():
        p.release()
    return runs


def horizon_experiment(
    table: DataFrame,
    columns: Sequence[str],
    target: str,
    lag1: str | None,
    models: Sequence[Regressor],
    test_size: float = 0.2,
    keys: Sequence[str] = (),
) -> HorizonRun:
    """One horizon: median imputation, lag-1 baseline, models, metrics and the DM comparison."""
    return horizon_experiments([(0, table, columns, target, lag1)], models, test_size, keys)[0]


def small_table(df: DataFrame) -> DataFrame:
    """Evaluate a score table of a few rows now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ablation(
    table: DataFrame,
    sets: Sequence[tuple[str, Sequence[str]]],
    target: str,
    regressor: Regressor | None = None,
    test_size: float = 0.2,
    keys: Sequence[str] = (),
) -> DataFrame:
    """RMSE of cumulative feature groups at one horizon; medians are fitted once for all columns."""
    regressor = regressor or boosting()
    columns = list(dict.fromkeys(c for _, cols in sets for c in cols))
    ranked = chronological_rank(
        table.withColumn("y", F.col(target)).na.drop(subset=["y"]).select(*keys, HOUR, *columns, "y"),
        keys,
        hourly_keys=True,
    ).persist(StorageLevel.MEMORY_AND_DISK)
    imputer = MedianImputer.fit(ranked.where(is_train(test_size)), columns)
    filled = imputer.transform(ranked).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = filled.where(is_train(test_size)), filled.where(~is_train(test_size))
    n = train.count()
    usable = [tuple(c for c in cols if c in imputer.medians) for _, cols in sets]

    def score(cols: tuple[str, ...]) -> float:
        vectors = None
        if regressor.solver:
            model = fit(regressor, train, cols)
        else:
            vectors = vector_table(train, cols, ["y"], n)
            model = fit_vectors(regressor, vectors, cols)
        rmse = regression_metrics(model.predict(test), pred=model.pred).first()["rmse"]
        if vectors is not None:
            vectors.unpersist()
        return float(rmse)

    # a group without columns repeats the set before it, and its model
    jobs = [Job(cols, lambda cols=cols: score(cols), len(cols)) for cols in dict.fromkeys(usable) if cols]
    scores = run_jobs(table.sparkSession, jobs)
    rows = [(i, label, len(cols), scores[cols]) for i, ((label, _), cols) in enumerate(zip(sets, usable)) if cols]
    filled.unpersist()
    ranked.unpersist()
    result = table.sparkSession.createDataFrame(
        rows, "step int, configuration string, n_features int, rmse double"
    )
    return result.withColumn("rmse", F.round("rmse", 3))
