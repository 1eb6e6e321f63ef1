"""Moments, linear models solved from them, models per series, and the runner of independent jobs."""

import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.operators.distribution import correlation_matrix
from hourloom.operators.moments import Moments, block_moments, pair_sums, total
from hourloom.plans import linear, models
from hourloom.plans.evaluation import chronological_rank, expanding_folds, fold_block
from hourloom.plans.runner import Job, partitions_for, run_jobs, stored, vector_table


def sample(n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 30] + [0, 3, 1e6, -40]
    x[:, 3] += 2 * x[:, 1]
    y = x @ [2.0, -0.3, 4.0, 0.05] + rng.normal(size=n)
    return pd.DataFrame(x, columns=list("abcd")).assign(y=y, hour_index=np.arange(n))


def test_block_moments_equal_numpy_and_add_up(spark):
    pdf = sample()
    pdf.loc[5, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(13)
    blocks = block_moments(df, list("abcdy"), (F.col("hour_index") % 3).cast("int"))
    complete = pdf.dropna()
    assert set(blocks) == {0, 1, 2}
    for b, m in blocks.items():
        part = complete[complete.hour_index % 3 == b][list("abcdy")].to_numpy()
        assert m.n == len(part) and np.allclose(m.mean, part.mean(axis=0))
        centred = part - part.mean(axis=0)
        assert np.allclose(m.products, centred.T @ centred, rtol=1e-7, atol=1e-6)
    whole = total(blocks.values(), 5)
    assert np.allclose(whole.products / whole.n, np.cov(complete[list("abcdy")].to_numpy().T, bias=True), rtol=1e-7, atol=1e-8)
    assert block_moments(df.limit(0), ["a"]) == {} and total([], 2).n == 0
    assert (Moments.none(5) + whole) is whole


def test_pairwise_correlation_of_many_columns(spark):
    rng = np.random.default_rng(5)
    cells = rng.normal(size=(700, 30)).cumsum(axis=1) + 1e5
    cells[rng.random(cells.shape) < 0.2] = np.nan
    names = [f"v{i}" for i in range(30)]
    pdf = pd.DataFrame(cells, columns=names).assign(flat=3.25, empty=np.nan, once=np.where(np.arange(700) == 3, 1.0, np.nan))
    columns = [*names, "flat", "empty", "once"]
    want = pdf[columns].corr()
    df = spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("double")).repartition(7)
    rows = correlation_matrix(df, columns).collect()
    assert len(rows) == len(columns) ** 2
    for r in rows:
        expected = want.loc[r["x"], r["y"]]
        assert (r["r"] is None) == bool(np.isnan(expected)), (r["x"], r["y"])
        assert r["r"] is None or abs(r["r"] - expected) < 1e-9
    few = {(r["x"], r["y"]): r["r"] for r in correlation_matrix(df, names[:4]).collect()}
    many = {(r["x"], r["y"]): r["r"] for r in rows}
    assert all(abs(v - many[k]) < 1e-9 for k, v in few.items())
    assert np.isnan(pair_sums(df.limit(0), ["v0", "v1"]).correlation()).all()


def closed_form(x, y, alpha):
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda new: y.mean() + ((new - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)) @ w


def test_expanding_folds_from_blocks_equal_fitting_each_fold(spark):
    pdf = sample()
    df = chronological_rank(spark.createDataFrame(pdf))
    regressor = models.ridge(3.0)
    fitted, scores = models.fit_all([models.ols(), regressor], df, list("abcd"), 5)
    folds = expanding_folds(df, 5).toPandas()
    for fold in range(1, 6):
        known, held = (folds[(folds.fold == fold) & (folds.role == r)] for r in ("train", "validate"))
        model = closed_form(known[list("abcd")].to_numpy(), known.y.to_numpy(), 3.0)
        error = held.y.to_numpy() - model(held[list("abcd")].to_numpy())
        assert scores["Ridge Regression"][fold - 1] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-6)
    x, y = pdf[list("abcd")].to_numpy(), pdf.y.to_numpy()
    got = fitted[1].predict(spark.createDataFrame(pdf)).orderBy("hour_index").toPandas()[fitted[1].pred]
    assert np.allclose(got, closed_form(x, y, 3.0)(x), rtol=1e-7)
    assert len(scores["Linear Regression"]) == 5
    blocks = df.select("seq", fold_block(5).alias("b")).groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in blocks} == {i: 150 for i in range(6)}


def test_constant_and_repeated_columns_get_no_or_shared_weight(spark):
    pdf = sample(300).assign(year=2024, again=lambda f: f.a, c=lambda f: f.c - 1e6)
    df = spark.createDataFrame(pdf).repartition(9)
    columns = ["a", "again", "b", "year"]
    base = np.column_stack([pdf.a, pdf.b, np.ones(300)])
    want = base @ np.linalg.lstsq(base, pdf.y, rcond=None)[0]
    for regressor in (models.ols(), models.ridge(1e-9), models.lasso(1e-12)):
        found = models.fit(regressor, df, columns)
        assert found.model.weights[3] == 0.0
        pred = found.predict(df).orderBy("hour_index").toPandas()[found.pred]
        assert np.allclose(pred, want, atol=1e-3), regressor.name
    weights = models.fit(models.ols(), df, columns).model.weights
    assert weights[0] == pytest.approx(weights[1])


def test_short_tables_have_no_folds(spark):
    df = chronological_rank(spark.createDataFrame(sample(4)))
    _, scores = models.fit_all([models.ridge(), models.forest(numTrees=2, maxDepth=2)], df, ["a", "b"], 5)
    assert scores == {"Ridge Regression": [], "Random Forest": []}


def test_models_of_five_thousand_series(spark):
    rng = np.random.default_rng(8)
    n, per = 5000, 12
    slope, offset = rng.normal(size=n), rng.normal(size=n) * 10
    key = np.repeat(np.arange(n), per)
    x, z = rng.normal(size=n * per) + 50, rng.normal(size=n * per)
    y = offset[key] + slope[key] * x - 2 * z
    pdf = pd.DataFrame({"k": key, "x": x, "z": z, "y": y})
    pdf.loc[::97, "x"] = np.nan
    extra = pd.DataFrame({"k": [-1, -2, -2], "x": [1.0, 2.0, 2.0], "z": [0.0, 1.0, 1.0], "y": [7.0, 1.0, 3.0]})
    rows = [(int(k), *(None if np.isnan(v) else float(v) for v in r)) for k, *r in pd.concat([pdf, extra]).itertuples(index=False)]
    df = spark.createDataFrame(rows, "k bigint, x double, z double, y double").repartition(8)
    fitted = linear.fit_series(df, ["x", "z"], "y", ["k"])
    got = {r["k"]: r for r in fitted.collect()}
    assert len(got) == n + 2
    for k in range(n):
        assert got[k]["weights"] == pytest.approx([slope[k], -2.0], abs=1e-6)
        assert got[k]["intercept"] == pytest.approx(offset[k], abs=1e-4)
    assert got[-1]["weights"] == [0.0, 0.0] and got[-1]["intercept"] == 7.0  # one row: its own value
    assert got[-2]["n"] == 2 and got[-2]["intercept"] == pytest.approx(2.0)
    scored = linear.predict_series(df.where("k >= 0 and x is not null"), fitted, ["x", "z"], ["k"])
    assert scored.agg(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0] < 1e-4
    one = got[3]
    for solver in (linear.ridge_solver(2.0), linear.lasso_solver(0.05)):
        shrunk = {r["k"]: r for r in linear.fit_series(df.where("k < 40"), ["x", "z"], "y", ["k"], solver).collect()}
        assert abs(shrunk[3]["weights"][1]) < abs(one["weights"][1])


def test_jobs_run_together_in_their_own_pools(spark):
    started, pools, barrier = [], {}, threading.Barrier(3, timeout=30)

    def work(name):
        started.append(name)
        pools[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        barrier.wait()  # passes only if three jobs are in flight
        return spark.range(name * 10).count()

    jobs = [Job(i, lambda i=i: work(i), cost=i) for i in (1, 2, 3)]
    assert run_jobs(spark, jobs, threads=3) == {1: 10, 2: 20, 3: 30}
    assert list(run_jobs(spark, jobs[:0])) == [] and pools == {1: "job-1", 2: "job-2", 3: "job-3"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    with pytest.raises(ValueError):
        run_jobs(spark, [jobs[0], jobs[0]])


def test_longest_jobs_start_first_and_failures_end_the_rest(spark):
    order = []
    run_jobs(spark, [Job(i, lambda i=i: order.append(i), cost=i) for i in (2, 5, 1)], threads=1)
    assert order == [5, 2, 1]
    ran = []

    def fails():
        raise KeyError("no such table")

    late = [Job(i, lambda i=i: (time.sleep(0.05), ran.append(i))) for i in range(20)]
    with pytest.raises(KeyError):
        run_jobs(spark, [Job("bad", fails, cost=9.0), *late], threads=1)
    assert len(ran) < 20


def test_stored_tables(spark):
    assert partitions_for(10, 3) == 1 and partitions_for(50_000_000, 70) > 800
    df = spark.range(100, numPartitions=8).select(F.col("id").cast("double").alias("a"), F.col("id").alias("y"))
    table = vector_table(df, ["a"], ["y"], 100)
    assert table.columns == ["features", "y"] and table.count() == 100 and table.rdd.getNumPartitions() == 1
    kept = stored(df.where("y < 7"))
    assert sorted(r["y"] for r in kept.collect()) == list(range(7))
    table.unpersist()
