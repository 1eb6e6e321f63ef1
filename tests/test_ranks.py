import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourloom.functions.timecols import floor_div, hour_index
from hourloom.operators import clean, distribution, ranks


def test_distributed_rank_equals_row_number(spark):
    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(int(i), "a" if i % 3 else "b", start + dt.timedelta(minutes=int(rng.integers(0, 9000)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp_ntz")
    got = ranks.distributed_rank(df, ["ts", "id"], [("_h", hour_index("ts"))], ["k"]).toPandas()
    want = df.toPandas().sort_values(["k", "ts", "id"])
    want["seq"] = want.groupby("k").cumcount()
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert (merged.seq == merged.seq_w).all()
    assert (merged.n_rows == merged.groupby("k").id.transform("count")).all()


def test_rank_with_a_hot_timestamp_split_by_a_second_bucket(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).cast("bigint").alias("t"))
    buckets = [("_t", F.col("t")), ("_i", floor_div(F.col("id"), 100))]
    got = ranks.distributed_rank(df, ["t", "id"], buckets).orderBy("id").select("seq").collect()
    assert [r.seq for r in got] == list(range(2000))


def test_sorted_rank_splits_a_hot_instant(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("bigint").alias("t"))
    ranked = ranks.sorted_rank(df.repartition(5), ["t", "id"])
    pdf = ranked.withColumn("p", F.spark_partition_id()).toPandas()
    want = pdf.sort_values(["t", "id"]).reset_index(drop=True)
    assert (want.seq == want.index).all() and (want.n_rows == 20_000).all()
    assert pdf[pdf.t == 7].p.nunique() > 1
    assert ranks.sorted_rank(df.limit(0), ["t", "id"]).count() == 0


DISTRIBUTIONS = {
    "uniform": lambda r: r.uniform(0, 100, 4001),
    "one value": lambda r: np.full(500, 3.25),
    "hot value": lambda r: np.concatenate([np.full(3000, 5.0), r.normal(0, 50, 1500)]),
    "far outlier": lambda r: np.concatenate([r.uniform(0, 1, 2000), [1e300, -1e300]]),
    "tiny": lambda r: np.array([2.0]),
    "two": lambda r: np.array([1.0, 10.0]),
    "integers": lambda r: r.integers(0, 7, 2500).astype(float),
}


@pytest.mark.parametrize("reread", [True, False])
@pytest.mark.parametrize("name", DISTRIBUTIONS)
def test_exact_quantiles(spark, name, reread):
    values = DISTRIBUTIONS[name](np.random.default_rng(5))
    df = spark.createDataFrame(pd.DataFrame({"v": values})).unionByName(
        spark.createDataFrame([(None,), (float("nan"),)], "v double")
    )
    probs = [0.0, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {r["prob"]: r for r in ranks.exact_quantiles(df, ["v"], probs, bins=16, reread=reread).collect()}
    for p in probs:
        assert got[p]["quantile"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
        assert got[p]["n_values"] == len(values)


def test_exact_quantiles_by_key_and_column(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 3000), "a": rng.normal(size=3000), "b": rng.uniform(size=3000)})
    got = ranks.exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], [0.5, 0.9], ["k"]).collect()
    assert len(got) == 5 * 2 * 2
    for r in got:
        assert r["quantile"] == pytest.approx(pdf[pdf.k == r["k"]][r["column"]].quantile(r["prob"]), rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert ranks.exact_quantiles(empty, ["v"], [0.5]).count() == 0


def test_counted_values_are_read_once(spark, tmp_path):
    """Every later stage, the limits subquery included, reuses the exchange of the counted values."""
    path = str(tmp_path / "v.parquet")
    spark.range(5000).selectExpr("cast(id as double) v").write.parquet(path)
    found = ranks.exact_quantiles(spark.read.parquet(path), ["v"], [0.5], reread=False)
    found.collect()
    assert scanned_rows(found._jdf.queryExecution().executedPlan()) == 5000


def scanned_rows(plan):
    """Rows that the scans of an executed plan gave; a reused exchange has no scan of its own."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return scanned_rows(plan.executedPlan())
    if kind == "ReusedExchangeExec":
        return 0
    if kind.endswith("QueryStageExec"):
        return scanned_rows(plan.plan())
    if kind == "FileSourceScanExec":
        return plan.metrics().apply("numOutputRows").value()
    below = [*_seq(plan.children()), *_seq(plan.subqueries())]
    return sum(scanned_rows(p) for p in below)


def _seq(items):
    return [items.apply(i) for i in range(items.size())]


def test_rereading_shuffles_only_chosen_bins(spark, tmp_path):
    """Ten thousand distinct values: the second exchange carries a few bins' worth of them."""
    path = str(tmp_path / "v.parquet")
    spark.range(10_000).selectExpr("cast(id as double) v").write.parquet(path)
    q = ranks.exact_quantiles(spark.read.parquet(path), ["v"], [0.5], bins=64)
    assert q.first()["quantile"] == 4999.5
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [column" in plan


def test_gaps_match_pandas(spark):
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in ("a", "b"):
        for m in rng.integers(0, 40_000, 300):
            rows.append((k, start + dt.timedelta(seconds=int(m) * 60)))
        rows += [(k, rows[-1][1])] * 3
    rows.append(("a", None))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    gaps = ranks.consecutive_gaps(df, ["k"])
    pdf = pd.DataFrame(rows, columns=["k", "ts"]).dropna()
    want = pdf.sort_values(["k", "ts"]).groupby("k").ts.diff().dropna()
    assert gaps.agg(F.sum("weight")).first()[0] == len(want)
    assert gaps.agg(F.sum(F.col("gap_us") * F.col("weight"))).first()[0] == int(want.dt.total_seconds().sum() * 1e6)
    medians = {r.k: r.median_hours for r in clean.median_gap(df, ["k"]).collect()}
    for k, group in pdf.groupby("k"):
        seconds = group.ts.sort_values().diff().dropna().dt.total_seconds()
        assert medians[k] == pytest.approx(seconds.median() / 3600, rel=1e-12)


def test_frequency_check(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("hourly", start + dt.timedelta(minutes=60 * i + i % 5)) for i in range(50)]
    rows += [("daily", start + dt.timedelta(days=i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    assert {r.k: r.is_hourly for r in clean.frequency_check(df, ["k"]).collect()} == {"hourly": True, "daily": False}


def test_qq_points_expand_hot_values(spark):
    values = [1.0] * 700 + [2.0, 0.5, 9.0] + [4.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = distribution.qq_points(df, "v", bins=8, chunk=64).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(values) + 1))
    assert [r.ordered for r in rows] == sorted(values)
    assert rows[0].theoretical == pytest.approx(-rows[-1].theoretical, abs=1e-9)
