import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.operators import clean, coverage, distribution, profile
from hourloom.settings import WIDE_POLLUTION_SCHEMA
from hourloom.sources import stations


def test_coerce_bad_values_under_ansi(spark):
    rows = [("2024-01-01", "1.5"), ("bad", "2"), ("2024-13-01", "x"), (None, None), ("2024-01-02 03:00", "NaN")]
    df = clean.coerce(spark.createDataFrame(rows, "ts string, v string"), ["ts"], ["v"])
    assert [(r.ts, r.v) for r in df.collect()] == [
        (dt.datetime(2024, 1, 1), 1.5), (None, 2.0), (None, None), (None, None), (dt.datetime(2024, 1, 2, 3), None),
    ]
    assert clean.drop_missing(df, ["ts"]).count() == 2


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "pm25 int, ts timestamp_ntz")
    fixed = clean.with_required_columns(df, WIDE_POLLUTION_SCHEMA)
    assert clean.assert_schema(fixed, WIDE_POLLUTION_SCHEMA) is fixed
    assert fixed.first() == T.Row(ts=dt.datetime(2024, 1, 1), pm25=1.0, pm10=None)
    with pytest.raises(ValueError):
        clean.assert_schema(df, WIDE_POLLUTION_SCHEMA)


def test_pick_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", 3)], "ms_a double, b_lag_1 double, c string, target_1h int")
    assert clean.pick_columns(df, prefix="ms_") == ["ms_a"]
    assert clean.pick_columns(df, pattern="_lag_") == ["b_lag_1"]
    assert clean.pick_columns(df, exclude=["c"]) == ["ms_a", "b_lag_1", "target_1h"]
    assert clean.numeric_columns(df, exclude=["target_1h"]) == ["ms_a", "b_lag_1"]


def test_date_range(spark):
    with pytest.raises(ValueError):
        clean.check_date_range("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        clean.check_date_range("soon", "2024-01-01")
    rows = [(dt.datetime(2024, 1, d, 23),) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    assert clean.between_dates(df, "2024-01-02", "2024-01-04").count() == 3


def test_date_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, "u")], "ts timestamp_ntz, v double, w string").write.parquet(path)
    plan = clean.between_dates(spark.read.parquet(path).select("ts", "v"), "2024-01-01", "2024-01-02")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text and "w:string" not in text


def test_missing_report_and_empty_table(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 1.0), (3.0, None)], "a double, b double")
    rows = {r.column: (r.n_missing, r.pct_missing, r.mostly_missing) for r in clean.missing_report(df, ["a", "b"]).collect()}
    assert rows == {"a": (1, 25.0, False), "b": (3, 75.0, True)}
    empty = clean.missing_report(df.where("a > 99"), ["a"]).first()
    assert (empty.n_missing, empty.pct_missing, empty.mostly_missing) == (0, None, False)


def test_duplicates_count_nulls_like_a_value(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t,), (t,), (t,), (None,), (None,), (t + dt.timedelta(hours=1),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    want = int(pd.Series([r[0] for r in rows]).duplicated().sum())
    assert profile.duplicate_timestamps(df).first()[0] == want == 3


def test_profiles_match_pandas(spark):
    rng = np.random.default_rng(8)
    ts = pd.date_range("2023-11-01", periods=3000, freq="h")
    value = rng.normal(20, 5, 3000)
    value[::17] = np.nan
    pdf = pd.DataFrame({"ts": ts, "value": value})
    rows = [(t.to_pydatetime(), None if np.isnan(v) else float(v)) for t, v in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    for make, key, part in (
        (profile.hour_profile, "hour", pdf.ts.dt.hour),
        (profile.weekday_profile, "day_of_week", pdf.ts.dt.dayofweek),
        (profile.month_profile, "month", pdf.ts.dt.month),
    ):
        want = pdf.groupby(part)["value"].agg(["mean", "std", "count"])
        for r in make(df).collect():
            w = want.loc[r[key]]
            assert r["mean"] == pytest.approx(w["mean"]) and r["std"] == pytest.approx(w["std"]) and r["count"] == w["count"]
    hours = profile.hour_profile(df)
    ends = profile.extreme_bucket(hours, "hour").first()
    want = pdf.groupby(pdf.ts.dt.hour)["value"].mean()
    assert (ends.peak_hour, ends.lowest_hour) == (want.idxmax(), want.idxmin())
    described = profile.describe(df, ["value"]).first()
    w = pdf.value.describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("median", "50%"), ("q75", "75%"), ("max", "max")):
        assert described[ours] == pytest.approx(w[theirs])
    assert profile.season_matrix(df).count() == 24


def test_extreme_bucket_prefers_the_first_on_ties(spark):
    df = spark.createDataFrame([(5, 2.0), (3, 2.0), (9, 1.0), (8, 1.0), (1, None)], "hour int, mean double")
    assert profile.extreme_bucket(df, "hour").first().asDict() == {
        "peak_hour": 3, "peak_mean": 2.0, "lowest_hour": 8, "lowest_mean": 1.0,
    }


def test_audit_report(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=i), None if i % 4 == 0 else 1.0) for i in range(20)]
    report = {r.metric: (r.value, r.status) for r in profile.audit_report(spark.createDataFrame(rows, "ts timestamp_ntz, v double"), ["v"]).collect()}
    assert report["Total Rows"] == ("20", "✓")
    assert report["Median Timestep (hours)"] == ("1.00", "✓")
    assert report["Missing: v"] == ("25.00%", "✗")
    assert report["Timezone Aware"] == ("No", "⚠")
    assert report["Dtype: v"] == ("double", "ℹ")


def test_correlation_and_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(size=500), "z": rng.normal(size=500)})
    pdf.loc[::9, "y"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    want = pdf.corr()
    got = distribution.correlation_matrix(df, ["x", "y", "z"]).collect()
    assert len(got) == 9
    assert all(r.r == pytest.approx(want.loc[r.x, r.y]) for r in got)
    fit = distribution.linear_fit(df, "x", "y").first()
    both = pdf.dropna()
    slope, intercept = np.polyfit(both.x, both.y, 1)
    assert fit.slope == pytest.approx(slope) and fit.intercept == pytest.approx(intercept)
    assert fit.y_at_max == pytest.approx(slope * both.x.max() + intercept)


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(6).normal(size=2000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "flat": np.full(2000, 7.0)}))
    rows = distribution.histogram(df, ["v", "flat"], 50).collect()
    counts, edges = np.histogram(values, bins=50)
    mine = sorted((r.bin, r["count"], r["left"]) for r in rows if r.column == "v")
    assert [m[1] for m in mine] == list(counts)
    assert [m[2] for m in mine] == pytest.approx(list(edges[:-1]))
    flat = [r for r in rows if r.column == "flat" and r["count"]]
    assert sum(r["count"] for r in flat) == 2000 and flat[0]["left"] >= 6.5


def test_box_stats(spark):
    values = np.concatenate([np.random.default_rng(9).normal(size=999), [50.0, -40.0]])
    row = distribution.box_stats(spark.createDataFrame(pd.DataFrame({"v": values})), ["v"]).first()
    q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    assert (row.q25, row.median, row.q75) == pytest.approx((q1, med, q3))
    assert (row.whisker_low, row.whisker_high) == pytest.approx((inside.min(), inside.max()))
    assert row.n_outliers == len(values) - len(inside) >= 2
    assert row["mean"] == pytest.approx(values.mean())


def test_extremes(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as double) v")
    rows = distribution.upper_extremes(df, "v").collect()
    assert sorted(r.id for r in rows) == list(range(990, 1000)) and rows[0].threshold == pytest.approx(989.01)
    assert [r.id for r in distribution.top_rows(df, "v", ["id"], 3).collect()] == [999, 998, 997]


def test_coverage_prefers_stations(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "location string, parameter string, ts timestamp_ntz, value double"
    wide = spark.createDataFrame([(1.0, None), (2.0, None)], "pm25 double, pm10 double")
    full = spark.createDataFrame([("a", "pm25", t, 1.0), ("b", "no2", t, 1.0)], schema)
    row = coverage.source_coverage(full, wide, ["pm25", "pm10"]).first()
    assert (row.station_count, row.pm25_in_stations, row.pm10_in_stations) == (2, True, False)
    assert (row.recommended_source, row.pm25_modelled_valid, row.pm10_modelled_valid) == ("stations", 2, 0)
    other = spark.createDataFrame([("a", "no2", t, 1.0)], schema)
    assert coverage.source_coverage(other, wide, ["pm25"]).first().recommended_source == "modelled"
    nothing = coverage.source_coverage(other.limit(0), wide.limit(0), ["pm25"]).first()
    assert (nothing.station_count, nothing.recommended_source) == (0, None)


def test_probe_windows(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t + dt.timedelta(days=i),) for i in range(20)], "ts timestamp_ntz")
    assert coverage.probe_last_days(df).count() == 8 and coverage.probe_first_days(df).count() == 8


def test_station_feed_and_choice(spark):
    feed = spark.createDataFrame([(dt.datetime(2024, 1, 1), 3.0, 36.0, "n")], "ts timestamp_ntz, temp double, wspd double, note string")
    row = stations.standardise_station(feed).first()
    assert row.asDict() == {"ts": dt.datetime(2024, 1, 1), "ms_temp": 3.0, "ms_wind_spd": 10.0}
    rows = [(1, 43.3, 76.9), (2, 43.2221, 76.8513), (3, 43.2221, 76.8513), (4, 50.0, 80.0)]
    geo = spark.createDataFrame(rows, "station_id int, latitude double, longitude double")
    near = stations.within_radius(geo, 43.222, 76.8512, 25_000)
    assert sorted(r.station_id for r in near.collect()) == [1, 2, 3]
    assert stations.pick_station(geo, None, 43.222, 76.8512).first().station_id == 2
    assert stations.pick_station(geo, 4, 43.222, 76.8512).first().station_id == 4
    assert stations.pick_station(geo, 99, 43.222, 76.8512).first().station_id == 2
    assert geo.where(F.lit(False)).count() == 0
