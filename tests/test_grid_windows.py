import datetime as dt

import numpy as np
import pandas as pd
import pytest
from frames import ar_daily, close, gappy_hours, grid_frame
from pyspark.sql import functions as F

from hourloom.operators import grid, joins, windows
from hourloom.plans import features as sets


def test_hourly_long_is_complete_and_a_mean_of_means(spark):
    rows = [
        ("a", dt.datetime(2024, 1, 1, 0, 0), 10.0),
        ("a", dt.datetime(2024, 1, 1, 0, 0), 20.0),
        ("a", dt.datetime(2024, 1, 1, 0, 30), 30.0),
        ("a", dt.datetime(2024, 1, 1, 3, 5), 5.0),
        ("a", None, 99.0),
        ("b", dt.datetime(2024, 1, 1, 1, 0), None),
    ]
    df = spark.createDataFrame(rows, "parameter string, ts timestamp_ntz, value double")
    got = grid.with_timestamp(grid.hourly_long(df)).orderBy("parameter", "ts").collect()
    assert [(r.parameter, r.ts.hour, r.value) for r in got] == [
        ("a", 0, 22.5), ("a", 1, None), ("a", 2, None), ("a", 3, 5.0), ("b", 1, None),
    ]


def test_hourly_wide_keeps_absent_parameters_and_stations(spark):
    rows = [
        ("x", "pm25", dt.datetime(2024, 1, 1, 0), 1.0),
        ("y", "pm25", dt.datetime(2024, 1, 1, 0), 3.0),
        ("x", "pm25", dt.datetime(2024, 1, 1, 2), 5.0),
        ("x", "other", dt.datetime(2024, 1, 5, 2), 5.0),
    ]
    df = spark.createDataFrame(rows, "location string, parameter string, ts timestamp_ntz, value double")
    merged = grid.hourly_wide(df, ["pm25", "pm10"]).orderBy("hour_index").collect()
    assert [(r.pm25, r.pm10) for r in merged] == [(2.0, None), (None, None), (5.0, None)]
    apart = grid.hourly_wide(df, ["pm25", "pm10"], keys=["location"])
    assert {(r.location, r.pm25) for r in apart.collect()} == {("x", 1.0), ("x", None), ("x", 5.0), ("y", 3.0)}


def test_pivot_matches_pandas(spark):
    df = gappy_hours(spark)
    pdf = df.toPandas()
    got = grid.pivot_mean(df, ["ts"], ["a", "b"], name_col="series").toPandas().set_index("ts").sort_index()
    want = pdf.pivot_table(index="ts", columns="series", values="value", aggfunc="mean")
    got = got.dropna(how="all")
    pd.testing.assert_frame_equal(got, want, check_names=False)


def test_dense_profile(spark):
    cells = spark.createDataFrame([(3, 1, 5.0)], "hour int, month int, v double")
    dense = grid.dense_profile(cells, {"hour": range(24), "month": range(1, 13)})
    assert dense.count() == 288 and dense.where("v is not null").count() == 1


def test_attach_station_stays_one_to_one(spark):
    base = spark.createDataFrame([(473352 + i, float(i)) for i in range(4)], "hour_index bigint, pm25 double")
    first = dt.datetime(2024, 1, 1)
    feed = [(first + dt.timedelta(minutes=10 * i), float(i)) for i in range(9)]
    station = spark.createDataFrame(feed, "ts timestamp_ntz, ms_temp double")
    joined = joins.attach_station(base, station, ["ms_temp"]).orderBy("hour_index").collect()
    assert [r.ms_temp for r in joined] == [2.5, 7.0, None, None]


SPECS = [
    ("lag_168", lambda v: v.shift(168)),
    ("lag_1", lambda v: v.shift(1)),
    ("lead_24", lambda v: v.shift(-24)),
    ("mean_24", lambda v: v.shift(1).rolling(24, min_periods=12).mean()),
    ("std_24", lambda v: v.shift(1).rolling(24, min_periods=12).std()),
    ("max_168", lambda v: v.shift(1).rolling(168, min_periods=84).max()),
    ("trail_24", lambda v: v.rolling(24, min_periods=24).mean()),
    ("full_6", lambda v: v.shift(1).rolling(6).mean()),
    ("diff_24", lambda v: v.diff(24)),
    ("ldiff_24", lambda v: v.shift(1) - v.shift(25)),
]
FEATURES = [
    windows.lag("lag_168", "value", 168),
    windows.lag("lag_1", "value", 1),
    windows.lead("lead_24", "value", 24),
    windows.rolling("mean_24", "value", "mean", 24, 12),
    windows.rolling("std_24", "value", "std", 24, 12),
    windows.rolling("max_168", "value", "max", 168, 84),
    windows.rolling("trail_24", "value", "mean", 24, lagged=False),
    windows.rolling("full_6", "value", "mean", 6),
    windows.difference("diff_24", "value", 24, lagged=False),
    windows.difference("ldiff_24", "value", 24, lagged=True),
]


@pytest.mark.parametrize("bucket", [None, 200, 240, 2160, 10])
def test_windows_match_pandas_for_every_bucket_size(spark, bucket):
    df, pdf = grid_frame(spark, 900, ("s", "t"))
    got = windows.add_features(df, FEATURES, ["series"], bucket_hours=bucket).toPandas()
    got = got.sort_values(["series", "hour_index"]).reset_index(drop=True)
    assert len(got) == len(pdf)
    for name, make in SPECS:
        want = pdf.groupby("series")["value"].transform(make)
        same = [close(a, b, 1e-9) for a, b in zip(got[name].astype(float), want)]
        assert all(same), (name, bucket, np.where(~np.array(same))[0][:5])


def test_halo_equals_plain_on_one_long_series(spark):
    df, _ = grid_frame(spark, 20_000)
    halo = windows.add_features(df.drop("series"), FEATURES, bucket_hours=720)
    plain = windows.add_features(df, FEATURES, ["series"], bucket_hours=None).drop("series")
    names = [f.name for f in FEATURES]
    rounded = [F.round(n, 8).alias(n) for n in names]
    a, b = (x.select("hour_index", *rounded) for x in (halo, plain))
    assert a.count() == b.count() == 20_000
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_keyless_grid_needs_buckets(spark):
    df, _ = grid_frame(spark, 30)
    with pytest.raises(ValueError):
        windows.add_features(df, FEATURES, bucket_hours=None)


def test_no_feature_sees_the_future(spark):
    """Changing later values must leave every feature of earlier rows as it was."""
    df = ar_daily(spark, 400)
    wanted = sets.multi_source_features("pm25", df.columns) + sets.next_hour_features("pm25", "pm10")[-17:]
    wanted = list({f.name: f for f in wanted}.values())
    cut = df.agg(F.min("hour_index")).first()[0] + 300
    later = F.col("hour_index") > cut
    changed = df.withColumns(
        {c: F.when(later, F.lit(-999.0)).otherwise(F.col(c)) for c in df.columns if c != "hour_index"}
    )
    names = [f.name for f in wanted]
    before, after = (
        windows.add_features(x, wanted, keep=["hour_index"]).where(~later).select("hour_index", *names)
        for x in (df, changed)
    )
    assert before.exceptAll(after).isEmpty()


def test_feature_set_sizes(spark):
    columns = ["pm25", "pm10", "no2", "aod", "dust", "temp", "humidity", "wind_spd", "wind_dir", "precip", "blh"]
    wanted = sets.multi_source_features("pm25", columns)
    assert len(wanted) == 69
    assert [len(c) for _, c in sets.ablation_sets(wanted)] == [1, 8, 19, 28, 69, 69]
    assert len(sets.next_hour_features("pm25", "pm10")) == 28
    assert len(sets.next_hour_features("pm10", "pm25", (1,))) == 27
    with_station = sets.multi_source_features("pm25", [*columns, "ms_temp", "ms_wind_spd"])
    assert len(with_station) == 69 + 2 * 4 + 2
    without_blh = sets.multi_source_features("pm25", [c for c in columns if c != "blh"])
    assert len(without_blh) == 69 - 4 - 3


def test_long_targets(spark):
    df, _ = grid_frame(spark, 50, null_every=1000)
    table = windows.add_features(df, sets.horizon_targets("value", [1, 6]), ["series"])
    long = sets.long_targets(table, [1, 6], ["hour_index"])
    assert {r["horizon"]: r["count"] for r in long.groupBy("horizon").count().collect()} == {1: 49, 6: 44}
