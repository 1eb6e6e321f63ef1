import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from hourloom.functions import distributions, geo, meteo, numeric, timecols


def test_to_instant_offsets_zones_and_bad_text(spark):
    rows = [
        ("2024-01-01T00:00:00Z",),
        ("2024-01-01 06:00:00+06:00",),
        ("2024-01-01T00:00",),
        ("2024-01-01",),
        ("x",),
        ("",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "t string")
    midnight = dt.datetime(2024, 1, 1)
    assert [r[0] for r in df.select(timecols.to_instant("t")).collect()] == [midnight] * 4 + [None] * 3
    almaty = [r[0] for r in df.select(timecols.to_instant("t", "Asia/Almaty")).collect()]
    assert almaty[:4] == [midnight, midnight, dt.datetime(2023, 12, 31, 18), dt.datetime(2023, 12, 31, 18)]


def test_session_zone_does_not_matter(spark):
    df = spark.createDataFrame([("2024-03-10T07:30:00Z", dt.datetime(2024, 3, 10, 2, 30))], "t string, n timestamp_ntz")
    columns = [timecols.to_instant("t"), timecols.hour_floor("n"), timecols.hour_index("n"), F.hour("n")]
    expected = df.select(*columns).first()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(*columns).first() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert expected[1] == dt.datetime(2024, 3, 10, 2)


def test_repeated_local_hour(spark):
    """Two different UTC hours share local hour 23 on the night the zone moved."""
    utc = [dt.datetime(2024, 2, 29, h) for h in range(16, 21)]
    df = spark.createDataFrame([(t,) for t in utc], "ts timestamp_ntz")
    got = df.select(F.hour(timecols.local_time("ts", "Asia/Almaty")).alias("h"), timecols.hour_index("ts").alias("i"))
    hours = [r["h"] for r in got.orderBy("i").collect()]
    assert hours == [22, 23, 23, 0, 1]
    assert got.select("i").distinct().count() == 5


def test_hour_index_before_epoch(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59),), (dt.datetime(1970, 1, 1, 1),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(timecols.hour_index("ts")).collect()] == [-1, 1]
    assert df.select(timecols.hour_floor("ts")).first()[0] == dt.datetime(1969, 12, 31, 23)


def test_labels_and_weekday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30),)], "ts timestamp_ntz")
    row = df.select(
        *[c.alias(n) for n, c in timecols.calendar_columns("ts").items()],
        timecols.weekday_label(F.weekday("ts")).alias("d"),
        timecols.month_label(F.month("ts")).alias("m"),
    ).first()
    assert (row.day_of_week, row.week, row.d, row.m) == (0, 1, "Mon", "Dec")


def test_to_number(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(numeric.to_number("v")).collect()] == [1.5, None, None, None, None]


def test_fixed_point_mean_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e6, -1e6] * 40
    means = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        means.add(df.agg(numeric.mean("v", 2)).first()[0])
    assert means == {0.12}
    empty = spark.createDataFrame([(None,)], "v double")
    assert empty.agg(numeric.mean("v", 2)).first()[0] is None


def test_flags_treat_unknown_as_false(spark):
    ts = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    df = spark.createDataFrame([(-1.0, 1.0), (None, 1.0), (5.0, 1.0), (-1.0, None)], "t double, w double")
    got = df.select(meteo.inversion_flag(F.col("t"), F.col("w"), ts), meteo.calm_flag(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.0, 0.0)]


def test_wind_vector(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, 90.0)], "s double, d double")
    rows = df.select(*meteo.wind_vector(F.col("s"), F.col("d"))).collect()
    assert rows[0][0] == pytest.approx(0, abs=1e-12) and rows[0][1] == pytest.approx(-2)
    assert rows[1][0] == pytest.approx(-2) and rows[1][1] == pytest.approx(0, abs=1e-12)


def test_bounding_box_never_loses_points(spark):
    rows = [(43.222 + i / 50, 76.8512 + j / 50) for i in range(-20, 21) for j in range(-20, 21)]
    df = spark.createDataFrame(rows, "a double, b double")
    d = geo.distance_m(F.col("a"), F.col("b"), 43.222, 76.8512)
    inside = df.where(d <= 25_000).count()
    box = geo.bounding_box(F.col("a"), F.col("b"), 43.222, 76.8512, 25_000)
    assert df.where(box & (d <= 25_000)).count() == inside > 0


def test_normal_quantile(spark):
    probs = [1e-12, 1e-6, 0.01, 0.07, 0.2, 0.5, 0.6, 0.93, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in probs], "p double")
    exact = statistics.NormalDist()
    for (z,), p in zip(df.select(distributions.normal_quantile(F.col("p"))).collect(), probs):
        assert z == pytest.approx(exact.inv_cdf(p), abs=1e-12)


@pytest.mark.parametrize(
    "stat, df, expected",
    [(0.0, 5, 1.0), (2.570581835636314, 5, 0.05), (1.959963984540054, 1e7, 0.05), (12.706204736174698, 1, 0.05)],
)
def test_t_tail(stat, df, expected):
    assert distributions.t_two_sided(stat, df) == pytest.approx(expected, abs=1e-6)


def test_t_tail_undefined():
    assert math.isnan(distributions.t_two_sided(1.0, 0))


def test_t_tail_column_equals_single_values(spark):
    rows = [(t, float(d)) for t in (0.0, 1e-4, 0.3, -1.0, 1.7, 1.75, -2.5, 6.0, 40.0) for d in (1, 2, 3, 7, 30, 128, 999, 54_321, 3_000_000)]
    rows += [(None, 5.0), (1.0, None), (float("nan"), 5.0), (1.0, 0.0)]
    df = spark.createDataFrame(rows, "t double, d double")
    got = df.select("t", "d", distributions.t_tail(F.col("t"), F.col("d")).alias("p")).collect()
    for t, d, p in got:
        want = distributions.t_two_sided(t, d) if d is not None else math.nan
        assert (math.isnan(p) and math.isnan(want)) or abs(p - want) <= (1e-10 if d < 1000 else 1e-8), (t, d)  # log gammas of large arguments lose digits
    near = df.select(distributions.t_tail(F.lit(1e-9), F.lit(1.0))).first()[0]
    assert abs(near - (1 - 2e-9 / math.pi)) < 1e-15  # the Cauchy tail
    assert df.select(distributions.t_tail(F.lit(float("inf")), F.lit(3.0))).first()[0] == 0.0
