import datetime as dt
import json

import pytest
from frames import ar_daily
from pyspark.sql import functions as F

from hourloom.operators.grid import with_timestamp
from hourloom.plans import models, pipelines
from hourloom.settings import CENTRE_LATITUDE, CENTRE_LONGITUDE, WIDE_POLLUTION_SCHEMA


def record(parameter, value, hour, latitude=CENTRE_LATITUDE):
    return {
        "date": {"utc": f"2024-01-01T{hour:02d}:15:00Z"},
        "parameter": parameter,
        "value": value,
        "coordinates": {"latitude": latitude, "longitude": CENTRE_LONGITUDE},
    }


def test_land_pollution(spark, tmp_path):
    records = [record("pm25", 4.0, 0), record("pm25", 6.0, 0), record("pm10", 9.0, 3), record("pm25", 500.0, 1, 50.0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "chunk.json").write_text(json.dumps({"results": records}))
    table, manifest = str(tmp_path / "table"), str(tmp_path / "manifest")
    landed = pipelines.land_pollution(spark, str(tmp_path / "in"), table, manifest)
    assert [f.dataType for f in landed.schema] == [f.dataType for f in WIDE_POLLUTION_SCHEMA]
    assert [(r.ts.hour, r.pm25, r.pm10) for r in landed.orderBy("ts").collect()] == [
        (0, 5.0, None), (1, None, None), (2, None, None), (3, None, 9.0),
    ]
    row = spark.read.json(manifest).first()
    assert (row.retrieved_rows, row.missing_pm25, row.missing_pm10) == (4, 3, 3)


def test_land_refuses_nothing(spark, tmp_path):
    (tmp_path / "chunk.json").write_text(json.dumps({"results": []}))
    with pytest.raises(ValueError):
        pipelines.land_pollution(spark, str(tmp_path), str(tmp_path / "t"), str(tmp_path / "m"))


def test_sources_to_scores(spark):
    base = with_timestamp(ar_daily(spark, 700)).drop("hour_index")
    air = base.select("ts", "pm25", "pm10")
    weather = base.select("ts", "temp", "wind_spd", "wind_dir", "humidity", "blh")
    gap = dt.datetime(2024, 1, 10, 5)
    weather = weather.where(F.col("ts") != F.lit(gap).cast("timestamp_ntz"))
    station = base.select("ts", (F.col("temp") + 1).alias("ms_temp")).where(F.hour("ts") % 3 == 0)
    grid = pipelines.join_sources(air, weather, station)
    assert grid.count() == 700
    row = with_timestamp(grid).where(F.col("ts") == F.lit(gap).cast("timestamp_ntz")).first()
    assert row.pm25 is None and row.temp is None
    table, features = pipelines.build_features(grid, "pm25")
    assert {"temp_bias", "ms_temp_lag_6", "pm25_lag_168", "target_24h"} <= set(table.columns)
    metrics, tests = pipelines.score_horizons(
        {"pm25": (table, features)}, [1, 6], models.horizon_models(trees=3, rounds=2, maxDepth=3)
    )
    assert metrics.count() == 2 * 4 and tests.count() == 2
    scores = {(r.horizon, r.model): r.rmse for r in metrics.collect()}
    assert scores[("1h", "Ridge")] < scores[("1h", "Naive baseline")]
