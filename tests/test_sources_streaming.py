import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hourloom.operators import grid
from hourloom.settings import AIR_QUALITY_VARIABLES, ARCHIVE_VARIABLES, MEASUREMENT_SCHEMA, WIDE_POLLUTION_SCHEMA
from hourloom.sources import files, payloads
from hourloom.streaming import landing

RECORD = {
    "date": {"utc": "2024-01-01T00:00:00Z"},
    "parameter": "pm25",
    "value": 8.75,
    "unit": "ug/m3",
    "location": "Harbour",
    "city": "Somewhere",
    "country": "XX",
    "coordinates": {"latitude": 10.5, "longitude": -20.25},
}
HOURLY = {"hourly": {name: [1.5 * i, 1.5 * i + 1] for i, name in enumerate(ARCHIVE_VARIABLES)}}
HOURLY["hourly"]["time"] = ["2024-01-01T00:00", "2024-01-01T01:00"]
HOURLY["hourly"]["wind_speed_10m"] = [6.0, None]


def put(folder, name, payload):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload))


def test_measurement_payloads(spark, tmp_path):
    put(tmp_path, "a.json", {"results": [RECORD, {**RECORD, "date": None}, {**RECORD, "value": None}]})
    put(tmp_path, "b.json", {"results": []})
    put(tmp_path, "c.json", {})
    rows = payloads.read_measurements(spark, str(tmp_path))
    assert rows.schema == MEASUREMENT_SCHEMA
    got = rows.orderBy(F.desc_nulls_last("value")).collect()
    assert [(r.ts, r.value, r.latitude) for r in got] == [
        (dt.datetime(2024, 1, 1), 8.75, 10.5), (dt.datetime(2024, 1, 1), None, 10.5),
    ]


def test_empty_payloads_give_no_rows(spark, tmp_path):
    put(tmp_path / "m", "a.json", {"results": []})
    put(tmp_path / "h", "a.json", {})
    assert payloads.read_measurements(spark, str(tmp_path / "m")).count() == 0
    assert payloads.read_hourly(spark, str(tmp_path / "h"), ARCHIVE_VARIABLES).count() == 0


def test_hourly_payload_and_zone(spark, tmp_path):
    put(tmp_path, "a.json", HOURLY)
    rows = payloads.read_hourly(spark, str(tmp_path), ARCHIVE_VARIABLES).orderBy("ts").collect()
    assert len(rows) == 2 and rows[0].ts == dt.datetime(2024, 1, 1)
    assert (rows[1].relative_humidity_2m, rows[1].wind_speed_10m) == (2.5, None)
    local = payloads.read_hourly(spark, str(tmp_path), {"temperature_2m": "temp"}, "Asia/Almaty").orderBy("ts").first()
    assert (local.ts, local.temp) == (dt.datetime(2023, 12, 31, 18), 0.0)


def test_chunks_are_pruned_by_path(spark, tmp_path):
    for day in ("2024-01-01", "2024-02-01"):
        record = {**RECORD, "date": {"utc": f"{day}T05:00:00Z"}}
        put(tmp_path, f"chunk_date={day}/p.json", {"results": [record]})
    rows = payloads.read_measurements(spark, str(tmp_path), start="2024-01-15")
    assert [r.ts.month for r in rows.collect()] == [2]
    assert "PartitionFilters: [isnotnull(chunk_date" in rows._jdf.queryExecution().executedPlan().toString()


def test_station_parameters_as_text_or_object(spark, tmp_path):
    put(
        tmp_path,
        "s.json",
        {"results": [
            {"name": "A", "parameters": [{"id": "pm25"}, "no2"]},
            {"name": "B", "parameters": ["pm10"]},
            {"parameters": []},
            {"name": "D"},
        ]},
    )
    payload = payloads.read_chunks(spark, str(tmp_path), payloads.STATION_LIST_PAYLOAD)
    got = {r.name: r.has_parameter for r in payloads.stations_with_parameter(payload, "pm25").collect()}
    assert got == {"A": True, "B": False, "Unknown": False, "D": False}


def test_json_field_default(spark):
    df = spark.createDataFrame([('{"a": {"b": 3}}',), ("{}",), (None,)], "p string")
    assert [r[0] for r in df.select(payloads.json_field("p", "$.a.b", "none")).collect()] == ["3", "none", "none"]


def test_csv_round_trip_and_guards(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, None)], WIDE_POLLUTION_SCHEMA)
    path = files.write_csv(df, str(tmp_path / "deep" / "out"))
    assert files.read_csv(spark, path, WIDE_POLLUTION_SCHEMA).collect() == df.collect()
    with pytest.raises(ValueError):
        files.write_csv(df.limit(0), path)
    assert files.read_csv(spark, path, WIDE_POLLUTION_SCHEMA).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_csv(spark, str(tmp_path / "missing"), WIDE_POLLUTION_SCHEMA)


def test_parquet_layout_prunes_months(spark, tmp_path):
    rows = [(dt.datetime(2024, m, 1), float(m)) for m in range(1, 7)]
    path = files.write_parquet(spark.createDataFrame(rows, "ts timestamp_ntz, v double"), str(tmp_path / "t"), ts="ts")
    back = files.read_parquet(spark, path).where("year = 2024 and month = 3")
    assert [r.v for r in back.collect()] == [3.0]
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()


def test_manifest(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), 1.0 if h else None, None) for h in range(3)]
    df = spark.createDataFrame(rows, WIDE_POLLUTION_SCHEMA)
    manifest = files.dataset_manifest(df, ["pm25", "pm10"], extra={"source": "test"})
    path = files.write_manifest(manifest, str(tmp_path / "manifest"))
    row = spark.read.json(path).first()
    assert (row.retrieved_rows, row.missing_pm25, row.missing_pm10, row.source) == (3, 1, 3, "test")
    assert row["columns"] == "ts,pm25,pm10"


def test_new_chunks_are_landed_once(spark, tmp_path):
    inbox, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    first = {**RECORD, "date": {"utc": "2024-01-01T05:00:00Z"}}
    put(tmp_path / "in", "1.json", {"results": [first]})

    def land():
        landing.append_new_chunks(landing.stream_measurements(spark, inbox), table, mark).awaitTermination()
        return spark.read.parquet(table).count()

    assert land() == 1
    assert land() == 1
    put(tmp_path / "in", "2.json", {"results": [first, {**first, "parameter": "pm10"}]})
    assert land() == 3


def test_stream_hourly(spark, tmp_path):
    inbox, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    block = {"hourly": {"time": ["2024-01-01T00:00"], **{k: [1.0] for k in AIR_QUALITY_VARIABLES}}}
    put(tmp_path / "in", "1.json", block)
    landing.append_new_chunks(landing.stream_hourly(spark, inbox, AIR_QUALITY_VARIABLES), table, mark).awaitTermination()
    assert set(AIR_QUALITY_VARIABLES.values()) <= set(spark.read.parquet(table).columns)


def test_landing_to_hourly_table(spark, tmp_path):
    records = [
        {**RECORD, "parameter": p, "value": v, "date": {"utc": f"2024-01-01T0{h}:10:00Z"}}
        for p, v, h in (("pm25", 10.0, 0), ("pm10", 20.0, 0), ("pm25", 30.0, 2))
    ]
    put(tmp_path, "a.json", {"results": records})
    hourly = grid.hourly_wide(payloads.read_measurements(spark, str(tmp_path)), ["pm25", "pm10"])
    rows = grid.with_timestamp(hourly).orderBy("ts").collect()
    assert [(r.ts.hour, r.pm25, r.pm10) for r in rows] == [(0, 10.0, 20.0), (1, None, None), (2, 30.0, None)]
