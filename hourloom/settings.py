"""Fixed values shared across the package: schemas, guideline levels, feature and model parameters."""

from pyspark.sql import types as T

# --- Fixed values: place and time -------------------------------------------------------------
LOCAL_ZONE = "Asia/Almaty"
CENTRE_LATITUDE = 43.2220
CENTRE_LONGITUDE = 76.8512
SEARCH_RADIUS_M = 25_000.0
RANDOM_SEED = 42

# --- Fixed values: guideline concentrations (24-hour mean, annual mean) -------------------------
GUIDELINES = {
    "pm25": {"daily": 15.0, "annual": 5.0},
    "pm10": {"daily": 45.0, "annual": 15.0},
}

# --- Fixed values: labels ------------------------------------------------------------------------
WEEKDAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- Fixed values: feature parameters -------------------------------------------------------------
TARGET_LAGS = [1, 2, 3, 6, 12, 24, 48, 168]
WEATHER_LAGS = [1, 3, 6, 24]
STATION_LAGS = [1, 6, 24]
HORIZONS = [1, 6, 12, 24]
HEATING_MONTHS = [10, 11, 12, 1, 2, 3]
WINTER_MONTHS = [12, 1, 2]
CALM_WIND = 1.5
INVERSION_WIND = 2.0

# --- Fixed values: station feed renames ------------------------------------------------------------
STATION_COLUMNS = {
    "temp": "ms_temp",
    "dwpt": "ms_dewpoint",
    "rhum": "ms_humidity",
    "prcp": "ms_precip",
    "wdir": "ms_wind_dir",
    "wspd": "ms_wind_spd",
    "wpgt": "ms_wind_gust",
    "pres": "ms_pressure",
}
STATION_KMH_COLUMNS = ["ms_wind_spd", "ms_wind_gust"]
KMH_PER_MS = 3.6

# --- Fixed values: hourly payload variable names ----------------------------------------------------
AIR_QUALITY_VARIABLES = {
    "pm2_5": "pm25",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "ozone": "o3",
    "sulphur_dioxide": "so2",
    "carbon_monoxide": "co",
    "aerosol_optical_depth": "aod",
    "dust": "dust",
}
REANALYSIS_VARIABLES = {
    "temperature_2m": "temp",
    "relative_humidity_2m": "humidity",
    "wind_speed_10m": "wind_spd",
    "wind_direction_10m": "wind_dir",
    "wind_gusts_10m": "wind_gust",
    "surface_pressure": "pressure",
    "precipitation": "precip",
    "cloud_cover": "cloud",
    "boundary_layer_height": "blh",
}
ARCHIVE_VARIABLES = [
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "surface_pressure",
    "wind_speed_10m",
    "wind_direction_10m",
]

# --- Schemas ------------------------------------------------------------------------------------------
MEASUREMENT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("parameter", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

WIDE_POLLUTION_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("pm25", T.DoubleType()),
        T.StructField("pm10", T.DoubleType()),
    ]
)
