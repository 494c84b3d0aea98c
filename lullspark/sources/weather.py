"""Landed weather documents: parallel arrays per grid point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
HISTORY_VARIABLES = [
    "temperature_2m", "wind_speed_10m", "wind_speed_100m", "wind_direction_10m", "wind_direction_100m",
    "direct_radiation", "diffuse_radiation",
]
FORECAST_BASES = [
    "temperature_2m", "wind_speed_10m", "wind_direction_10m", "direct_radiation", "diffuse_radiation",
    "wind_speed_80m", "wind_speed_120m", "wind_speed_180m",
    "wind_direction_80m", "wind_direction_120m", "wind_direction_180m",
]
LEAD_DAYS = [0, 1, 2, 3]
LIVE_VARIABLES = ["wind_speed_80m", "wind_speed_120m", "direct_radiation", "diffuse_radiation"]

FORECAST_VARIABLES = [f"{b}_previous_day{d}" if d else b for b in FORECAST_BASES for d in LEAD_DAYS]


def _hourly_schema(variables: Sequence[str], time: str) -> str:
    return "struct<" + ", ".join([time, *[f"{v}: array<double>" for v in variables]]) + ">"


def read_gridded(
    spark: SparkSession, path: str, variables: Sequence[str], model_type: str, lines: bool = False
) -> DataFrame:
    """Rows from ``{latitude, longitude, elevation, model, hourly: {start, end, interval, <arrays>}}``.

    Row ``i`` stands for ``start + i * interval`` seconds, strictly before ``end``.
    NaN counts as missing. ``lines`` reads one document per line.
    """
    schema = (
        f"latitude double, longitude double, elevation double, model {model_type}, "
        f"hourly {_hourly_schema(variables, 'start: bigint, end: bigint, interval: bigint')}"
    )
    documents = spark.read.schema(schema).options(multiLine=not lines, allowNonNumericNumbers="true").json(path)
    zipped = F.arrays_zip(*[F.col(f"hourly.{v}").alias(v) for v in variables])
    rows = documents.select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        "elevation",
        "model",
        F.col("hourly.start").alias("_start"),
        F.col("hourly.end").alias("_end"),
        F.col("hourly.interval").alias("_step"),
        F.posexplode(zipped).alias("_i", "_v"),
    )
    at = F.col("_start") + F.col("_i") * F.col("_step")
    return rows.where(at < F.col("_end")).select(
        at.alias("timestamp_s"),
        "lat",
        "lng",
        "elevation",
        "model",
        F.lit("hour").alias("temporal_resolution"),
        *[F.nanvl(F.col(f"_v.{v}"), F.lit(None).cast("double")).cast("float").alias(v) for v in variables],
    )


def read_weather_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Seven hourly variables per grid point with the instant as ``date`` and ``date_ms``."""
    rows = read_gridded(spark, path, HISTORY_VARIABLES, "int", lines)
    return rows.withColumns(
        {"date": F.timestamp_seconds("timestamp_s"), "date_ms": F.col("timestamp_s") * F.lit(1000)}
    ).drop("timestamp_s")


def read_weather_forecast(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Eleven variables at leads of 0 to 3 days per grid point and model."""
    return read_gridded(spark, path, FORECAST_VARIABLES, "string", lines)


def live_schema() -> str:
    return f"latitude double, longitude double, hourly {_hourly_schema(LIVE_VARIABLES, 'time: array<bigint>')}"


def live_rows(documents: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One row per point and instant, with the document's columns ``more``."""
    zipped = F.arrays_zip(*[F.col(f"hourly.{v}").alias(v) for v in ["time", *LIVE_VARIABLES]])
    return documents.select(
        *more, F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), F.inline(zipped)
    ).withColumnRenamed("time", "timestamp_s")


def read_live_forecast(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A list of points, each with parallel arrays ``time[]`` and variables."""
    return live_rows(spark.read.schema(live_schema()).options(multiLine=not lines).json(path))
