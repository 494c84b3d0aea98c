"""Indices, octants, aggregates and landed weather documents."""

import json
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lullspark.functions import indices
from lullspark.operators import weather
from lullspark.sources import weather as docs


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).cast("decimal(6,3)").alias(k) for k, v in cols.items()])


def test_index_values(spark):
    df = one(spark, w=10, m=12, d=100, f=50)
    w, m, d, f = (F.col(c) for c in "wmdf")
    got = df.select(
        indices.repi_30mix(m, d, f), indices.repi_power1avg(w, d, f), indices.repi_power1avg2(w, d, f),
        indices.repi_power_exp(w, d, f), indices.repi_square1avg(w, d, f),
    ).first()
    assert [str(v) for v in got] == ["17.00", "1150.00", "1300.00", "1189.79", "250.00"]


def test_index_cap_and_missing_wind(spark):
    df = one(spark, w=15, z=0, n=None)
    w, z, n = (F.col(c) for c in "wzn")
    got = df.select(
        indices.repi_power1avg(w, z, z), indices.repi_square1avg(w, z, z), indices.repi_power1avg(n, z, z),
        indices.repi_power1avg(n, z, z, null_wind=True), indices.repi_power_exp(n, z, z),
    ).first()
    assert [v and str(v) for v in got] == ["1331.00", "121.00", "1331.00", None, None]


def test_wind_at_height(spark):
    df = spark.createDataFrame([(8.0, 8.0), (0.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(indices.wind_at_height(F.col("a"), F.col("b"))).collect()] == [8.0, None]


@pytest.mark.parametrize("degree,name", [(0, "north"), (22.5, "north"), (360, "north"), (337.5, "north_west"), (22.6, "north_east"), (180, "south")])
def test_octants(spark, degree, name):
    df = spark.createDataFrame([(float(degree),)], "wind_direction_100m double")
    counted = df.groupBy().agg(*weather.octant_counts())
    assert counted.select(weather.dominant_direction()).first()[0] == name


def test_direction_tie(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(90.0,)] * 6, "wind_direction_100m double")
    row = df.groupBy().agg(*weather.octant_counts()).select(weather.dominant_direction(), weather.direction_uniformity(12)).first()
    assert tuple(row) == ("north", Decimal("0.50"))


def grid(spark, hours):
    data = []
    for h in hours:
        for lat in (47.98, 50.02, 51.99, 54.02):
            for i in range(3):
                data.append((h * 3_600_000, lat, 5.0 + lat / 10, 6.0, 8.0 + i, 0.0, 100.0, 50.0))
    return spark.createDataFrame(
        data,
        "date_ms long, lat double, temperature_2m double, wind_speed_10m double, wind_speed_100m double,"
        " wind_direction_100m double, direct_radiation double, diffuse_radiation double",
    )


def test_bands_overlap_and_days_are_local(spark):
    # 22:00 UTC of New Year's Eve 1969 is already 23:00; 23:00 UTC is the next local day.
    df = grid(spark, [22, 23])
    hourly = {r.date_ms: r for r in weather.aggregate_weather(df, "hour").collect()}
    assert set(hourly) == {22 * 3_600_000, 23 * 3_600_000}
    assert str(hourly[22 * 3_600_000].wind_speed_100_avg) == "9.000"
    assert str(hourly[22 * 3_600_000].temp2m_avg) == "10.000"
    assert str(hourly[22 * 3_600_000].wind_dir_uniformity) == "1.00"
    daily = sorted(weather.aggregate_weather(df, "day").collect(), key=lambda r: r.date_ms)
    assert [r.date_ms for r in daily] == [-3_600_000, 23 * 3_600_000]
    assert [str(r.wind_dir_uniformity) for r in daily] == ["0.04", "0.04"]
    compat = weather.aggregate_weather(df, "day", compat=True).first()
    assert compat.wind_direction == "north" and str(compat.wind_dir_uniformity) == "0.00"


def test_hours_without_a_band_are_left_out(spark):
    df = grid(spark, [1]).unionByName(grid(spark, [2]).where("lat < 51"))
    assert [r.date_ms for r in weather.aggregate_weather(df, "hour").collect()] == [3_600_000]


def test_read_history_documents(spark, tmp_path):
    names = docs.HISTORY_VARIABLES
    doc = {"latitude": 54.0, "longitude": 7.0, "elevation": 3.0, "model": 2,
           "hourly": {"start": 3600, "end": 10800, "interval": 3600, **{v: [1.5, None] for v in names}}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "latitude": 48.0, "hourly": {**doc["hourly"], names[0]: [float("nan"), 2.0]}}))
    out = docs.read_weather_history(spark, str(tmp_path))
    got = rows(out.select("lat", "date_ms", names[0], names[1]))
    assert got == [(48.0, 3_600_000, None, 1.5), (48.0, 7_200_000, 2.0, None), (54.0, 3_600_000, 1.5, 1.5), (54.0, 7_200_000, None, None)]


def test_read_forecast_documents(spark, tmp_path):
    assert len(docs.FORECAST_VARIABLES) == 44
    doc = {"latitude": 54.0, "longitude": 7.0, "elevation": 3.0, "model": "icon_eu",
           "hourly": {"start": 0, "end": 3600, "interval": 3600, **{v: [2.0, 3.0] for v in docs.FORECAST_VARIABLES}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    out = docs.read_weather_forecast(spark, str(tmp_path)).collect()
    assert len(out) == 1 and out[0].timestamp_s == 0 and out[0].wind_speed_180m_previous_day3 == 2.0


def test_live_index_interpolates_before_averaging(spark, tmp_path):
    hourly = {"time": [0, 3600], "wind_speed_80m": [8.0, 8.0], "wind_speed_120m": [8.0, 12.0],
              "direct_radiation": [10.0, 0.0], "diffuse_radiation": [5.0, 0.0]}
    spots = [{"latitude": lat, "longitude": 7.0, "hourly": hourly} for lat in (54.0, 48.0)]
    (tmp_path / "live.json").write_text(json.dumps(spots))
    out = rows(weather.live_index(docs.read_live_forecast(spark, str(tmp_path))))
    import math

    hub = 8.0 * 1.25 ** (math.log(12 / 8) / math.log(1.5))
    assert out == [(0, 542.0), (3600, round(hub**3, 2))]


def test_model_comparison_is_null_without_the_top_height(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, 8.0, 9.0, 10.0), ("g", 1.0, 2.0, 8.0, 8.0, None)],
        "model string, lat double, lng double, wind_speed_80m double, wind_speed_120m double, wind_speed_180m double",
    )
    got = {r.model: r for r in weather.wind_model_comparison(df).collect()}
    assert got["g"].wind_speed_80_120_180_log_avg is None and str(got["g"].wind_speed_80_120_log) == "8.00"
    assert got["a"].wind_speed_80_120_180_log_avg is not None
