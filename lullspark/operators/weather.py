"""Weather aggregates over a fixed grid of points.

Radiation is averaged over the southern points and wind over the northern ones;
the two bands overlap. One grouped pass takes both and the wind directions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.functions import clock, indices

# Fixed values.
SOUTH_BELOW_LAT = 52
NORTH_ABOVE_LAT = 51
GRID_POINTS = 12
OCTANTS = ["north", "north_east", "east", "south_east", "south", "south_west", "west", "north_west"]
LEADS = ["", "_previous_day1", "_previous_day2", "_previous_day3"]

MEAN = "decimal(6,3)"


def _south(col: str | Column) -> Column:
    return F.when(F.col("lat") < SOUTH_BELOW_LAT, F.col(col) if isinstance(col, str) else col)


def _north(col: str | Column) -> Column:
    return F.when(F.col("lat") > NORTH_ABOVE_LAT, F.col(col) if isinstance(col, str) else col)


def _min_avg_max(banded: Column, name: str) -> list[Column]:
    return [
        F.min(banded).alias(f"{name}_min"),
        F.avg(banded).cast(MEAN).alias(f"{name}_avg"),
        F.max(banded).alias(f"{name}_max"),
    ]


def octant_counts(direction: str = "wind_direction_100m", north_and: bool = False) -> list[Column]:
    """Rows per 45-degree sector ``(lo, hi]``; north wraps around zero.

    ``north_and`` keeps the daily slip of asking for both ends at once, which
    never holds.
    """
    d = F.col(direction)
    out = []
    for i, name in enumerate(OCTANTS):
        lo, hi = 45.0 * i - 22.5, 45.0 * i + 22.5
        if i == 0:
            above, below = d > F.lit(360 + lo), d <= F.lit(hi)
            hit = (above & below) if north_and else (above | below)
        else:
            hit = (d > F.lit(lo)) & (d <= F.lit(hi))
        out.append(F.count_if(hit).alias(f"n_{name}"))
    return out


def dominant_direction() -> Column:
    """Octant with most rows; the first in compass order wins a tie."""
    counts = [F.col(f"n_{name}") for name in OCTANTS]
    top = F.greatest(*counts)
    out = F
    for name, n in zip(OCTANTS, counts):
        out = out.when(top == n, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def direction_uniformity(slots: int) -> Column:
    top = F.greatest(*[F.col(f"n_{name}") for name in OCTANTS])
    return F.round(top / F.lit(slots).cast("decimal(5,1)"), 2).cast("decimal(3,2)")


def bucketed(points: DataFrame, freq: str, date_ms: str = "date_ms", tz: str = clock.BERLIN) -> DataFrame:
    """Adds ``date_ms`` of the bucket: the instant itself, or the local day's start."""
    if freq == "hour":
        return points.withColumn("date_ms", F.col(date_ms))
    if freq != "day":
        raise ValueError(f"unknown frequency: {freq!r}")
    local_day = F.from_utc_timestamp(F.timestamp_millis(date_ms), tz)
    wall = F.unix_millis(local_day)
    midnight = wall - F.pmod(wall, F.lit(clock.DAY_MS))
    return points.withColumn("date_ms", F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(midnight), tz)))


def aggregate_weather(
    points: DataFrame,
    freq: str = "hour",
    date_ms: str = "date_ms",
    tz: str = clock.BERLIN,
    compat: bool = False,
    null_wind: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Radiation, wind and direction statistics and the five indices per bucket.

    Buckets without a point in either band are left out, as an inner join of the
    three parts would.
    """
    slots = GRID_POINTS * (24 if freq == "day" else 1)
    stats = (
        bucketed(points, freq, date_ms, tz)
        .groupBy(*keys, "date_ms")
        .agg(
            *_min_avg_max(_south("direct_radiation"), "direct_radiation"),
            *_min_avg_max(_south("diffuse_radiation"), "diffuse_radiation"),
            *_min_avg_max(_south("temperature_2m"), "temp2m"),
            *_min_avg_max(_north("wind_speed_10m"), "wind_speed_10"),
            *_min_avg_max(_north("wind_speed_100m"), "wind_speed_100"),
            *octant_counts(north_and=compat and freq == "day"),
            F.count_if(F.col("lat") < SOUTH_BELOW_LAT).alias("_south"),
            F.count_if(F.col("lat") > NORTH_ABOVE_LAT).alias("_north"),
        )
        .where((F.col("_south") > 0) & (F.col("_north") > 0))
    )
    w, d, f = F.col("wind_speed_100_avg"), F.col("direct_radiation_avg"), F.col("diffuse_radiation_avg")
    return stats.withColumns(
        {
            "wind_direction": dominant_direction(),
            "wind_dir_uniformity": direction_uniformity(slots),
            "resolution": F.lit(freq),
            "repi_30mix": indices.repi_30mix(F.col("wind_speed_100_max"), d, f),
            "repi_power1avg": indices.repi_power1avg(w, d, f, null_wind),
            "repi_power1avg2": indices.repi_power1avg2(w, d, f, null_wind),
            "repi_power_exp": indices.repi_power_exp(w, d, f),
            "repi_square1avg": indices.repi_square1avg(w, d, f, null_wind),
        }
    ).drop("_south", "_north", *[f"n_{name}" for name in OCTANTS])


def weather_history(points: DataFrame, **options) -> DataFrame:
    """Hourly and daily aggregates in one table."""
    return aggregate_weather(points, "hour", **options).unionByName(aggregate_weather(points, "day", **options))


FORECAST_KEYS = ["timestamp_s", "model", "temporal_resolution"]


def aggregate_forecast(points: DataFrame, null_wind: bool = False) -> DataFrame:
    """Forecast radiation, wind and indices per instant and model, lead 0 to 3 days."""
    aggs: list[Column] = []
    for source, short in [("direct_radiation", "direct_radiation"), ("diffuse_radiation", "diffuse_radiation"),
                          ("temperature_2m", "temp2m")]:
        aggs += [F.min(_south(source)).alias(f"{short}_min"), F.max(_south(source)).alias(f"{short}_max")]
        for lead in LEADS:
            name = f"{source}_avg{lead}" if lead else f"{short}_avg"
            aggs.append(F.avg(_south(f"{source}{lead}")).cast(MEAN).alias(name))
    heights = (80, 120, 180)
    for height in heights:
        for lead in LEADS:
            speed = _north(f"wind_speed_{height}m{lead}")
            # All digits: the 100 m wind is interpolated from these means.
            aggs.append(F.avg(speed.cast("double")).alias(f"_w{height}{lead}"))
            if lead:
                aggs.append(F.avg(speed).cast(MEAN).alias(f"wind_speed_{height}m_avg{lead}"))
    aggs += [
        F.count_if(F.col("lat") < SOUTH_BELOW_LAT).alias("_south"),
        F.count_if(F.col("lat") > NORTH_ABOVE_LAT).alias("_north"),
    ]
    stats = points.groupBy(*FORECAST_KEYS).agg(*aggs).where((F.col("_south") > 0) & (F.col("_north") > 0))
    wind = {f"wind_speed_{height}m_avg": F.col(f"_w{height}") for height in heights}
    for lead in LEADS:
        hub = indices.wind_at_height(F.col(f"_w80{lead}"), F.col(f"_w120{lead}"))
        wind[f"wind_100m_log{lead}"] = hub.cast(MEAN)
    out = stats.withColumns(wind)
    scores = {}
    for lead in LEADS:
        w = F.col(f"wind_100m_log{lead}")
        d, f = F.col(f"direct_radiation_avg{lead}"), F.col(f"diffuse_radiation_avg{lead}")
        scores[f"repi_power1avg2{lead}"] = indices.repi_power1avg2(w, d, f, null_wind)
        scores[f"repi_power_exp{lead}"] = indices.repi_power_exp(w, d, f)
    hidden = [f"_w{height}{lead}" for height in heights for lead in LEADS]
    return out.withColumns(scores).drop("_south", "_north", *hidden)


def wind_model_comparison(points: DataFrame) -> DataFrame:
    """100 m wind per model and point from two heights and from three.

    The three-height profile is null for a model without 180 m winds.
    """
    place = ["model", "lat", "lng"]
    w80, w120, w180 = F.col("_w80"), F.col("_w120"), F.col("_w180")
    means = points.groupBy(*place).agg(*[F.avg(F.col(f"wind_speed_{h}m").cast("double")).alias(f"_w{h}") for h in (80, 120, 180)])
    alpha = indices.mean_shear_exponent(w80, w120, w180)
    return means.select(
        *place,
        alpha.alias("alpha_avg"),
        F.round(indices.wind_at_height(w80, w120).cast(MEAN), 2).alias("wind_speed_80_120_log"),
        F.round(indices.wind_by_exponent(w80, alpha).cast(MEAN), 2).alias("wind_speed_80_120_180_log_avg"),
    ).orderBy("alpha_avg").drop("alpha_avg")


def live_index(points: DataFrame, keys: Sequence[str] = ("timestamp_s",)) -> DataFrame:
    """Production index per instant from a live forecast.

    Here the wind is interpolated per point and then averaged; the forecast
    aggregate averages first. The results differ.
    """
    hub = indices.wind_at_height(F.col("wind_speed_80m"), F.col("wind_speed_120m"))
    means = points.groupBy(*keys).agg(
        F.avg(_north(hub)).alias("_w"),
        F.avg(_south("direct_radiation")).alias("_d"),
        F.avg(_south("diffuse_radiation")).alias("_f"),
    )
    return means.select(*keys, indices.live_index(F.col("_w"), F.col("_d"), F.col("_f")).alias("repi"))
