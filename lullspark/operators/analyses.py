"""Yearly curves, rankings, extremes, coverage and data checks.

Windows by ``(region, resolution, year)`` are bounded: an instant occurs once per
series, so a year holds at most 35 136 quarter hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullspark.functions import clock
from lullspark.registry import KEYS

TS = "unix_timestamp_ms"
SERIES = ["region", "resolution"]


def _with_year(df: DataFrame, tz: str, ts: str = TS) -> DataFrame:
    return df.withColumn("year", clock.local_year(F.col(ts), tz))


def price_duration_curve(market: DataFrame, price: str = "market_price_ger_lux", tz: str = "UTC") -> DataFrame:
    """Prices of every year from highest to lowest, numbered from 1."""
    year = Window.partitionBy(*SERIES, "year").orderBy(F.col(price).desc(), F.col(TS))
    priced = _with_year(market.where(F.col(price).isNotNull()).select(*KEYS, price), tz)
    return priced.withColumn("rank", F.row_number().over(year))


def align_by_rank(
    ranked: DataFrame, years: Sequence[int], value: str = "market_price_ger_lux", keys: Sequence[str] = SERIES
) -> DataFrame:
    """One row per rank, one column per year; the shortest year ends the table."""
    columns = [F.max(F.when(F.col("year") == y, F.col(value))).alias(f"price{y}") for y in years]
    seen = [F.max(F.when(F.col("year") == y, F.lit(1))).alias(f"_has{y}") for y in dict.fromkeys(years)]
    wide = ranked.where(F.col("year").isin(list(years))).groupBy(*keys, "rank").agg(*columns, *seen)
    flags = [f"_has{y}" for y in dict.fromkeys(years)]
    return wide.dropna(subset=flags).drop(*flags)


def share_with_price(share_rows: DataFrame, market: DataFrame, share: str, price: str) -> DataFrame:
    """Share and price of the same key."""
    return share_rows.select(*KEYS, share).join(market.select(*KEYS, price), KEYS)


def surplus_ranking(
    share_rows: DataFrame,
    market: DataFrame,
    share: str = "share_of_photovoltaic_wind_onshore_offshore_computed",
    price: str = "market_price_ger_lux",
    at_least: float = 1.0,
    tz: str = "UTC",
    label_tz: str = clock.BERLIN,
) -> DataFrame:
    """Instants whose share covers the load, ranked by price within their year."""
    full = share_with_price(share_rows.where(F.col(share) >= at_least), market.where(F.col(price).isNotNull()), share, price)
    year = Window.partitionBy(*SERIES, "year").orderBy(F.col(price).desc(), F.col(TS))
    return _with_year(full, tz).select(
        *KEYS,
        price,
        clock.local_label(F.col(TS), "MM/dd HH:mm", label_tz).alias("date"),
        F.row_number().over(year).alias("hour"),
        "year",
        F.col(share).alias("size"),
    )


def yearly_extremes(
    market: DataFrame, value: str = "power_consumption_total", tz: str = "UTC", label_tz: str = clock.BERLIN,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Rows holding the largest or smallest value of their year.

    The two bounds of a year are aggregated first and joined back, so no year has
    to be gathered in one place.
    """
    rows = _with_year(market.select(*KEYS, value, *carry), tz)
    bounds = rows.groupBy(*SERIES, "year").agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    hit = rows.join(bounds, [*SERIES, "year"]).where((F.col(value) == F.col("_hi")) | (F.col(value) == F.col("_lo")))
    return hit.select(
        *KEYS, value, "year", clock.local_label(F.col(TS), tz=label_tz).alias("date"), *carry
    ).orderBy(value)


def yearly_peak(market: DataFrame, value: str = "power_consumption_residual_load", tz: str = "UTC") -> DataFrame:
    return (
        _with_year(market.select(*KEYS, value), tz)
        .groupBy(*SERIES, "year")
        .agg(F.max(value).alias("peak"))
        .orderBy("year")
    )


def yearly_energy(
    market: DataFrame, years: Sequence[int], value: str = "power_consumption_total", tz: str = "UTC"
) -> DataFrame:
    """Energy of the listed years in millions of the unit (MWh to TWh)."""
    rows = _with_year(market.select(*KEYS, value), tz).where(F.col("year").isin(list(years)))
    return rows.groupBy(*SERIES, "year").agg((F.sum(value) / F.lit(1_000_000)).alias("energy"))


def series_coverage(market: DataFrame, price: str = "market_price_ger_lux", tz: str = clock.BERLIN) -> DataFrame:
    """Row count, first and last instant of all rows and of the priced rows."""
    ts = F.col(TS)
    priced = F.when(F.col(price).isNotNull(), ts)
    stats = market.groupBy(*SERIES).agg(
        F.count(ts).alias("n_all"), F.min(ts).alias("lo_all"), F.max(ts).alias("hi_all"),
        F.count(priced).alias("n_priced"), F.min(priced).alias("lo_priced"), F.max(priced).alias("hi_priced"),
    )
    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("rows"),
                F.col(f"n_{name}").alias("n"),
                clock.local_label(F.col(f"lo_{name}"), tz=tz).alias("first"),
                clock.local_label(F.col(f"hi_{name}"), tz=tz).alias("last"),
            )
            for name in ("all", "priced")
        ]
    )
    return stats.select(*SERIES, F.inline(parts))


def earliest_k(df: DataFrame, k: int, keys: Sequence[str], ts: str = TS) -> DataFrame:
    """First ``k`` rows per series; rows of one instant follow their other columns.

    The limit on the row number is also applied before the shuffle, so each task
    sends at most ``k`` rows of a series.
    """
    keys = list(keys)
    order = [ts, *[c for c in df.columns if c not in (ts, *keys)]]
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_r") <= k).drop("_r")


def duplicate_instants(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def availability_matrix(
    long: DataFrame, registry: DataFrame, series: str, axes: dict[str, Sequence[str]]
) -> DataFrame:
    """Which (series, region, resolution) combinations the feed has.

    ``axes`` lists the allowed values of each further key; the grid is the registry
    times those short lists, however long the feed is.
    """
    grid = registry.select(series)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = [series, *axes]
    present = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    return grid.join(present, keys, "left").select(
        *keys, F.col("n_points").isNotNull().alias("available"), F.coalesce("n_points", F.lit(0)).alias("n_points")
    )


def _fraction_digits(value: Column) -> Column:
    """Digits after the point of the plain decimal notation, trailing zeros cut.

    An exponent moves the point, so digits are counted at any size of the value.
    """
    text = value.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.coalesce(F.try_to_number(F.regexp_extract(text, r"E-?(\d+)$", 1), F.lit("999")), F.lit(0)).cast("int")
    moved = F.when(text.contains("E-"), exponent).otherwise(-exponent)
    digits = F.length(F.regexp_extract(mantissa, r"\.(\d*?)0*$", 1))
    return F.when(value == 0, F.lit(0)).when(value.isNotNull(), F.greatest(digits + moved, F.lit(0)))


def value_profile(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Largest value and most fractional digits per series, for choosing types."""
    return long.groupBy(*keys).agg(
        F.max(value).alias("max_value"), F.max(_fraction_digits(F.col(value))).alias("max_fraction_digits")
    )


def event_feature_matrix(
    events: DataFrame,
    x: str,
    y: str,
    size: str,
    color: str,
    min_duration_days: float = 0,
    keys: Sequence[str] = ("start_time",),
) -> DataFrame:
    """Four chosen features per event, beside its ``keys``, for a bubble chart; missing values are 0."""
    kept = events.where(F.col("duration_days") >= min_duration_days)

    def feature(name: str) -> Column:
        if name not in kept.columns:
            return F.lit(0.0)
        value = F.col(name).cast("double")
        return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))

    return kept.select(
        *keys,
        feature(x).alias("x"),
        feature(y).alias("y"),
        feature(size).alias("z"),
        feature(color).alias("color"),
        "duration_days",
    )
