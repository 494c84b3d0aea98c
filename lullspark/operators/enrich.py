"""Load, price, cost, calendar and weather statistics of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.functions import clock
from lullspark.operators.intervals import aggregate_intervals

EVENT = ["threshold", "region", "resolution", "start_time", "end_time"]
WEEK_MS = 604_800_000
# Only events after Monday, 2018-10-01 00:00 local time carry prices.
PRICES_SINCE_MS = 1_538_344_800_000


def _roles(margin_ms: int) -> dict[str, tuple[Column, Column]]:
    """Closed integer-ms ranges of the parts of an event that are measured."""
    start, end = F.col("start_time"), F.col("end_time")
    return {
        "during": (start, end),
        "half_open": (start, end - 1),
        "before": (start - margin_ms, start),
        "after": (end, end + margin_ms),
    }


def _intervals(events: DataFrame, roles: dict[str, tuple[Column, Column]]) -> DataFrame:
    parts = F.array(
        *[F.struct(F.lit(name).alias("role"), lo.alias("lo"), hi.alias("hi")) for name, (lo, hi) in roles.items()]
    )
    return events.select(*EVENT, F.inline(parts))


def market_sums(
    events: DataFrame,
    market: DataFrame,
    margin_ms: int = WEEK_MS,
    price: str = "market_price_ger_lux",
    residual: str = "power_consumption_residual_load",
    total: str = "power_consumption_total",
    chunk_ms: int = clock.DAY_MS,
) -> DataFrame:
    """One row per event with the sums every statistic below is built from."""
    r, c, p = F.col(residual), F.col(total), F.col(price)
    measures = {
        "sum_r": ("sum", r),
        "n_r": ("count", r),
        "max_r": ("max", r),
        "sum_c": ("sum", c),
        "sum_p": ("sum", p),
        "n_p": ("count", p),
        "sum_cp": ("sum", c * p),
        "sum_rp": ("sum", r * p),
        "sum_p_of_r": ("sum", F.when(r.isNotNull(), p)),
    }
    around = ["sum_r", "sum_c", "sum_cp", "sum_p", "n_p"]
    wanted = {"half_open": ["sum_r"], "before": around, "after": around, "during": list(measures)}
    return aggregate_intervals(
        _intervals(events, _roles(margin_ms)),
        market.where(p.isNotNull()),
        EVENT,
        ["region", "resolution"],
        measures,
        wanted,
        chunk_ms=chunk_ms,
    )


def _ratio(part: Column, whole: Column) -> Column:
    """Exact decimals keep 12 digits after the point, doubles stay doubles."""
    return F.try_divide(part, whole)


def _narrow(df: DataFrame) -> DataFrame:
    """Leave Spark room for the digits of quotients of large decimal sums."""
    kinds = {"sum_cp": "decimal(28,4)", "sum_rp": "decimal(28,4)", "sum_c": "decimal(20,2)", "sum_p": "decimal(20,2)"}
    casts = {}
    for name, dtype in df.dtypes:
        for suffix, kind in kinds.items():
            if name.endswith(suffix) and dtype.startswith("decimal"):
                casts[name] = F.col(name).cast(kind)
    return df.withColumns(casts)


def load_stats(sums: DataFrame, margin_ms: int = WEEK_MS) -> DataFrame:
    """Energy and power columns (residual load in MWh per step, power in MW)."""
    hours = F.expr(f"(end_time - start_time) div {clock.HOUR_MS}L")
    both_hours = 2 * margin_ms // clock.HOUR_MS
    return sums.withColumns(
        {
            "duration": F.col("end_time") - F.col("start_time"),
            "avg_res_load_power_during": F.round(_ratio(F.col("half_open_sum_r"), hours), 2),
            "res_load_week_before": F.col("before_sum_r"),
            "res_load_week_after": F.col("after_sum_r"),
            "peak_res_load_power_during": F.col("during_max_r") * clock.steps_per_hour(F.col("resolution")),
            "energy_consumption_during": F.col("during_sum_c"),
            "avg_res_load_power_before_after": F.round(
                (F.col("before_sum_r") + F.col("after_sum_r")) / F.lit(both_hours), 2
            ),
        }
    )


def price_stats(sums: DataFrame) -> DataFrame:
    """Plain and consumption-weighted mean prices during, before and after."""
    s = _narrow(sums)

    def weighted(role: str) -> Column:
        return _ratio(F.col(f"{role}_sum_cp"), F.col(f"{role}_sum_c"))

    def plain(role: str) -> Column:
        return _ratio(F.col(f"{role}_sum_p"), F.col(f"{role}_n_p")).cast("decimal(6,2)")

    return s.withColumns(
        {
            "avg_weighted_price_during": F.round(weighted("during"), 2),
            "avg_weighted_price_week_before": weighted("before"),
            "avg_weighted_price_week_after": weighted("after"),
            "avg_price_during": plain("during"),
            "avg_price_week_before": plain("before"),
            "avg_price_week_after": plain("after"),
        }
    )


def extent(stats: DataFrame) -> DataFrame:
    """Residual energy above the surrounding weeks' level, and its market value.

    Both are linear in the baseline, so the sums already taken are enough:
    ``sum(r - b) = sum(r) - n*b`` and ``sum((r - b)*p) = sum(r*p) - b*sum(p)``.
    """
    baseline = (
        F.col("avg_res_load_power_before_after") / clock.steps_per_hour(F.col("resolution"))
    ).cast("decimal(20,4)")
    return stats.withColumns(
        {
            "extent": (F.col("during_sum_r") - F.col("during_n_r") * baseline).cast("decimal(15,2)"),
            "storage_made_electricity_value": (
                F.col("during_sum_rp") - baseline * F.col("during_sum_p_of_r")
            ).cast("decimal(15,2)"),
        }
    )


def price_delta(stats: DataFrame) -> DataFrame:
    """Price increase against the mean of the weeks before and after."""
    plain_around = (F.col("avg_price_week_before") + F.col("avg_price_week_after")) / F.lit(2)
    wb, wa = F.col("avg_weighted_price_week_before"), F.col("avg_weighted_price_week_after")
    wd = F.col("avg_weighted_price_during")
    weighted_around = (wb + wa) / F.lit(2)

    def percent(value: Column, around: Column) -> Column:
        return F.round((F.try_divide(value, around) - F.lit(1)) * F.lit(100)).cast("decimal(7,3)")

    return stats.withColumns(
        {
            # Not rounded: halves of two-digit prices end after three digits.
            "price_increase_during": F.col("avg_price_during") - plain_around,
            "relative_price_increase_during": percent(F.col("avg_price_during"), plain_around),
            "price_increase_during_weighted": F.round(wd - weighted_around, 2),
            "relative_price_increase_during_weighted": percent(wd, weighted_around),
            "in_before_after_range": (wd > F.least(wb, wa)) & (wd < F.greatest(wb, wa)),
        }
    )


def cost(stats: DataFrame) -> DataFrame:
    energy = F.col("energy_consumption_during")
    return stats.withColumns(
        {
            "event_cost": F.round(energy * F.col("price_increase_during"), 2).cast("decimal(14,2)"),
            "event_cost_weighted": F.round(energy * F.col("price_increase_during_weighted"), 2).cast("decimal(14,2)"),
        }
    )


def calendar(events: DataFrame, tz: str = clock.BERLIN) -> DataFrame:
    """Calendar fields of the whole-second midpoint, and the duration in days."""
    middle_ms = F.expr("((start_time + end_time) div 2) div 1000 * 1000")
    middle = clock.local_datetime(middle_ms, tz)
    duration = F.col("end_time") - F.col("start_time")
    return events.withColumns(
        {
            "day_of_week": F.weekday(middle) + 1,
            "day_of_month": F.day(middle),
            "month": F.month(middle),
            "year": F.year(middle),
            "duration_ms": duration,
            "duration_days": (duration / F.lit(clock.DAY_MS).cast("decimal(10,1)")).cast("decimal(5,2)"),
        }
    )


WEATHER_MEANS = {
    "repi_power1avg": "repi_power1avg",
    "repi_power1avg2": "repi_power1avg2",
    "repi_power_exp": "repi_power_exp_avg",
    "wind_speed_100_avg": "wind_speed_100_avg",
    "diffuse_radiation_avg": "diffuse_radiation_avg",
    "direct_radiation_avg": "direct_radiation_avg",
}


def weather_stats(
    events: DataFrame,
    weather: DataFrame,
    date_ms: str = "date_ms",
    keys: Sequence[str] = (),
    chunk_ms: int = clock.DAY_MS,
) -> DataFrame:
    """Hourly weather strictly between the whole seconds of start and end."""
    hourly = weather.where(F.col("resolution") == "hour").drop("resolution")
    measures = {f"s_{c}": ("sum", F.col(c)) for c in WEATHER_MEANS}
    measures |= {f"n_{c}": ("count", F.col(c)) for c in WEATHER_MEANS}
    measures |= {"hi_exp": ("max", F.col("repi_power_exp")), "lo_exp": ("min", F.col("repi_power_exp"))}
    spans = events.select(
        *EVENT,
        F.expr("start_time div 1000 * 1000 + 1").alias("lo"),
        F.expr("end_time div 1000 * 1000 - 1").alias("hi"),
    )
    stats = aggregate_intervals(
        spans, hourly, EVENT, keys, measures, ts=date_ms, chunk_ms=chunk_ms
    )
    means = [
        F.round(_ratio(F.col(f"s_{c}"), F.col(f"n_{c}")), 2).alias(out) for c, out in WEATHER_MEANS.items()
    ]
    rounded = stats.select(
        *EVENT,
        *means,
        F.round("hi_exp", 2).alias("repi_power_exp_max"),
        F.round("lo_exp", 2).alias("repi_power_exp_min"),
    )
    return rounded if set(events.columns) == set(EVENT) else events.join(rounded, EVENT)


ENRICHED = [
    "start_time", "end_time", "duration", "avg_res_load_power_during", "res_load_week_before",
    "res_load_week_after", "peak_res_load_power_during", "energy_consumption_during",
    "avg_res_load_power_before_after", "avg_weighted_price_during", "avg_weighted_price_week_before",
    "avg_weighted_price_week_after", "avg_price_during", "avg_price_week_before", "avg_price_week_after",
    "extent", "storage_made_electricity_value", "price_increase_during", "relative_price_increase_during",
    "price_increase_during_weighted", "relative_price_increase_during_weighted", "in_before_after_range",
    "event_cost", "event_cost_weighted", "day_of_week", "day_of_month", "month", "year", "duration_ms",
    "duration_days", "repi_power1avg", "repi_power1avg2", "repi_power_exp_avg", "repi_power_exp_max",
    "repi_power_exp_min", "wind_speed_100_avg", "diffuse_radiation_avg", "direct_radiation_avg",
]


def enrich_events(
    events: DataFrame,
    market: DataFrame,
    weather: DataFrame,
    margin_ms: int = WEEK_MS,
    tz: str = clock.BERLIN,
    date_ms: str = "date_ms",
    chunk_ms: int = clock.DAY_MS,
) -> DataFrame:
    """Every event with its 38 statistics, prefixed by threshold and series keys."""
    sums = market_sums(events, market, margin_ms, chunk_ms=chunk_ms)
    priced = cost(price_delta(extent(price_stats(load_stats(sums, margin_ms)))))
    outside = weather_stats(events.select(*EVENT), weather, date_ms, chunk_ms=chunk_ms)
    full = calendar(priced, tz).join(outside, EVENT)
    return full.select("threshold", "region", "resolution", *ENRICHED)
