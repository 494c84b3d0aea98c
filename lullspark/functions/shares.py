"""Shares, balances and price changes as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from lullspark.registry import PRODUCTION, SENTINEL


def _decimal(value: Column, kind: str, lenient: bool) -> Column:
    """Overflow is an error; ``lenient`` turns it into null."""
    return value.try_cast(kind) if lenient else value.cast(kind)


def wind_solar_sum(lenient: bool = False) -> Column:
    total = (
        F.col("electricity_production_photovoltaics")
        + F.col("electricity_production_wind_onshore")
        + F.col("electricity_production_wind_offshore")
    )
    return _decimal(total, "decimal(12,2)", lenient)


def _share(part: Column, whole: Column, lenient: bool) -> Column:
    # The five-digit rounding belongs to the quotient, not to the share.
    return F.lit(1).cast("decimal(6,5)") - _decimal(F.try_divide(part, whole), "decimal(6,5)", lenient)


def wind_solar_share(lenient: bool = False) -> Column:
    return _share(F.col("power_consumption_residual_load"), F.col("power_consumption_total"), lenient)


def renewable_share(lenient: bool = False) -> Column:
    rest = (
        F.col("power_consumption_residual_load")
        - F.col("electricity_production_hydropower")
        - F.col("electricity_production_other_renewables")
        - F.col("electricity_production_biomass")
        - F.col("electricity_production_pumped_storage")
        + F.col("electricity_consumption_pumped_storage")
    )
    return _share(rest, F.col("power_consumption_total"), lenient)


def total_production(lenient: bool = False) -> Column:
    produced = reduce(add, [F.col(c) for c in PRODUCTION])
    return _decimal(produced - F.col("electricity_consumption_pumped_storage"), "decimal(12,2)", lenient)


def net_import(lenient: bool = False) -> Column:
    return _decimal(F.col("power_consumption_total") - total_production(lenient), "decimal(12,2)", lenient)


def valid_share_row() -> Column:
    """Loads present and non-zero; the three weather-driven sources really measured."""
    ok = (
        F.col("power_consumption_residual_load").isNotNull()
        & F.col("power_consumption_total").isNotNull()
        & (F.col("power_consumption_total") != 0)
    )
    for source in ("photovoltaics", "wind_onshore", "wind_offshore"):
        ok = ok & (F.col(f"electricity_production_{source}") != F.lit(SENTINEL))
    return ok


def share_from_pair(residual: Column, total: Column) -> Column:
    """Un-rounded share from a (residual, total) pair."""
    return F.lit(1.0) - F.try_divide(residual.cast("double"), total.cast("double"))


def classify(value: Column, threshold: float) -> Column:
    """LOW at or below the threshold; null counts as HIGH."""
    return F.when(value <= F.lit(threshold), F.lit("LOW")).otherwise(F.lit("HIGH"))


def price_change_abs(current: Column, last: Column, lenient: bool = False) -> Column:
    return _decimal(current - last, "decimal(7,3)", lenient)


def price_change_rel(current: Column, last: Column, lenient: bool = False) -> Column:
    return _decimal(F.try_divide(current, last) - F.lit(1).cast("decimal(2,1)"), "decimal(7,3)", lenient)


def clear_sentinel(value: Column) -> Column:
    return F.when(value != F.lit(SENTINEL), value)
