"""Renewable production indices and wind profiles.

``w`` is mean wind at 100 m, ``w_max`` its maximum, ``d`` direct and ``f`` diffuse
radiation. Every index is rounded twice: to four digits, then to two.
``least`` skips nulls, so a missing ``w`` counts as the cap; ``null_wind=True``
returns null instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the index formulas.
WIND_CAP = 11
EXP_SCALE = 1550
EXP_RATE = -0.001
EXP_RADIATION_WEIGHT = 1.4
MIX_DIVISOR = 30
LOW_HEIGHT, HIGH_HEIGHT, TOP_HEIGHT, HUB_HEIGHT = 80.0, 120.0, 180.0, 100.0


def _twice_rounded(value: Column) -> Column:
    return F.round(value.cast("decimal(8,4)"), 2)


def _d(value: Column) -> Column:
    return value.cast("double")


def _capped(w: Column, null_wind: bool) -> Column:
    capped = F.least(_d(w), F.lit(float(WIND_CAP)))
    return F.when(w.isNotNull(), capped) if null_wind else capped


def repi_30mix(w_max: Column, d: Column, f: Column) -> Column:
    return _twice_rounded(_d(w_max) + _d(d) / MIX_DIVISOR + _d(f) / MIX_DIVISOR)


def repi_power1avg(w: Column, d: Column, f: Column, null_wind: bool = False) -> Column:
    return _twice_rounded(F.pow(_capped(w, null_wind), F.lit(3.0)) + _d(d) + _d(f))


def repi_power1avg2(w: Column, d: Column, f: Column, null_wind: bool = False) -> Column:
    return _twice_rounded(F.pow(_capped(w, null_wind), F.lit(3.0)) + _d(d) * 2 + _d(f) * 2)


def repi_power_exp(w: Column, d: Column, f: Column) -> Column:
    wind = F.lit(float(EXP_SCALE)) * (1 - F.exp(F.lit(EXP_RATE) * F.pow(_d(w), F.lit(3.0))))
    return _twice_rounded(wind + _d(d) * EXP_RADIATION_WEIGHT + _d(f) * EXP_RADIATION_WEIGHT)


def repi_square1avg(w: Column, d: Column, f: Column, null_wind: bool = False) -> Column:
    return _twice_rounded(F.pow(_capped(w, null_wind), F.lit(2.0)) + _d(d) + _d(f))


def live_index(w: Column, d: Column, f: Column) -> Column:
    """``repi_power1avg2`` on plain doubles, rounded once, half to even; null without wind."""
    return F.bround(F.pow(_capped(w, null_wind=True), F.lit(3.0)) + _d(d) * 2 + _d(f) * 2, 2)


def shear_exponent(low: Column, high: Column, low_height: float, high_height: float) -> Column:
    """Power-law exponent between two heights; null for non-positive speeds."""
    return F.ln(F.try_divide(_d(high), _d(low))) / F.ln(F.lit(high_height / low_height))


def mean_shear_exponent(w80: Column, w120: Column, w180: Column) -> Column:
    return (
        shear_exponent(w80, w120, LOW_HEIGHT, HIGH_HEIGHT)
        + shear_exponent(w120, w180, HIGH_HEIGHT, TOP_HEIGHT)
        + shear_exponent(w80, w180, LOW_HEIGHT, TOP_HEIGHT)
    ) / F.lit(3.0)


def wind_at_height(low: Column, high: Column, target: float = HUB_HEIGHT) -> Column:
    """Wind at ``target`` metres by the power law through 80 m and 120 m."""
    exponent = shear_exponent(low, high, LOW_HEIGHT, HIGH_HEIGHT)
    return _d(low) * F.pow(F.lit(target / LOW_HEIGHT), exponent)


def wind_by_exponent(low: Column, exponent: Column, target: float = HUB_HEIGHT) -> Column:
    return _d(low) * F.pow(F.lit(target / LOW_HEIGHT), exponent)
